import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyframe.errors import FrameError
from skyframe.functions.scalars import effective_fwhm, gaussian_value, measurement_radius, moment_eccentricity, reported_hfr, rms, snr_weight
from skyframe.operators.bands import zero_sum_response
from skyframe.operators.bayer import bayer_grayscale, demosaic
from skyframe.operators.field import star_field
from skyframe.operators.fit import gaussian_fit
from skyframe.operators.grid import crop, frames_of, local_maxima, pixels_from_arrays, square_windows
from skyframe.operators.moments import star_moments
from skyframe.operators.peaks import matched, separate
from skyframe.operators.stats import exact_median, signal_to_noise
from skyframe.sources.synth import add_star, flat, mosaic, noise

PIXELS = "frame_id string, y int, x int, v double"


def grid(spark, name, values):
    values = np.asarray(values, float)
    rows = [(name, y, x, float(v)) for (y, x), v in np.ndenumerate(values)]
    return spark.createDataFrame(rows, PIXELS)


def test_errors():
    assert str(FrameError("a")) == "a" and FrameError("a") == FrameError("a") != FrameError("b")


def test_noise_generator():
    assert noise(42, 3).tolist() == [0.1364606532878152, -0.5490731421044974, -0.17432336234097634]


@pytest.mark.parametrize("values,expected", [(range(7), 2.9652), ([5] * 5, None), ([], None), ([1, float("nan"), 2, 3], 1.4826)])
def test_signal_to_noise(spark, values, expected):
    df = spark.createDataFrame([("a", 0, i, float(v)) for i, v in enumerate(values)], PIXELS)
    rows = signal_to_noise(df).collect()
    if expected is None:
        assert rows == []
    else:
        assert math.isclose(rows[0].noise, expected, rel_tol=1e-9) and math.isclose(rows[0].weight, expected**-2, rel_tol=1e-9)


def test_weight(spark):
    rows = spark.createDataFrame([(2.0,), (0.5,), (0.0,)], "n double").select(snr_weight(F.col("n")).alias("w")).collect()
    assert [r.w for r in rows] == [0.25, 4.0, math.inf]


def test_exact_median_against_numpy(spark):
    rng = np.random.default_rng(1)
    groups = {
        "few": [1.0], "two": [1.0, 4.0], "odd": rng.normal(size=2001), "even": rng.normal(size=5000), "ties": rng.integers(0, 3, 4000).astype(float),
        "constant": [3.0] * 100, "nan": [1.0, float("nan"), 2.0],
    }
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "k string, v double")
    found = {r.k: r.m for r in exact_median(df, ["k"], "v", "m").collect()}
    assert found == {k: float(np.nanmedian(v)) for k, v in groups.items()}


def brute_maxima(v, t):
    out = set()
    for (y, x), c in np.ndenumerate(v):
        near = [v[j, i] for j in range(max(0, y - 1), min(v.shape[0], y + 2)) for i in range(max(0, x - 1), min(v.shape[1], x + 2)) if (j, i) != (y, x)]
        if c > t and all(c > n for n in near):
            out.add((y, x))
    return out


def test_local_maxima_against_brute_force(spark):
    rng = np.random.default_rng(2)
    grids = {f"g{k}": rng.integers(0, 6, (9, 11)).astype(float) for k in range(6)}
    grids["g5"][rng.random((9, 11)) < 0.15] = np.nan
    df = grid(spark, "g0", grids["g0"])
    for k, v in list(grids.items())[1:]:
        df = df.union(grid(spark, k, v))
    found = local_maxima(df, F.lit(1.5)).collect()
    with np.errstate(invalid="ignore"):
        assert {(r.frame_id, r.y, r.x) for r in found} == {(k, *p) for k, v in grids.items() for p in brute_maxima(v, 1.5)}


def test_windows_are_clipped(spark):
    df = flat(spark, "a", 5, 4, 1)
    peaks = spark.createDataFrame([("a", 0, 0, 1), ("a", 2, 2, 2)], "frame_id string, y int, x int, r int")
    rows = square_windows(peaks, df, F.col("r")).collect()
    assert sorted((r.dy, r.dx) for r in rows if r.y == 0) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert len([r for r in rows if r.y == 2]) == 20


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12), st.integers(1, 5)), min_size=1, max_size=30, unique_by=lambda t: t[:2]), st.sampled_from([0.5, 2.0, 3.0]))
def test_separation_against_brute_force(spark, peaks, distance):
    kept = []
    for y, x, v in sorted(peaks, key=lambda p: (-p[2], p[0], p[1])):
        if all((y - b) ** 2 + (x - a) ** 2 >= distance**2 for b, a, _ in kept):
            kept.append((y, x, v))
    df = spark.createDataFrame([("a", y, x, float(v)) for y, x, v in peaks], PIXELS)
    for tile in (1, 64):  # tiles as wide as the distance leave chains to later rounds
        found = separate(df.withColumn("tile_row", F.lit("own")), "v", distance, tile)
        assert sorted((r.y, r.x, int(r.v)) for r in found.collect()) == sorted(kept)
        assert found.columns == [*df.columns, "tile_row"]


def test_separation_along_a_chain(spark):
    """Every peak hangs on the one before it; repeated rows and frames of their own distance."""
    rows = [(f, 0, 2 * k, 1000.0 - k) for f in ("a", "b") for k in range(40)] + [("a", 0, 0, 1000.0)]
    df = spark.createDataFrame(rows, PIXELS)
    found = separate(df, "v", F.when(F.col("frame_id") == "a", 3.0).otherwise(0.0), 1).collect()
    assert sorted((r.frame_id, r.x) for r in found) == [("a", 4 * k) for k in range(20)] + [("b", 2 * k) for k in range(40)]
    assert separate(df.limit(0), "v", 3.0).count() == 0


def test_zero_sum_vanishes_on_flats_and_ramps(spark):
    y, x = np.mgrid[0:20, 0:24]
    df = grid(spark, "flat", np.full((20, 24), 9)).union(grid(spark, "ramp", 6 * x + 4 * y))
    rows = zero_sum_response(df, frames_of(df), 1.27).where("frame_id = 'flat' or (x between 4 and 19 and y between 4 and 15)").agg(F.max(F.abs("response"))).first()
    assert rows[0] < 1e-9


def sample_grid(spark, side, centre, sx, sy, peak=3000, bg=200):
    y, x = np.mgrid[0:side, 0:side]
    v = bg + peak * np.exp(-((x - centre[0]) ** 2 / (2 * sx**2) + (y - centre[1]) ** 2 / (2 * sy**2)))
    return grid(spark, "s", v).withColumn("background", F.lit(float(bg)))


def test_moments_of_round_elongated_and_offset_stars(spark):
    m = star_moments(sample_grid(spark, 31, (15, 15), 3, 3), ["frame_id"]).first()
    assert abs(m.x - 15) < 0.05 and abs(m.y - 15) < 0.05 and m.eccentricity < 0.05
    assert abs(m.fwhm / (2.3548 * 3) - 1) < 0.05 and abs(m.hfr / (1.1774 * 3) - 1) < 0.1
    assert abs(star_moments(sample_grid(spark, 41, (20, 20), 2, 4), ["frame_id"]).first().eccentricity - 0.866) < 0.05
    m = star_moments(sample_grid(spark, 31, (12, 18), 3, 3), ["frame_id"]).first()
    assert abs(m.x - 12) < 0.05 and abs(m.y - 18) < 0.05
    assert star_moments(grid(spark, "s", np.full((5, 5), 200.0)).withColumn("background", F.lit(200.0)), ["frame_id"]).count() == 0


def test_half_flux_radius_with_negative_weights(spark):
    # Sums outwards of 4, 3, 6, 5 with a half of 2.5: crossed by the first sample, at 2.5 / 4 of its radius 0.
    df = spark.createDataFrame([("a", 0, x, float(v)) for x, v in ((0, 4), (1, -1), (2, 3), (3, -1))], PIXELS).withColumn("background", F.lit(0.0))
    cx = (0 * 4 - 1 + 6 - 3) / 5
    r = sorted((abs(x - cx), w) for x, w in ((0, 4), (1, -1), (2, 3), (3, -1)))
    cum, before, prev, expected = 0, 0, 0, r[-1][0]
    for radius, w in r:
        before, cum = cum, cum + w
        if cum >= 2.5:
            expected = prev + ((2.5 - before) / w if w > 0 else 0) * (radius - prev)
            break
        prev = radius
    assert math.isclose(star_moments(df, ["frame_id"]).first().hfr, expected, abs_tol=1e-12)


def test_scalars(spark):
    one = spark.range(1)
    assert one.select(measurement_radius(F.lit(3.0))).first()[0] == 5 and one.select(measurement_radius(F.lit(1.0))).first()[0] == 3
    assert one.select(effective_fwhm(None, F.lit(None).cast("double"))).first()[0] == 3.0 and one.select(effective_fwhm(0.2)).first()[0] == 1.0
    assert one.select(moment_eccentricity(F.lit(-1.0), F.lit(-1.0), F.lit(0.0))).first()[0] == 0.0
    assert [one.select(reported_hfr(F.lit(n))).first()[0] for n in ("a_0000_H3.69.fits", "a.fits")] == [3.69, None]
    assert one.select(moment_eccentricity(F.lit(2.0), F.lit(-1.0), F.lit(0.0))).first()[0] > 1


def test_fit_of_a_rotated_star(spark):
    y, x = np.mgrid[2:39, 2:39]
    theta, dx, dy = math.radians(30), x - 20.4, y - 19.6
    u, t = dx * math.cos(theta) + dy * math.sin(theta), -dx * math.sin(theta) + dy * math.cos(theta)
    v = 200 + 3000 * np.exp(-0.5 * ((u / 2) ** 2 + (t / 4) ** 2)) + 8 * noise(42, x.size).reshape(x.shape)
    samples = [(float(a), float(b), float(c)) for a, b, c in zip(x.ravel(), y.ravel(), v.ravel(), strict=True)]
    seed = (2800.0, 20.0, 20.0, 3.5, 2.5, theta + math.pi / 2, 190.0)
    struct = "amplitude double, x double, y double, sigma_x double, sigma_y double, theta double, background double"
    df = spark.createDataFrame([(1, samples, seed), (2, samples[:3], (0.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0)), (3, [(0.0, 0.0, float("nan"))], seed)],
                               f"k int, samples array<struct<x:double,y:double,v:double>>, seed struct<{struct.replace(' double', ':double')}>")
    fits = {r.k: r.fit for r in gaussian_fit(df, ["k"]).collect()}
    f = fits[1]
    assert sorted(abs(s) for s in (f.sigma_x, f.sigma_y)) == pytest.approx([2, 4], abs=0.2)
    assert (f.x, f.y) == pytest.approx((20.4, 19.6), abs=0.1) and f.amplitude == pytest.approx(3000, rel=0.05) and f.background == pytest.approx(200, abs=2)
    assert set(fits) == {1, 2, 3}
    off = gaussian_fit(df, ["k"]).where("k = 1").join(df.select("k", F.explode("samples").alias("s")), "k")
    assert off.agg(rms(F.col("s.v") - gaussian_value(F.col("fit"), F.col("s.x"), F.col("s.y")))).first()[0] < 20


def test_star_field(spark):
    stars = spark.createDataFrame([("odd", 6.0, 3.0, 0.6), ("odd", 2.0, 1.0, 0.2), ("odd", 4.0, 2.0, 0.4), *[("even", 2.0 * k, 1.0 * k, k / 10) for k in (1, 2, 3, 4)]], "frame_id string, fwhm double, hfr double, eccentricity double")
    frames = spark.createDataFrame([("odd",), ("even",), ("none",)], "frame_id string")
    rows = {r.frame_id: r for r in star_field(frames, stars).collect()}
    assert (rows["odd"]["count"], rows["odd"].median_fwhm, rows["odd"].median_hfr, rows["odd"].median_eccentricity) == (3, 4, 2, 0.4)
    assert (rows["even"].median_fwhm, rows["even"].median_hfr) == (5, 2.5)
    assert rows["none"]["count"] == 0 and rows["none"].median_fwhm is None


def test_bayer(spark):
    rows = bayer_grayscale(flat(spark, "a", 8, 8, 500), "RGGB").collect()
    assert len(rows) == 64 and all(abs(r.v - 500) < 1e-6 for r in rows)
    coloured = mosaic(flat(spark, "a", 16, 16, 0), 100, 200, 300)
    assert all(abs(r.v - 200) < 1 for r in bayer_grayscale(coloured, "RGGB").collect())
    r = demosaic(coloured, "RGGB").where("x = 8 and y = 8").first()
    assert (r.r, r.g, r.b) == pytest.approx((100, 200, 300))
    with pytest.raises(FrameError, match="GBRG"):
        demosaic(coloured, "GBRG")


def test_arrays_and_crop(spark):
    frames = spark.createDataFrame([("a", 3, 2, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])], "frame_id string, width int, height int, values array<double>")
    assert sorted((r.y, r.x, r.v) for r in crop(pixels_from_arrays(frames), 1, 1, 2, 1).collect()) == [(0, 0, 5), (0, 1, 6)]
    with pytest.raises(Exception, match="geometry"):
        pixels_from_arrays(frames.withColumn("width", F.lit(4))).collect()


def test_matching(spark):
    expected = spark.createDataFrame([("a", 10.0, 10.0), ("a", 30.0, 30.0), ("b", 10.0, 10.0)], "frame_id string, x double, y double")
    stars = spark.createDataFrame([("a", 10.9, 9.2), ("a", 31.0, 30.0)], "frame_id string, x double, y double")
    assert [(r.frame_id, r.x) for r in matched(expected, stars).collect()] == [("a", 10.0)]


def test_detection_plans_have_no_nested_loops(spark):
    df = add_star(flat(spark, "a", 20, 20, 1), 9, 9, 50, 2).withColumn("frame_id", F.concat("frame_id", (F.col("x") * 0).cast("string")))
    plan = local_maxima(df, F.lit(2.0))._jdf.queryExecution().toString() + square_windows(local_maxima(df, F.lit(2.0)), df, 3)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
