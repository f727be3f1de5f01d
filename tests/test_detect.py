"""Detection on synthetic frames, all in one run: a frame is one key among others."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.config import DetectorConfig
from skyframe.errors import FrameError
from skyframe.plans.detect import MatchedFilterDetector, estimate_fwhm
from skyframe.sources.synth import add_gradient, add_noise, add_star, flat
from skyframe.spool import save


def frame(spark, name, side, stars, seed, amplitude, gradient=None):
    pixels = flat(spark, name, side, side, 200)
    for cx, cy, peak, sigma in stars:
        pixels = add_star(pixels, cx, cy, peak, sigma)
    if gradient:
        pixels = add_gradient(pixels, *gradient)
    return add_noise(pixels, seed, amplitude, side, side)


@pytest.fixture(scope="module")
def pixels(spark):
    parts = [
        frame(spark, "planted", 160, [(40, 40, 3000, 2), (120, 50, 2500, 2.2), (80, 120, 4000, 1.8)], 1, 8),
        frame(spark, "gradient", 160, [], 2, 8, (6, 4)),
        frame(spark, "noise", 160, [], 3, 12),
        frame(spark, "hot", 120, [(30, 30, 6000, 0.01), (80, 80, 8000, 0.01)], 4, 8),
        frame(spark, "metrics", 120, [(60, 60, 4000, 2)], 5, 6),
        frame(spark, "wide", 200, [(50, 50, 5000, 2.5), (150, 60, 4500, 2.5), (100, 150, 6000, 2.5)], 6, 8),
        flat(spark, "flat", 40, 40, 7),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return save(out, "test-frames")


@pytest.fixture(scope="module")
def stars(pixels):
    return MatchedFilterDetector().detect(pixels).toPandas()


def test_planted_stars_are_found_and_nothing_else(stars):
    found = stars[stars.frame_id == "planted"]
    assert len(found) == 3
    for cx, cy in ((40, 40), (120, 50), (80, 120)):
        assert ((abs(found.x - cx) < 1) & (abs(found.y - cy) < 1)).any()


@pytest.mark.parametrize("name", ["gradient", "noise", "hot", "flat"])
def test_frames_without_stars(stars, name):
    assert not (stars.frame_id == name).any()


def test_metrics(stars):
    (star,) = stars[stars.frame_id == "metrics"].itertuples()
    assert abs(star.x - 60) < 0.3 and abs(star.y - 60) < 0.3
    assert abs(star.fwhm / (2.3548 * 2) - 1) < 0.15 and star.eccentricity < 0.2
    assert star.flux > 0 and star.hfr > 0


def test_estimated_fwhm(pixels):
    found = {r.frame_id: r.fwhm for r in estimate_fwhm(pixels).collect()}
    assert abs(found["wide"] / (2.3548 * 2.5) - 1) < 0.25
    assert "noise" not in found and "flat" not in found


def test_options(pixels):
    only = save(pixels.where(F.col("frame_id").isin("metrics", "planted")), "test-two")
    count = lambda **c: MatchedFilterDetector(DetectorConfig(expected_fwhm=4.7, **c)).detect(only).groupBy("frame_id").count().collect()
    assert {r.frame_id: r["count"] for r in count()} == {"metrics": 1, "planted": 3}
    # Peaks of 4000 on a level of 200 saturate; with a margin of 41, 160-pixel frames keep centres from 41 to 118.
    assert {r.frame_id: r["count"] for r in count(saturation_level=3500.0)} == {"planted": 2}
    assert {r.frame_id: r["count"] for r in count(edge_margin=41)} == {"metrics": 1}


def test_more_channels_are_an_error(spark):
    frames = spark.createDataFrame([("a", 4, 4, 3)], "frame_id string, width int, height int, channels int")
    with pytest.raises(FrameError, match="3"):
        MatchedFilterDetector().detect(flat(spark, "a", 4, 4, 0), frames)


def test_empty_frames_have_no_stars(spark):
    pixels = flat(spark, "a", 4, 4, 0).limit(0)
    assert MatchedFilterDetector().detect(pixels).count() == 0


def test_constants():
    from skyframe.functions.scalars import FWHM_PER_SIGMA

    assert math.isclose(FWHM_PER_SIGMA, 2.354820045, rel_tol=1e-9)


def brute_hfr(x, y, w, cx, cy):
    """The radius about (cx, cy) at which the flux summed outwards first reaches a half."""
    order = sorted((math.hypot(a - cx, b - cy), b, a, c) for a, b, c in zip(x, y, w, strict=True))
    half, total, before = sum(w) / 2, 0.0, 0.0
    for r, _, _, c in order:
        if total + c >= half:
            return before + ((half - total) / c if c > 0 else 0) * (r - before)
        total, before = total + c, r
    return before


def test_hfr_is_about_the_fitted_centre_and_background(spark):
    """A star with a fainter neighbour, whose light moves the centroid and lifts the window's median: every step by numpy."""
    from skyframe.functions.scalars import FWHM_PER_SIGMA
    from skyframe.operators.fit import fit_gaussians

    side, x0 = 60, np.arange(60)
    pixels = add_star(add_star(flat(spark, "pair", side, side, 200), 30, 30, 4000, 2), 36, 31, 700, 1.5)
    pixels = save(add_noise(pixels, 7, 6, side, side), "pair")
    found = MatchedFilterDetector(DetectorConfig(expected_fwhm=4.7, roundness_limit=0.95)).detect(pixels).toPandas()
    star = found[(found.x - 30).abs() < 1].iloc[0]
    v = np.zeros((side, side))
    for r in pixels.collect():
        v[r.y, r.x] = r.v
    radius = max(3, math.floor(1.5 * 4.7 + 0.5))
    py, px = np.unravel_index(v.argmax(), v.shape)
    y, x = (a.ravel() for a in np.mgrid[py - radius : py + radius + 1, px - radius : px + radius + 1])
    value = v[y, x]
    background = np.median(value)
    w = value - background
    cx, cy = (w @ x) / w.sum(), (w @ y) / w.sum()
    mxx, myy, mxy = (w @ ((x - cx) ** 2)) / w.sum(), (w @ ((y - cy) ** 2)) / w.sum(), (w @ ((x - cx) * (y - cy))) / w.sum()
    mean, d = (mxx + myy) / 2, math.hypot((mxx - myy) / 2, mxy)
    seed = np.array([[v[py, px] - background, cx, cy, math.sqrt(max(mean + d, 1e-6)), math.sqrt(max(mean - d, 1e-6)), math.atan2(2 * mxy, mxx - myy) / 2, background]])
    fit = fit_gaussians(x[None].astype(float), y[None].astype(float), value[None], np.ones((1, len(x))), seed)
    p = fit.parameters
    assert fit.good[0] and fit.slope[0] < 1e-3 and fit.curvature[0] > 0 and (star.x, star.y) == pytest.approx((p[0, 1], p[0, 2]), abs=1e-4)
    assert star.fwhm == pytest.approx(FWHM_PER_SIGMA * math.sqrt(abs(p[0, 3] * p[0, 4])), abs=1e-4)
    assert star.hfr == pytest.approx(brute_hfr(x, y, value - p[0, 6], p[0, 1], p[0, 2]), abs=1e-4)
    assert abs(star.hfr - brute_hfr(x, y, w, cx, cy)) > 0.02


def test_mosaics_have_one_channel(spark):
    from skyframe.operators.bayer import bayer_grayscale
    from skyframe.operators.grid import pixels_from_arrays

    frames = spark.createDataFrame([("a", 2, 2, 3, [float(i) for i in range(12)])], "frame_id string, width int, height int, channels int, values array<double>")
    rows = {(r.y, r.x, r.channel): r.v for r in pixels_from_arrays(frames).collect()}
    assert rows == {(i // 6, i // 3 % 2, i % 3): float(i) for i in range(12)}
    with pytest.raises(FrameError, match="3 channels"):
        bayer_grayscale(pixels_from_arrays(frames), "RGGB")
