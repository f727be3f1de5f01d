"""Demosaicing inside bands, and the noise generator's jumps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.errors import FrameError
from skyframe.operators.bands import bands_of_arrays, pixels_of
from skyframe.operators.bayer import PATTERNS, bayer_grayscale
from skyframe.operators.mosaic import demosaiced, grey_bands
from skyframe.quarantine import Quarantine
from skyframe.sources.synth import ADD, FACTOR, add_noise, flat, jump, noise, noise_rows


@pytest.mark.parametrize("mode", ["bilinear", "gradient"])
def test_flat_channels_stay_flat_to_the_border(mode):
    for pattern in PATTERNS:
        if mode == "gradient" and pattern == "RGBG":
            continue
        for shape in ((16, 16), (7, 9), (3, 4)):
            for first in (0, 1):
                y, x = np.indices(shape)
                v = np.vectorize(dict(zip("RGB", (100.0, 200.0, 300.0), strict=True)).get)(np.array(list(pattern))[2 * ((y + first) % 2) + x % 2])
                out = demosaiced(v, pattern, mode, first)
                assert all(abs(out[c] - level).max() < 1e-9 for c, level in zip("RGB", (100, 200, 300), strict=True))


def test_gradient_mode_restores_a_ramp_and_beats_bilinear_on_an_edge():
    y, x = np.indices((24, 24))
    ramp = 3.0 * x + 2.0 * y
    for pattern in ("RGGB", "BGGR", "GRBG"):
        inside = demosaiced(ramp, pattern, "gradient")
        assert all(abs(inside[c] - ramp)[3:-3, 3:-3].max() < 1e-9 for c in "RGB")
    grey = 100 + 900 / (1 + np.exp(-(x - 12.3) * 2)) + 5 * y
    error = {m: sum(((demosaiced(grey, "RGGB", m)[c] - grey)[3:-3, 3:-3] ** 2).sum() for c in "RGB") for m in ("bilinear", "gradient")}
    assert error["gradient"] < 0.6 * error["bilinear"]


def test_bands_give_what_rows_give(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(p or "none", 11, 21, p, rng.random(231).tolist()) for p in (*PATTERNS, None)], "frame_id string, width int, height int, bayerpat string, values array<double>")
    whole = {}
    for most in (1 << 20, 1):
        bands = bands_of_arrays(df, 6, most).join(df.select("frame_id", "bayerpat"), "frame_id")
        for mode in ("bilinear", "gradient"):
            aside = Quarantine()
            grey = grey_bands(bands, mode, aside)
            got = {(r.frame_id, r.y, r.x): r.v for r in pixels_of(grey).collect()}
            assert whole.setdefault(mode, got) == pytest.approx(got, abs=1e-12)
            assert [r.frame_id for r in aside.rows(spark).collect()] == (["RGBG"] if mode == "gradient" else [])
            # A rim of 6 that doesn't begin with the frame is one of 4 afterwards.
            assert all(r.top == min(r.y, 6) - (2 if r.bayerpat and r.y > 6 else 0) for r in grey.collect())
    pixels = pixels_of(bands_of_arrays(df)).join(df.select("frame_id", "bayerpat").where("bayerpat is not null"), "frame_id")
    rows = {(r.frame_id, r.y, r.x): r.v for r in bayer_grayscale(pixels, F.col("bayerpat")).collect()}
    assert {k: whole["bilinear"][k] for k in rows} == pytest.approx(rows, abs=1e-12) and len(rows) == 4 * 231
    with pytest.raises(FrameError, match="unknown demosaicing mode: vng"):
        grey_bands(bands, "vng")
    with pytest.raises(FrameError, match="RGBG"):
        grey_bands(bands, "gradient")


def test_jumps_are_steps(spark):
    state, states = 42, []
    for _ in range(200):
        state = (state * FACTOR + ADD) % 2**64
        states.append(state)
    for n in (0, 1, 2, 63, 199):
        f, a = jump(n + 1)
        assert (42 * f + a) % 2**64 == states[n]
    want = np.array([(s >> 11) * 2.0**-53 * 2 - 1 for s in states])
    assert (noise(42, 200) == want).all() and (noise(42, 50, 150) == want[150:]).all() and len(noise(42, 0)) == 0
    assert [float(noise(s, 1)[0]) for s in (1, 3, 42)] == [-0.15358165825457348, -0.7735795942768962, 0.1364606532878152]
    rows = sorted(tuple(r) for r in noise_rows(spark, 42, 200, 7).collect())
    assert [v for _, v in rows] == want.tolist()
    pixels = {(r.y, r.x): r.v for r in add_noise(flat(spark, "a", 20, 10, 5), 42, 3.0, 20, 10).collect()}
    assert all(pixels[i // 20, i % 20] == 5 + 3.0 * want[i] for i in range(200))


def test_many_draws_are_made_by_tasks(spark):
    got = noise_rows(spark, 7, 10**7, 64).agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.min("v").alias("a"), F.max("v").alias("b")).first()
    assert got.n == 10**7 and abs(got.m) < 1e-3 and -1 <= got.a < -0.999 and 0.999 < got.b <= 1
    assert noise(7, 1, 10**12).shape == (1,)
