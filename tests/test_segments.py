"""Bodies against flood fill, and both strategies from one entry."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.config import DetectorConfig
from skyframe.operators.bands import bands_of_arrays
from skyframe.operators.segments import bodies, labelled
from skyframe.plans.detect import MatchedFilterDetector, StarDetecting
from skyframe.plans.segment import SegmentConfig, SegmentDetector
from skyframe.quarantine import Quarantine


def flood(bright):
    """Sets of places of the 8-connected bodies."""
    left, out = set(zip(*np.nonzero(bright), strict=True)), []
    while left:
        body, todo = set(), [left.pop()]
        while todo:
            y, x = todo.pop()
            body.add((int(y), int(x)))
            near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            todo += near
        out.append(body)
    return out


@pytest.mark.parametrize("share", [0.1, 0.4, 0.6, 1.0])
def test_labels_against_flood_fill(share):
    for seed in range(6):
        bright = np.random.default_rng(seed).random((17, 23)) < share
        labels = labelled(bright)
        got = {frozenset(map(tuple, np.argwhere(labels == k).tolist())) for k in range(1, labels.max() + 1)}
        assert got == set(map(frozenset, flood(bright))) and ((labels > 0) == bright).all()


@pytest.mark.parametrize("most", [1 << 20, 1])
def test_bodies_join_over_borders(spark, most):
    rng = np.random.default_rng(7)
    made = {"noise": rng.random((40, 30)), "comb": np.zeros((40, 30)), "none": np.zeros((9, 9))}
    made["comb"][:, ::2] = 1.0 + rng.random((40, 15))  # columns that only the last row joins
    made["comb"][39] = 2.0
    df = spark.createDataFrame([(k, v.shape[1], v.shape[0], v.ravel().tolist()) for k, v in made.items()], "frame_id string, width int, height int, values array<double>")
    level = 0.72
    got = {}
    for r in bodies(bands_of_arrays(df, 3, most), F.lit(level), F.lit(0.5)).collect():
        got.setdefault(r.frame_id, []).append(r)
    assert "none" not in got and len(got["comb"]) == 1
    for k in ("noise", "comb"):
        want = []
        for body in flood(made[k] > level):
            y, x = np.array(sorted(body)).T
            w = made[k][y, x] - 0.5
            cx, cy = (w * x).sum() / w.sum(), (w * y).sum() / w.sum()
            want.append((len(body), w.sum(), cx, cy, (w * (x - cx) ** 2).sum() / w.sum(), (w * (y - cy) ** 2).sum() / w.sum(), (w * (x - cx) * (y - cy)).sum() / w.sum(), made[k][y, x].max()))
        rows = sorted((r.area, r.flux, r.x, r.y, r.mxx, r.myy, r.mxy, r.peak) for r in got[k])
        assert len(rows) == len(want) and all(a == pytest.approx(b, abs=1e-9) for a, b in zip(rows, sorted(want), strict=True))


def test_both_strategies_from_one_entry(spark):
    side = 160
    y, x = np.mgrid[:side, :side]
    stars = [(40, 40, 3000), (120, 79, 2500), (80, 120, 4000)]
    rng = np.random.default_rng(3)
    v = 200 + rng.normal(size=(side, side)) * 4 + sum(p * np.exp(-((x - a) ** 2 + (y - b) ** 2) / 8) for a, b, p in stars)
    streak = np.full((side, side), 200.0) + rng.normal(size=(side, side)) * 4
    streak[20:140, 60:63] += 500
    df = spark.createDataFrame([(1, side, side, 1, v.ravel().tolist()), (2, side, side, 1, streak.ravel().tolist()), (3, side, side, 2, v.ravel().tolist())], "frame_id int, width int, height int, channels int, values array<double>")

    def centres(detector: StarDetecting, rim, most):
        aside = Quarantine()
        found = detector.detect(bands_of_arrays(df, rim, most), df, aside).toPandas()
        assert [r.stage for r in aside.rows(spark).collect()] == ["channels"] and set(found.frame_id) == {1}
        assert list(found.columns) == ["frame_id", "rank", "x", "y", "flux", "hfr", "fwhm", "eccentricity"] and sorted(found["rank"]) == [1, 2, 3]
        assert found.fwhm.between(3.5, 5.5).all() and found.hfr.between(1.8, 2.9).all()
        return {(round(a), round(b)) for a, b in zip(found.x, found.y, strict=True)}

    for rim, most in ((32, 1 << 20), (16, 1)):
        for detector in (MatchedFilterDetector(DetectorConfig()), SegmentDetector(SegmentConfig())):
            assert centres(detector, rim, most) == {(40, 40), (120, 79), (80, 120)}
    with pytest.raises(ValueError, match="radius"):
        SegmentDetector(SegmentConfig(radius=99))
