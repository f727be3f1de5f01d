import math

import pytest

from skyframe.errors import FrameError
from skyframe.quarantine import Quarantine
from skyframe.schema import frames_table, pixels_table, scores_table, stars_table


def test_builders_cast_check_and_set_aside(spark):
    aside = Quarantine()
    frames = spark.createDataFrame([("a", "4", 3, 1, True, None), ("b", "x", 3, 1, True, None), ("c", "0", 3, 1, False, "RGGB"), (None, "4", 3, 1, True, None)], "frame_id string, width string, height long, channels int, is_normalized boolean, bayerpat string")
    assert [tuple(r) for r in frames_table(frames, aside).collect()] == [("a", 4, 3, 1, True, None)]
    pixels = spark.createDataFrame([("a", 0, 0, 1), ("a", -1, 0, 1), ("a", 2, 2, None)], "frame_id string, y int, x int, v int")
    assert pixels_table(pixels, aside).schema["v"].dataType.simpleString() == "double" and pixels_table(pixels, aside).count() == 2
    good = ("s", 1, 1.0, 2.0, 3.0, 1.0, 2.0, 0.1)
    stars = spark.createDataFrame([good, (*good[:4], math.nan, *good[5:]), (*good[:6], -1.0, 0.1), ("s", 0, *good[2:])], "frame_id string, rank int, x double, y double, flux double, hfr double, fwhm double, eccentricity double")
    assert [tuple(r) for r in stars_table(stars, aside).collect()] == [good]
    scores = spark.createDataFrame([("a", 2.0), ("b", 0.0), ("c", -1.0), ("d", math.nan)], "frame_id string, noise double")
    assert [tuple(r) for r in scores_table(scores, aside).collect()] == [("a", 2.0, 0.25), ("b", 0.0, math.inf)]
    told = {(r.stage, r.message) for r in aside.rows(spark).collect()}
    assert told == {
        ("frames", "width is no int"), ("frames", "a frame has width and height"), ("frames", "frame_id is missing"), ("pixels", "a place isn't negative"), ("stars", "a star's measures are finite"),
        ("stars", "a star's sizes aren't negative"), ("stars", "ranks count from 1"), ("scores", "noise isn't negative"), ("scores", "noise is a number"),
    }
    with pytest.raises(FrameError, match="width is no int"):
        frames_table(frames.where("frame_id = 'b'"))
    with pytest.raises(FrameError, match="need the columns v"):
        pixels_table(pixels.drop("v"))
