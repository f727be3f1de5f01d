"""Schemas of the library's tables, as DDL, and builders that bring a table into one, row by row or not at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .errors import FrameError
from .quarantine import Quarantine, set_aside

#: One row for each frame.
FRAMES = "frame_id string, width int, height int, channels int, is_normalized boolean, bayerpat string"
#: One row for each pixel of a single-channel frame, origin top left.
PIXELS = "frame_id string, y int, x int, v double"
#: One row for each measured star; rank is its place in order of falling filter response.
STARS = "frame_id string, rank int, x double, y double, flux double, hfr double, fwhm double, eccentricity double"
#: One row for each frame's noise.
SCORES = "frame_id string, noise double, weight double"
#: One row for each file that could not be decoded.
ERRORS = "frame_id string, message string"


def _conformed(df: DataFrame, ddl: str, may_be_null: tuple[str, ...], rules: dict[str, Column], stage: str, quarantine: Quarantine | None) -> DataFrame:
    """The columns of ``ddl``, cast; rows whose values don't cast, are null or break a rule (a message and what must hold) are set aside."""
    fields = StructType.fromDDL(ddl).fields
    if missing := [f.name for f in fields if f.name not in df.columns]:
        raise FrameError(f"{stage} need the columns {', '.join(missing)}")
    cast = df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in fields], *[F.col(f.name).isNotNull().alias(f"had_{f.name}") for f in fields])
    message = None
    for f in fields:
        told = F.when(F.col(f.name).isNull() & F.col(f"had_{f.name}"), F.lit(f"{f.name} is no {f.dataType.simpleString()}"))
        if f.name not in may_be_null:
            told = F.coalesce(told, F.when(F.col(f.name).isNull(), F.lit(f"{f.name} is missing")))
        message = told if message is None else F.coalesce(message, told)
    for text, holds in rules.items():
        message = F.coalesce(message, F.when(~F.coalesce(holds, F.lit(True)), F.lit(text)))
    return set_aside(cast, message, stage, quarantine).select(*[f.name for f in fields])


def _finite(*columns: str) -> Column:
    holds = F.lit(True)
    for c in columns:
        holds &= ~F.isnan(c) & (F.abs(c) < float("inf"))
    return holds


def frames_table(df: DataFrame, quarantine: Quarantine | None = None) -> DataFrame:
    """FRAMES: sizes and channels are positive."""
    rules = {"a frame has width and height": (F.col("width") > 0) & (F.col("height") > 0), "a frame has channels": F.col("channels") > 0}
    return _conformed(df, FRAMES, ("bayerpat",), rules, "frames", quarantine)


def pixels_table(df: DataFrame, quarantine: Quarantine | None = None) -> DataFrame:
    """PIXELS: places aren't negative; a value may be missing."""
    return _conformed(df, PIXELS, ("v",), {"a place isn't negative": (F.col("y") >= 0) & (F.col("x") >= 0)}, "pixels", quarantine)


def stars_table(df: DataFrame, quarantine: Quarantine | None = None) -> DataFrame:
    """STARS: measures are finite, sizes aren't negative, the eccentricity isn't either."""
    rules = {
        "a star's measures are finite": _finite("x", "y", "flux", "hfr", "fwhm", "eccentricity"),
        "a star's sizes aren't negative": (F.col("hfr") >= 0) & (F.col("fwhm") >= 0) & (F.col("eccentricity") >= 0), "ranks count from 1": F.col("rank") >= 1,
    }
    return _conformed(df, STARS, (), rules, "stars", quarantine)


def scores_table(df: DataFrame, quarantine: Quarantine | None = None) -> DataFrame:
    """SCORES of known noises (frame_id, noise): the weight is 1 / noise squared, infinite for no noise."""
    noise = F.col("noise").try_cast("double")
    weight = F.when(noise == 0, F.lit(float("inf"))).otherwise(1 / (noise * noise))
    rules = {"noise isn't negative": F.col("noise") >= 0, "noise is a number": ~F.isnan("noise")}
    return _conformed(df.withColumn("weight", weight), SCORES, (), rules, "scores", quarantine)
