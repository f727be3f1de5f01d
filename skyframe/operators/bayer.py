"""Colour mosaics to grey frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import FrameError
from ..quarantine import Quarantine, set_aside

#: The mosaics that are known, read row by row from the top left 2 x 2.
PATTERNS = ("BGGR", "RGBG", "GRBG", "RGGB")


def check_pattern(pattern: str | None) -> None:
    if pattern is not None and pattern not in PATTERNS:
        raise FrameError(f"unsupported Bayer pattern: {pattern}")


def known_patterns(frames: DataFrame, quarantine: Quarantine | None = None) -> DataFrame:
    """``frames`` whose ``bayerpat`` is null or a mosaic that is known; the others go to ``quarantine`` or raise."""
    unknown = F.col("bayerpat").isNotNull() & ~F.col("bayerpat").isin(*PATTERNS)
    return set_aside(frames, F.when(unknown, F.concat(F.lit("unsupported Bayer pattern: "), F.col("bayerpat"))), "mosaic", quarantine)


def _is(channel: str, pattern: Column) -> Column:
    place = 1 + 2 * (F.col("y") % 2) + F.col("x") % 2
    return F.substr(pattern, place.cast("int"), F.lit(1)) == channel


def demosaic(pixels: DataFrame, pattern: Column | str) -> DataFrame:
    """``pixels`` with r, g and b at full resolution: a channel's own samples, else the mean of its nearest ones in the 3 x 3 around, by their bilinear weights.

    Only what lies inside the frame counts, so flat frames stay flat to the border. Rows, then
    columns: two windows. Frames must be dense.
    """
    if isinstance(pattern, str):
        check_pattern(pattern)
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    row, column = Window.partitionBy("frame_id", "y").orderBy("x"), Window.partitionBy("frame_id", "x").orderBy("y")
    smooth = lambda c, w: 2 * F.col(c) + F.coalesce(F.lag(c).over(w), F.lit(0.0)) + F.coalesce(F.lead(c).over(w), F.lit(0.0))
    df = pixels.withColumn("_pattern", pattern)
    df = df.withColumns({f"_m{c}": _is(c.upper(), F.col("_pattern")).cast("double") for c in "rgb"})
    df = df.withColumns({f"_s{c}": F.col("v") * F.col(f"_m{c}") for c in "rgb"})
    df = df.withColumns({f"_h{k}{c}": smooth(f"_{k}{c}", row) for k in "ms" for c in "rgb"})
    mixed = {c: smooth(f"_hs{c}", column) / F.nullif(smooth(f"_hm{c}", column), F.lit(0.0)) for c in "rgb"}
    df = df.withColumns({f"_v{c}": e for c, e in mixed.items()})
    return df.select(*pixels.columns, *[F.when(F.col(f"_m{c}") == 1, F.col("v")).otherwise(F.col(f"_v{c}")).alias(c) for c in "rgb"])


def bayer_grayscale(pixels: DataFrame, pattern: Column | str) -> DataFrame:
    """``pixels`` with v the equal-weight mean of the three demosaiced channels; a mosaic has one channel, more are an error."""
    if "channel" in pixels.columns:
        most = pixels.agg(F.max("channel")).first()[0]
        if most:
            raise FrameError(f"a single-channel mosaic is needed, not {most + 1} channels")
    grey = demosaic(pixels, pattern)
    return grey.withColumn("v", (F.col("r") + F.col("g") + F.col("b")) / 3).select(*pixels.columns)
