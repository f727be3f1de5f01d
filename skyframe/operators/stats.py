"""Robust statistics by frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import MAD_TO_SIGMA, snr_weight
from ..spool import as_table
from .selection import select_middles


def exact_median(df: DataFrame, keys: list[str], value: str, out: str = "median") -> DataFrame:
    """(keys, out): the exact median of each group, the mean of the middle two for even counts; NaN and null don't count, a group without values has no row."""
    return select_middles(as_table(df.select(*keys, value), "values"), keys, value, out)


def median_and_mad(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median, mad): median and median absolute deviation about it, unscaled; NaN and null don't count.

    Both by radix selection: counts of leading bits meet, values don't, whatever the size of a group.
    """
    values = as_table(df, "values")
    centre = select_middles(values, keys, value, "median")
    same = F.lit(True)
    for key in keys:
        same &= F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}"))
    off = values.select(*keys, value).alias("a").join(centre.alias("b"), same).select(*[f"a.{k}" for k in keys], f"a.{value}", "b.median")
    mad = select_middles(off, keys, value, "mad", about="median")
    return centre.alias("a").join(mad.alias("b"), same).select(*[f"a.{k}" for k in keys], "a.median", "b.mad")


def robust_noise(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median, noise): noise is 1.4826 times the MAD."""
    return median_and_mad(df, keys, value).select(*keys, "median", (MAD_TO_SIGMA * F.col("mad")).alias("noise"))


def signal_to_noise(pixels: DataFrame, keys: list[str] | None = None, value: str = "v") -> DataFrame:
    """(keys, noise, weight) of every frame with pixels and noise above 0; weight is for comparing frames."""
    keys = keys or ["frame_id"]
    return robust_noise(pixels, keys, value).where("noise > 0").select(*keys, "noise", snr_weight(F.col("noise")).alias("weight"))
