"""Summaries of the stars of each frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def star_field(frames: DataFrame, stars: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, count, median_fwhm, median_hfr, median_eccentricity) of every frame; medians are null where there are no stars."""
    keys = keys or ["frame_id"]
    found = stars.groupBy(*keys).agg(F.count("*").alias("count"), *[F.median(c).alias(f"median_{c}") for c in ("fwhm", "hfr", "eccentricity")])
    return frames.select(*keys).distinct().join(found, keys, "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long")))
