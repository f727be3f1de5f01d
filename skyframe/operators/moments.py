"""Moments and half-flux radius of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import moment_eccentricity, moment_fwhm


def _outwards(df: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
    """``df`` (_w, _x, _y, _cx, _cy, flux) with radii and running sums, and the half-flux radius as an aggregate over ``keys``.

    It is where the flux summed outwards from the centre first reaches a half, interpolated inside
    the sample that crosses; ties in radius go by row, then column.
    """
    w, dx, dy = F.col("_w"), F.col("_x") - F.col("_cx"), F.col("_y") - F.col("_cy")
    df = df.withColumn("_r", F.sqrt(dx * dx + dy * dy))
    order = Window.partitionBy(*keys).orderBy("_r", "_y", "_x")
    df = df.withColumn("_sum", F.sum("_w").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    df = df.withColumn("_r0", F.coalesce(F.lag("_r").over(order), F.lit(0.0))).withColumn("_n", F.row_number().over(order))
    before = F.when(F.col("_n") == 1, 0.0).otherwise(F.col("_sum") - w)
    part = F.when(w > 0, (F.col("flux") / 2 - before) / F.when(w > 0, w)).otherwise(0.0)
    crossing = F.when(F.col("_sum") >= F.col("flux") / 2, F.struct("_n", (F.col("_r0") + part * (F.col("_r") - F.col("_r0"))).alias("hfr")))
    return df, F.coalesce(F.min(crossing)["hfr"], F.max(F.struct("_n", "_r"))["_r"])


def star_moments(samples: DataFrame, keys: list[str], x: str = "x", y: str = "y", value: str = "v", background: str = "background") -> DataFrame:
    """(keys, x, y, flux, mxx, myy, mxy, fwhm, eccentricity, hfr) of groups of samples; a group without positive flux has no row.

    Weights are value less background and may be negative; the half-flux radius is about the
    centroid. One shuffle: every step works on the groups' own partitioning.
    """
    over = lambda e: F.sum(e).over(Window.partitionBy(*keys))
    w, px, py = F.col("_w"), F.col("_x"), F.col("_y")
    df = samples.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), (F.col(value) - F.col(background)).alias("_w"))
    df = df.withColumn("flux", over(w)).where("flux > 0")
    df = df.withColumn("_cx", over(w * px) / F.col("flux")).withColumn("_cy", over(w * py) / F.col("flux"))
    df, hfr = _outwards(df, keys)
    dx, dy, flux = px - F.col("_cx"), py - F.col("_cy"), F.first("flux")
    out = df.groupBy(*keys).agg(
        F.first("_cx").alias("x"), F.first("_cy").alias("y"), flux.alias("flux"),
        (F.sum(w * dx * dx) / flux).alias("mxx"), (F.sum(w * dy * dy) / flux).alias("myy"), (F.sum(w * dx * dy) / flux).alias("mxy"), hfr.alias("hfr"),
    )
    m = [F.col(c) for c in ("mxx", "myy", "mxy")]
    return out.withColumn("fwhm", moment_fwhm(m[0], m[1])).withColumn("eccentricity", moment_eccentricity(*m)).select(
        *keys, "x", "y", "flux", "mxx", "myy", "mxy", "fwhm", "eccentricity", "hfr"
    )


def half_flux_radius_about(samples: DataFrame, keys: list[str], cx: str = "cx", cy: str = "cy", x: str = "x", y: str = "y", value: str = "v", background: str = "background") -> DataFrame:
    """(keys, hfr) of groups of samples about a given centre (columns ``cx`` and ``cy``) with a given background; 0 without positive flux."""
    df = samples.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), (F.col(value) - F.col(background)).alias("_w"), F.col(cx).cast("double").alias("_cx"), F.col(cy).cast("double").alias("_cy"))
    df, hfr = _outwards(df.withColumn("flux", F.sum("_w").over(Window.partitionBy(*keys))), keys)
    return df.groupBy(*keys).agg(F.when(F.first("flux") > 0, hfr).otherwise(0.0).alias("hfr"))
