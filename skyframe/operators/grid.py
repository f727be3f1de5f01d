"""Pixels as rows: building, cropping, local maxima and square windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..quarantine import Quarantine, set_aside


def sound_frames(frames: DataFrame, quarantine: Quarantine | None = None) -> DataFrame:
    """``frames`` (width, height, values, maybe channels) whose sample count is width * height (* channels); the others go to ``quarantine`` or raise."""
    channels = F.col("channels") if "channels" in frames.columns else F.lit(1)
    fits = (F.size("values") == F.col("width").cast("long") * F.col("height") * channels) & (F.col("width") > 0) & (F.col("height") > 0)
    return set_aside(frames, F.when(~F.coalesce(fits, F.lit(False)), F.lit("pixel count does not match the geometry")), "buffer", quarantine)


def pixels_from_arrays(frames: DataFrame, quarantine: Quarantine | None = None) -> DataFrame:
    """(frame_id, y, x, v) of frames that hold their row-major samples in ``values``, with width and height.

    Where ``frames`` has channels, samples lie channel by channel at each place and rows have a
    column ``channel`` before v. A frame whose sample count isn't width * height (* channels) goes
    to ``quarantine``, or is an error.
    """
    many = "channels" in frames.columns
    channels = F.col("channels") if many else F.lit(1)
    each = sound_frames(frames, quarantine).select("frame_id", "width", channels.alias("n"), F.posexplode("values").alias("i", "v")).withColumn("at", F.expr("i div n"))
    place = [F.expr("at div width").cast("int").alias("y"), (F.col("at") % F.col("width")).cast("int").alias("x")]
    return each.select("frame_id", *place, *([(F.col("i") % F.col("n")).cast("int").alias("channel")] if many else []), F.col("v").cast("double"))


def linear_index(y: Column, x: Column, width: Column) -> Column:
    return y.cast("long") * width + x


def crop(pixels: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """A sub-image with its own origin; the ranges reach a Parquet scan."""
    inside = F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1)
    return pixels.where(inside).withColumn("x", F.col("x") - x).withColumn("y", F.col("y") - y)


def frames_of(pixels: DataFrame) -> DataFrame:
    """(frame_id, width, height, channels) of dense single-channel pixels."""
    return pixels.groupBy("frame_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height")).withColumn("channels", F.lit(1))


def require_single_channel(frames: DataFrame, quarantine: Quarantine | None = None) -> DataFrame:
    """``frames`` of one channel; the others go to ``quarantine`` or raise."""
    message = F.concat(F.lit("a single-channel frame is needed, not "), F.col("channels").cast("string"), F.lit(" channels"))
    return set_aside(frames, F.when(F.col("channels") != 1, message), "channels", quarantine)


def local_maxima(pixels: DataFrame, threshold: Column, value: str = "v") -> DataFrame:
    """Rows of ``pixels`` above the threshold and above all of their up to eight neighbours.

    Only pixels above the threshold can be or veto a maximum, so only they are dealt out: each
    goes to its own place and those of its neighbours, where the largest neighbour is compared.
    Equal neighbours veto each other, missing ones don't; a NaN is none and vetoes. Other columns
    of ``pixels`` are kept.
    """
    others = [c for c in pixels.columns if c not in ("frame_id", "y", "x")]
    bright = pixels.where(F.col(value) > threshold)
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    sent = bright.withColumn("_o", F.explode(offsets))
    own = (F.col("_o.dy") == 0) & (F.col("_o.dx") == 0)
    placed = sent.select(
        "frame_id", (F.col("y") + F.col("_o.dy")).alias("y"), (F.col("x") + F.col("_o.dx")).alias("x"),
        F.when(~own, F.col(value)).alias("_near"), *[F.when(own, F.col(c)).alias(c) for c in others], own.alias("_own"),
    )
    met = placed.groupBy("frame_id", "y", "x").agg(F.max("_near").alias("_near"), F.max("_own").alias("_own"), *[F.max(c).alias(c) for c in others])
    return met.where(F.col("_own") & ~F.isnan(value) & (F.col("_near").isNull() | (F.col(value) > F.col("_near")))).select(*pixels.columns)


def square_windows(peaks: DataFrame, pixels: DataFrame, radius: Column | int) -> DataFrame:
    """The pixels within ``radius`` rows and columns of each peak, clipped to the frame: columns of ``peaks`` and dy, dx, v.

    An equi-join on the pixel's place; peaks are few, so Spark may broadcast them if they measure small.
    """
    radius = radius if isinstance(radius, Column) else F.lit(radius)
    wide = peaks.withColumn("_r", radius.cast("int"))
    wide = wide.withColumn("dy", F.explode(F.sequence(-F.col("_r"), F.col("_r")))).withColumn("dx", F.explode(F.sequence(-F.col("_r"), F.col("_r")))).drop("_r")
    wide = wide.withColumn("_y", F.col("y") + F.col("dy")).withColumn("_x", F.col("x") + F.col("dx"))
    there = pixels.select(F.col("frame_id").alias("_f"), F.col("y").alias("_py"), F.col("x").alias("_px"), F.col("v").alias("v"))
    on = (F.col("frame_id") == F.col("_f")) & (F.col("_y") == F.col("_py")) & (F.col("_x") == F.col("_px"))
    return wide.join(there, on).drop("_f", "_py", "_px", "_y", "_x")
