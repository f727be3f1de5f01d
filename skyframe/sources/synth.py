"""Synthetic frames: flat fields, stars, gradients and mosaics as pixel expressions; seeded noise in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Fixed values of the noise generator, a 64-bit linear congruential one.
FACTOR, ADD = 6364136223846793005, 1442695040888963407


def flat(spark: SparkSession, frame_id: str, width: int, height: int, value: float) -> DataFrame:
    i = F.col("id")
    return spark.range(width * height).select(
        F.lit(frame_id).alias("frame_id"), F.floor(i / width).cast("int").alias("y"), (i % width).cast("int").alias("x"), F.lit(float(value)).alias("v")
    )


def add_star(pixels: DataFrame, cx: float, cy: float, peak: float, sigma_x: float, sigma_y: float | None = None) -> DataFrame:
    sy = sigma_x if sigma_y is None else sigma_y
    e = (F.col("x") - cx) ** 2 / (2 * sigma_x**2) + (F.col("y") - cy) ** 2 / (2 * sy**2)
    return pixels.withColumn("v", F.col("v") + peak * F.exp(-e))


def add_gradient(pixels: DataFrame, by_x: float, by_y: float) -> DataFrame:
    return pixels.withColumn("v", F.col("v") + by_x * F.col("x") + by_y * F.col("y"))


def mosaic(pixels: DataFrame, red: float, green: float, blue: float) -> DataFrame:
    """An RGGB mosaic of three flat levels."""
    odd_x, odd_y = F.col("x") % 2 == 1, F.col("y") % 2 == 1
    return pixels.withColumn("v", F.when(~odd_x & ~odd_y, float(red)).when(odd_x & odd_y, float(blue)).otherwise(float(green)))


def jump(n: int) -> tuple[int, int]:
    """Factor and addend that take the generator ``n`` steps at once: its step, an affine map, squared and multiplied."""
    factor, add, by, plus = 1, 0, FACTOR, ADD
    while n:
        if n & 1:
            factor, add = factor * by % 2**64, (add * by + plus) % 2**64
        by, plus = by * by % 2**64, (plus * by + plus) % 2**64
        n >>= 1
    return factor, add


def noise(seed: int, n: int, start: int = 0) -> np.ndarray:
    """Draws ``start`` to ``start + n`` from [-1, 1], one for each pixel in row-major order.

    States double: once the first 2^k are known, a jump of 2^k gives as many more.
    """
    factor, add = jump(start + 1)
    state = np.empty(n, "u8")
    if n:
        state[0] = (seed * factor + add) % 2**64
    known = 1
    while known < n:
        factor, add = jump(known)
        more = min(known, n - known)
        state[known : known + more] = state[:more] * np.uint64(factor) + np.uint64(add)
        known += more
    return (state >> np.uint64(11)) * 2.0**-53 * 2 - 1


def noise_of_many(seeds: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """:func:`noise` of many seeds, one after the other: a jump serves all that begin at the same draw, and all states double together."""
    first, which = np.unique(starts, return_inverse=True)
    jumps = np.array([jump(int(k) + 1) for k in first], "u8").reshape(-1, 2)
    most = int(counts.max(initial=0))
    state = np.empty((len(seeds), most), "u8")
    if most:
        state[:, 0] = seeds.astype("u8") * jumps[which, 0] + jumps[which, 1]
    known = 1
    while known < most:
        factor, add = jump(known)
        more = min(known, most - known)
        state[:, known : known + more] = state[:, :more] * np.uint64(factor) + np.uint64(add)
        known += more
    return (state[np.arange(most) < counts[:, None]] >> np.uint64(11)) * 2.0**-53 * 2 - 1


def noise_rows(spark: SparkSession, seed: int, n: int, tasks: int | None = None) -> DataFrame:
    """(i, v): the first ``n`` draws; each task jumps to its own first one."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.column(0).to_numpy()  # consecutive in a range
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(noise(seed, len(i), int(i[0])) if len(i) else np.zeros(0))], names=["i", "v"])

    numbers = spark.range(0, n, 1, tasks) if tasks else spark.range(n)
    return numbers.mapInArrow(rows, "i long, v double")


def add_noise(pixels: DataFrame, seed: int, amplitude: float, width: int, height: int) -> DataFrame:
    """``pixels`` with seeded noise, each pixel's draw made where the pixel is."""

    @F.pandas_udf(DoubleType())
    def draw(i: pd.Series) -> pd.Series:
        at = i.to_numpy()
        if not len(at):
            return pd.Series([], dtype="f8")
        low, high = int(at.min()), int(at.max())
        if high - low < 16 * len(at) + 1024:  # near each other: all between
            return pd.Series(noise(seed, high - low + 1, low)[at - low])
        return pd.Series([noise(seed, 1, int(k))[0] for k in at])

    place = F.col("y").cast("long") * width + F.col("x")
    return pixels.withColumn("v", F.col("v") + amplitude * draw(place))


def fits_file(values: np.ndarray, bitpix: int, cut: int | None = None, **cards: object) -> bytes:
    """A FITS file of one image: a header of 80-character cards, then big-endian samples, both padded to 2880 bytes; a card given as None is left out, ``cut`` shortens the data."""
    from .fits import BLOCK, CARD, FORMATS

    known = {"SIMPLE": "T", "BITPIX": bitpix, "NAXIS": 2, "NAXIS1": values.shape[1], "NAXIS2": values.shape[0], **cards}
    text = "".join(f"{k:<8}= {v!s:>20}".ljust(CARD) for k, v in known.items() if v is not None) + "END".ljust(CARD)
    data = values.astype(FORMATS[bitpix]).tobytes()
    return text.ljust(-(-len(text) // BLOCK) * BLOCK).encode() + data.ljust(-(-len(data) // BLOCK) * BLOCK, b"\0")[:cut]
