"""Exact medians of any number of groups and values by radix selection.

The bits of a double, as a long in the doubles' order, are counted by their leading sixteen; the
bin that holds the wanted rank is counted by its next sixteen, and so on. Counts merge before they
are shuffled and are at most 65,536 a group and task, however many values a group has; values are
never sorted, kept or sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..spool import discard, save

#: Bits of a pass. Values that a bin may hold for the last pass to count them one by one.
BITS, FEW = 16, 1 << 16


def ordered_bits(v: np.ndarray) -> np.ndarray:
    """Longs in the order of the doubles ``v``; both zeros are one."""
    bits = (np.asarray(v, "f8") + 0.0).view("i8")
    return bits ^ ((bits >> 63) & np.int64(2**63 - 1))


def doubles(bits: np.ndarray) -> np.ndarray:
    """The doubles that :func:`ordered_bits` made these longs from."""
    bits = np.asarray(bits, "i8")
    return (bits ^ ((bits >> 63) & np.int64(2**63 - 1))).view("f8")


@F.pandas_udf(LongType())
def _bits(v: pd.Series) -> pd.Series:
    return pd.Series(ordered_bits(v.to_numpy()))


@F.pandas_udf(DoubleType())
def _doubles(bits: pd.Series) -> pd.Series:
    return pd.Series(doubles(bits.to_numpy()))


def _list_counts(df: DataFrame, shift: int, above: int) -> DataFrame:
    """Counts (k, prefix, bin, n) of the values in the arrays ``v``, less ``about`` if there is such a column, and only of the ``prefixes`` (leading bits from ``above``) if there are."""
    names = df.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(k) for k, n in enumerate(names)}
            rows, bins, counts = [], [], []
            for i in range(batch.num_rows):
                v = column["v"][i].values.to_numpy(zero_copy_only=False).astype("f8")
                v = v[~np.isnan(v)]
                bits = ordered_bits(v if "about" not in column else np.abs(v - column["about"][i].as_py()))
                if "prefixes" in column:
                    bits = bits[np.isin(bits >> above, column["prefixes"][i].values.to_numpy())]
                found, n = np.unique(bits >> shift, return_counts=True)
                rows.append(np.full(len(found), i))
                bins.append(found)
                counts.append(n)
            if rows:
                bin_ = np.concatenate(bins)
                prefix = bin_ >> (above - shift) if "prefixes" in column else np.zeros_like(bin_)
                yield pa.RecordBatch.from_arrays([column["k"].take(pa.array(np.concatenate(rows))), pa.array(prefix), pa.array(bin_), pa.array(np.concatenate(counts).astype("i8"))], names=["k", "prefix", "bin", "n"])

    longs = [StructField(c, LongType()) for c in ("prefix", "bin", "n")]
    return df.mapInArrow(work, StructType([df.schema["k"], *longs])).groupBy("k", "prefix", "bin").agg(F.sum("n").alias("n"))


def _counts(df: DataFrame, shift: int, above: int, lanes: DataFrame | None) -> DataFrame:
    """Counts (k, prefix, bin, n) by the bits from ``shift`` up, of all values or of those whose bits from ``above`` up are a prefix of ``lanes``."""
    if df.schema["v"].dataType.typeName() == "array":
        if lanes is not None:
            df = df.join(lanes.groupBy("k").agg(F.collect_set("prefix").alias("prefixes")), "k")
        return _list_counts(df, shift, above)
    number = F.col("v").cast("double")
    each = df.where(F.col("v").isNotNull() & ~F.isnan("v"))
    each = each.select("k", _bits(F.abs(number - F.col("about")) if "about" in df.columns else number).alias("o"))
    if lanes is None:
        each = each.withColumn("prefix", F.lit(0).cast("long"))
    else:
        each = each.withColumn("prefix", F.shiftright("o", above)).join(lanes.select("k", "prefix").distinct(), ["k", "prefix"], "left_semi")
    return each.groupBy("k", "prefix", F.shiftright("o", shift).alias("bin")).agg(F.count("*").alias("n"))


def _chosen(counts: DataFrame, lanes: DataFrame | None) -> DataFrame:
    """(k, lane, prefix, rank, n): the bin that holds each lane's rank, as its next prefix, and the rank inside it. Without lanes, the two middle ranks of each group."""
    bins = counts.groupBy("k", "prefix").agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias("total"))
    if lanes is None:
        ranks = F.array(F.expr("(total + 1) div 2"), F.expr("(total + 2) div 2"))
        at = bins.select("k", "bins", F.posexplode(ranks).alias("lane", "wanted"))
    else:
        at = bins.join(lanes.select("k", "lane", "prefix", F.col("rank").alias("wanted")), ["k", "prefix"])
    none = F.lit(None).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("seen"), none.alias("bin"), none.alias("rank"), none.alias("n"))
    step = lambda s, b: F.when(
        s["bin"].isNull() & (s["seen"] + b["n"] >= F.col("wanted")),
        F.struct(s["seen"].alias("seen"), b["bin"].alias("bin"), (F.col("wanted") - s["seen"]).alias("rank"), b["n"].alias("n")),
    ).otherwise(F.struct((s["seen"] + b["n"]).alias("seen"), s["bin"].alias("bin"), s["rank"].alias("rank"), s["n"].alias("n")))
    found = at.withColumn("found", F.aggregate("bins", start, step))
    return found.select("k", "lane", F.col("found.bin").alias("prefix"), F.col("found.rank").alias("rank"), F.col("found.n").alias("n"))


def select_middles(df: DataFrame, keys: list[str], value: str, out: str, about: str | None = None) -> DataFrame:
    """(keys, out): the exact median of each group, the mean of the middle two for even counts; of the distances from ``about``, one value a group, if given.

    ``value`` is a number or an array of numbers, of a table, since every pass reads it: two passes
    where no bin of the first holds more than FEW values, four at most. NaN and null don't count;
    groups without values have no row; null keys are a group.
    """
    own = df.select(F.struct(*keys).alias("k"), F.col(value).alias("v"), *([F.col(about).alias("about")] if about else []))
    shift, above, lanes, past = 64 - BITS, 0, None, []
    while True:
        lanes = save(_chosen(_counts(own, shift, above, lanes), lanes), "middles")
        past.append(lanes)
        if not shift:
            break
        most = lanes.agg(F.max("n")).first()[0] or 0
        above, shift = shift, 0 if most <= FEW else shift - BITS
    discard(*past[:-1])
    middle = lanes.withColumn("x", _doubles("prefix")).groupBy("k").agg(F.avg("x").alias(out))
    return middle.select(*[F.col("k")[c].alias(c) for c in keys], out)
