"""Sharding by a Feistel permutation of global row numbers (operator 2, DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import running_sum, save, table, unused

ROUNDS = 6
#: Cycle walking ends within so many steps: up to 4096 rows always, beyond that but for a chance under 64 ** -64.
WALK = 64


def permuted(number: Column, n: int, seed: int = 42) -> Column:
    """A keyed permutation of 0..n-1 as a column expression.

    A Feistel network on Z_a x Z_b with a * b just over n (the mixed-radix form, whose halves need
    not be bit strings): six alternating rounds add a keyed hash of one half to the other. Results
    beyond n walk the cycle, that is, are permuted again until they fall below n.
    """
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))

    def once(x: Column) -> Column:
        half = lambda v, r, m: F.pmod(F.xxhash64(v, r, F.lit(seed)), F.lit(m).cast("long"))

        def turn(s: Column, r: Column) -> Column:
            left = F.when(r % 2 == 0, F.pmod(s["l"] + half(s["r"], r, a), F.lit(a).cast("long"))).otherwise(s["l"])
            right = F.when(r % 2 == 1, F.pmod(s["r"] + half(s["l"], r, b), F.lit(b).cast("long"))).otherwise(s["r"])
            return F.struct(left.alias("l"), right.alias("r"))

        start = F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), F.pmod(x, F.lit(b).cast("long")).alias("r"))
        start = start if b > 1 else F.struct(x.cast("long").alias("l"), F.lit(0).cast("long").alias("r"))
        return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), start, turn, lambda s: s["l"] * b + s["r"])

    first = once(number.cast("long"))
    walked = F.aggregate(F.sequence(F.lit(0), F.lit(WALK)), number.cast("long"), lambda x, i: F.when((i > 0) & (x < n), x).otherwise(once(x)))
    return F.when(first < n, first).otherwise(F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long")))


def number_rows(df: DataFrame, key: list[str], out: str = "row_number", buckets: int = 4096, seed: int = 42) -> DataFrame:
    """Global row numbers 0..n-1 that depend on the rows' keys alone, not on files or partitions.

    The order is (hash bucket of the key, key). Rows with equal keys get consecutive numbers in
    any order, which is the same result where the rows are equal. Nulls in a key order first.
    """
    bucket, one = unused("bucket_of_key", df), unused("one_each", df)
    keyed = df.withColumn(bucket, F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(buckets))).withColumn(one, F.lit(1).cast("long"))
    return running_sum(keyed, one, [], bucket, key, out).drop(bucket, one)


def shard_rows(df: DataFrame, key: list[str], n_shards: int, seed: int = 42) -> DataFrame:
    """``df`` with ``row_number``, ``position``, ``shard`` and ``slot`` in place of any columns of these names.

    ``position`` is the permuted row number, ``shard`` is position mod ``n_shards`` and ``slot``
    position div ``n_shards``: shards differ by one row at most, slots have no gaps, and both
    follow from the row number, the row count and the seed alone. All columns of ``df`` travel
    with their rows. ``df`` is read three times, so give a table. No rows give no rows.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    df = df.drop("row_number", "position", "shard", "slot")
    n = df.count()
    numbered = number_rows(df, key, "row_number", seed=seed).withColumn("position", permuted(F.col("row_number"), n, seed))
    return numbered.withColumns(
        {"shard": F.pmod("position", F.lit(n_shards)).cast("int"), "slot": F.floor(F.col("position") / n_shards).cast("long")}
    )


def unshard_position(shard: int, slot: int, n_shards: int) -> int:
    """The permuted position kept at a shard's slot."""
    return slot * n_shards + shard


def op2_shard_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 39 of all documents by the law ``rows``; texts are read once, for size and checksum. Null texts have 16 bytes and checksum 0."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32")
    )
    sharded = shard_rows(save(digest, "shard-digest"), ["doc_id", "size", "text_crc32"], 40)
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number", "position"
    )
