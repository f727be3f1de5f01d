"""Distributed running sums and numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spool import save


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, made longer until none of ``frames`` has such a column (names are compared without case)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def running_sum(df: DataFrame, value: str, groups: list[str], bucket: str, order: list[str], out: str) -> DataFrame:
    """Sum of ``value`` over the rows before each row of its group, in order of (bucket, order).

    No task gets more than the rows of one bucket of one group: sums inside a bucket are added to
    the sums of the group's earlier buckets, of which there is one row a bucket. ``groups`` and
    ``bucket`` hold no nulls. ``df`` is used twice, so it should be a table or cheap to compute.
    """
    total, start = unused("total_of_bucket", df), unused("start_of_bucket", df)
    before = lambda *keys: Window.partitionBy(*keys)
    inside = before(*groups, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = before(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = df.groupBy(*groups, bucket).agg(F.sum(value).alias(total))
    starts = sums.withColumn(start, F.coalesce(F.sum(total).over(across), zero)).drop(total)
    placed = df.withColumn(out, F.coalesce(F.sum(value).over(inside), zero)).join(starts, [*groups, bucket])
    return placed.withColumn(out, (F.col(out) + F.col(start)).cast("long")).drop(start)


def number_in_order(df: DataFrame, order: list, out: str, name: str) -> DataFrame:
    """Numbers 0, 1, 2, ... in the order of the given columns, which should tell all rows apart.

    Rows are dealt by range, so equal leading keys spread; the number of rows before each range
    partition (one row a partition) is added to the place inside it.
    """
    part, one = unused("part_of_range", df), unused("one_each", df)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = save(df.repartitionByRange(n, *order).withColumn(part, F.spark_partition_id()), name)
    numbered = running_sum(dealt.withColumn(one, F.lit(1).cast("long")), one, [], part, order, out)
    return numbered.drop(part, one)
