"""Shared pieces: words and row numbers; running sums, numbering and tables are the library's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ordering import number_in_order, running_sum, unused  # noqa: F401
from ..spool import save  # noqa: F401

#: A word: a run of bytes that are no ASCII white space. ``bytes.split()`` cuts at the same places.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_row_numbers(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``docs`` as a table with a number of each row of its own, and that column's name; doc_id may be null or repeat."""
    row = unused("row_number_of_its_own", docs)
    return save(docs.withColumn(row, F.monotonically_increasing_id()), name, "zstd"), row


#: A key of over one in so many rows is hot: there are fewer such keys than this, whatever the input.
HOT = 1000


def join_counted(rows: DataFrame, info: DataFrame, keys: list[str], copies: str) -> DataFrame:
    """``rows`` with the columns of ``info`` (one row a key, with its number of rows in ``copies``), nulls where there are none.

    Hot keys, of which there are fewer than HOT by count, are broadcast and rows without a key
    stay where they are, so that only rows of other keys are shuffled. Both are tables: they are
    read several times.
    """
    total = info.agg(F.sum(copies)).first()[0] or 0
    hot, cold = (info.where(is_hot).drop(copies) for is_hot in (F.col(copies) * HOT > total, F.col(copies) * HOT <= total))
    without = F.lit(False)
    for key in keys:
        without |= F.col(key).isNull()
    others = rows.where(~without).join(F.broadcast(hot), keys, "left_anti").join(cold, keys, "left")
    return rows.join(F.broadcast(hot), keys).unionByName(others).unionByName(rows.where(without), allowMissingColumns=True)


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    pieces = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    # A leading or trailing separator leaves one empty piece each; an empty text is one empty piece.
    size = F.size(pieces)
    return (size - F.when(F.element_at(pieces, 1) == "", 1).otherwise(0) - F.when((size > 1) & (F.element_at(pieces, -1) == ""), 1).otherwise(0)).cast("long")
