"""A corpus pipeline of five stages: quality, near-duplicates, secrets, mixing and packing."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from skyframe.llm.common import save, table
from skyframe.llm.mixing import mix_documents
from skyframe.llm.packing import pack_documents
from skyframe.llm.quality import keep_good
from skyframe.llm.secret_scan import redact
from skyframe.llm.simhash import keep_first
from skyframe.spool import discard, sweep

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

def _stage(work: Stage) -> Stage:
    """``work`` as a stage, which first frees the tables of earlier ones that nothing reads any more: those behind results that were written and dropped."""

    @wraps(work)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        sweep(spark)
        return work(spark, docs, sf_dir)

    return stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from the labels of documents that are still here, doesn't reject."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return keep_first(docs)


@_stage
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced in their texts."""
    return redact(docs)


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mix_documents(docs)


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with the sequences that they are packed into."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: A learnt classifier and a learnt forest decide, which SQL cannot express; tests hold run() against the stages applied one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each one's result is a table that the next one reads, freed once that one's is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, save(stage(spark, docs, sf_dir), f"stage-{name}")
        if hasattr(before, "saved_path"):
            discard(before)
    del before
    sweep(spark)
    return docs
