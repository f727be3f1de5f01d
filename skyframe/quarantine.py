"""Frames that can't be used, as rows: every stage sets its own aside and the others go on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import FrameError


class Quarantine:
    """Collects (frame_id, stage, message). A stage that is given none raises the first of its messages instead."""

    def __init__(self) -> None:
        self.parts: list[DataFrame] = []

    def add(self, stage: str, bad: DataFrame) -> None:
        """Set aside the frames of ``bad`` (frame_id, message), of any type of id."""
        self.parts.append(bad.select(F.col("frame_id").cast("string").alias("frame_id"), F.lit(stage).alias("stage"), F.col("message").cast("string").alias("message")))

    def rows(self, spark: SparkSession) -> DataFrame:
        """All that was set aside; a frame may be there for several stages, once each."""
        if not self.parts:
            return spark.createDataFrame([], "frame_id string, stage string, message string")
        return reduce(DataFrame.unionByName, self.parts).distinct()


def set_aside(df: DataFrame, message: F.Column, stage: str, quarantine: Quarantine | None) -> DataFrame:
    """``df`` (with frame_id) without rows for which ``message`` isn't null; these go to ``quarantine``, or one of them is raised."""
    told = df.withColumn("_message", message)
    bad = told.where("_message is not null").select("frame_id", F.col("_message").alias("message"))
    if quarantine is not None:
        quarantine.add(stage, bad)
    elif found := bad.first():
        raise FrameError(found.message)
    return told.where("_message is null").drop("_message")
