"""Frames as they arrive, each batch exactly once: every operator works by frame, so batches need no state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import snr_weight
from ..operators.bands import COLUMNS, band_noise
from ..operators.mosaic import grey_bands
from ..plans.detect import MatchedFilterDetector
from ..quarantine import Quarantine
from ..sources.fits_source import bands_of_files
from ..spool import save, sweep

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def arriving_files(spark: SparkSession, folder: str) -> DataFrame:
    """FITS files as a stream."""
    return spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.fit*").load(folder)


def write_batch(files: DataFrame, number: int, work: Callable[[DataFrame], DataFrame], out: str) -> None:
    """What ``work`` makes of the detection bands of a batch of files, as partition batch=<number> of the Parquet table ``out``, and the files that can't be used in ``out``-errors.

    A batch that comes again overwrites its own partitions, so each counts once. The tables that it
    was computed from are freed.
    """
    spark, quarantine = files.sparkSession, Quarantine()
    bands = save(bands_of_files(files), "arrived")
    quarantine.add("decode", bands.where("message is not null"))
    grey = grey_bands(bands.where("message is null"), quarantine=quarantine).select(*COLUMNS)
    work(save(grey, "arrived-grey")).write.mode("overwrite").parquet(f"{out}/batch={number}")
    quarantine.rows(spark).write.mode("overwrite").parquet(f"{out}-errors/batch={number}")
    del bands, grey, quarantine
    sweep(spark)


def each_batch(files: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """:func:`write_batch` for every batch of the stream ``files``."""
    return files.writeStream.foreachBatch(lambda df, number: write_batch(df, number, work, out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def noise_of_frames(bands: DataFrame) -> DataFrame:
    """(frame_id, noise, weight) of frames with noise."""
    return band_noise(bands).where("noise > 0").select("frame_id", "noise", snr_weight(F.col("noise")).alias("weight"))


def score_frames(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Noise and weight of every frame that has arrived."""
    return each_batch(arriving_files(spark, folder), noise_of_frames, out, checkpoint)


def detect_arriving(spark: SparkSession, folder: str, out: str, checkpoint: str, detector: MatchedFilterDetector | None = None) -> StreamingQuery:
    """Stars of every frame that has arrived."""
    return each_batch(arriving_files(spark, folder), (detector or MatchedFilterDetector()).detect, out, checkpoint)
