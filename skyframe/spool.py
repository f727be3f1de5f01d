"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

from .errors import FrameError

#: Files of a shuffle go when the execution that made them ends, not when the driver happens to collect its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_folder: list[str] = []
_lock = threading.RLock()
#: Of each table that save() wrote: the session's context and a JVM weak reference to what plans read it by.
_tables: dict[str, tuple[object, JavaObject]] = {}
#: Sessions that write tables just now, how many at once, and what FREE_SHUFFLES was before.
_writing: dict[int, list] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``.

    Where it is unset a local session, whose executors are the driver, gets a folder of its own; a cluster is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local["):
        raise FrameError("set spark.checkpoint.dir to a folder that driver and executors share")
    with _lock:
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="skyframe-"))
            atexit.register(shutil.rmtree, _own_folder[0], True)
    return _own_folder[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    with _lock:
        state = _writing.setdefault(id(spark), [0, None])
        if not state[0]:
            state[1] = spark.conf.get(FREE_SHUFFLES, None)
            spark.conf.set(FREE_SHUFFLES, "true")
        state[0] += 1
    try:
        yield
    finally:
        with _lock:
            state[0] -= 1
            if not state[0]:
                if state[1] is None:
                    spark.conf.unset(FREE_SHUFFLES)
                else:
                    spark.conf.set(FREE_SHUFFLES, state[1])
                _writing.pop(id(spark))


def save(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here and nothing is computed twice.

    ``compression`` is a Parquet codec where the session's own isn't wanted, such as zstd for copies of texts.
    The table stays until :func:`discard`, or until :func:`sweep` finds that no plan reads it any more.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with _freeing_shuffles(spark):
        df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path = path
    relation = out._jdf.queryExecution().analyzed().relation()
    with _lock:
        _tables[path] = (spark.sparkContext, spark.sparkContext._jvm.java.lang.ref.WeakReference(relation))
    return out


def as_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` itself where :func:`save` returned it, else saved: for what is read several times."""
    return df if hasattr(df, "saved_path") else save(df, name)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    with _lock:
        _tables.pop(path, None)


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`save` returned and that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df.saved_path)


def sweep(spark: SparkSession) -> None:
    """Delete the saved tables that no DataFrame reads any more, neither one that :func:`save` returned nor one made from it, in whatever thread.

    Every plan that reads a table holds its relation in the JVM; once that is garbage, so is the table.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    with _lock:
        gone = [path for path, (context, relation) in _tables.items() if context is spark.sparkContext and relation.get() is None]
    for path in gone:
        _delete(spark, path)


def saved_tables(spark: SparkSession) -> list[str]:
    """Paths of the tables that are still there."""
    with _lock:
        return [path for path, (context, _) in _tables.items() if context is spark.sparkContext]
