"""FITS files as a Spark data source: ``spark.read.format("fits")`` reads bands of rows by byte range, ``df.write.format("fits")`` writes files.

Partitions are planned from header blocks alone. A partition holds bands, runs of an image's rows
with a rim of rows above and below, so that a file of any size goes through several tasks, each
with a band's memory, and small files share a task. Filters on frame_id, y and y_end pick bands
before anything but headers is read. A file that can't be used is a row with a message.
"""

from __future__ import annotations

import fnmatch
import operator
import uuid
from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

from ..operators.bands import BAND_PIXELS, RIM, band_rows
from .fits import Image, find_image

#: One row for each band of a frame; ``v`` has ``top`` rim rows, the band's own rows from y to y_end and the rim below. A bad file is one row with a message.
BANDS = "frame_id string, width int, height int, bayerpat string, y int, y_end int, top int, v array<double>, message string"
#: Pixels and bands that share a task at most; headers that are read at once.
TASK_PIXELS, TASK_BANDS, AT_ONCE = 1 << 22, 512, 32
#: Pixels of small bands that leave a task as one batch.
BATCH_PIXELS = 1 << 18
_COMPARE = {ds.EqualTo: operator.eq, ds.GreaterThan: operator.gt, ds.GreaterThanOrEqual: operator.ge, ds.LessThan: operator.lt, ds.LessThanOrEqual: operator.le}


def system_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of ``path`` and the path in it; nothing is listed."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def files_at(path: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    """The file system of ``path`` and the files that it names: one, those of a folder, or those of a glob in a folder."""
    system, at = system_of(path)
    if "*" in at or "?" in at:
        folder, pattern = at.rsplit("/", 1)
        found = [f for f in system.get_file_info(fs.FileSelector(folder)) if fnmatch.fnmatchcase(f.base_name, pattern)]
    else:
        one = system.get_file_info(at)
        found = system.get_file_info(fs.FileSelector(at)) if one.type == fs.FileType.Directory else [one]
    return system, sorted((f for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))), key=lambda f: f.path)


@dataclass(frozen=True)
class Band:
    """A band of a file: own rows y to y_end, read with a rim."""

    path: str
    image: Image | None
    y: int = 0
    y_end: int = 0
    rim: int = 0
    message: str | None = None

    @property
    def span(self) -> tuple[int, int]:
        return max(0, self.y - self.rim), min(self.image.height, self.y_end + self.rim) if self.image else 0

    @property
    def pixels(self) -> int:
        return (self.span[1] - self.span[0]) * self.image.width if self.image else 0


@dataclass
class Bands(ds.InputPartition):
    bands: list[Band]


class FitsReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.rim, self.most = options["path"], int(options.get("rim", RIM)), int(options.get("bandpixels", BAND_PIXELS))
        self.tests: list[tuple[str, object, object]] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:  # noqa: N802
        """Filters on the three columns that are known before a band is read are applied here; the others are Spark's."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in ("frame_id", "y", "y_end") and type(f) in _COMPARE:
                self.tests.append((column, _COMPARE[type(f)], f.value))
            elif column in ("frame_id", "y", "y_end") and isinstance(f, ds.In):
                self.tests.append((column, lambda a, values: a in values, tuple(f.value)))
            else:
                yield f

    def wanted(self, band: Band) -> bool:
        values = {"frame_id": band.path, "y": band.y if band.image else None, "y_end": band.y_end if band.image else None}
        return all(values[c] is not None and test(values[c], value) for c, test, value in self.tests)

    def bands(self, system: fs.FileSystem, file: fs.FileInfo) -> list[Band]:
        """The bands of one file, of which header blocks are read."""
        try:
            with system.open_input_file(file.path) as f:
                image = find_image(lambda at, n: f.read_at(n, at), file.size)
        except (ValueError, OSError) as e:
            return [Band(file.path, None, message=str(e))]
        rows = band_rows(image.width, self.rim, self.most)
        return [Band(file.path, image, y, min(y + rows, image.height), self.rim) for y in range(0, image.height, rows)]

    def partitions(self) -> Sequence[Bands]:
        system, files = files_at(self.path)
        named = [f for f in files if all(test(f.path, value) for c, test, value in self.tests if c == "frame_id")]
        out: list[Bands] = []
        with ThreadPoolExecutor(AT_ONCE) as pool:
            size = 0
            for own in pool.map(lambda f: self.bands(system, f), named):
                for band in filter(self.wanted, own):
                    size += band.pixels
                    if not out or size > TASK_PIXELS or len(out[-1].bands) >= TASK_BANDS:
                        out.append(Bands([]))
                        size = band.pixels
                    out[-1].bands.append(band)
        return out or [Bands([])]

    def read(self, partition: Bands) -> Iterator[pa.RecordBatch]:
        system = system_of(self.path)[0]  # a listing here would be one of all files in every task
        names = [c.split()[0] for c in BANDS.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.string()]
        rows, held = [], 0
        for band in partition.bands:
            row: list = [band.path, None, None, None, None, None, None, None, band.message]
            if band.image:
                image, (first, last) = band.image, band.span
                try:
                    with system.open_input_file(band.path) as f:
                        data = f.read_at((last - first) * image.row_bytes, image.offset + first * image.row_bytes)
                    row[1:8] = [image.width, image.height, image.pattern, band.y, band.y_end, band.y - first, image.linear(data).ravel()]
                    held += band.pixels
                except (ValueError, OSError) as e:  # a file that has changed since it was planned
                    row[8] = str(e)
            rows.append(row)
            if held >= BATCH_PIXELS or band is partition.bands[-1]:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows, held = [], 0


def bands_of_files(files: DataFrame, rim: int = RIM, band_pixels: int = BAND_PIXELS) -> DataFrame:
    """BANDS of ``files`` (path, content), such as a stream's: for files that arrive whole."""
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.string()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                view = memoryview(content.as_buffer()) if content.is_valid else memoryview(b"")
                try:
                    image = find_image(lambda at, n: bytes(view[at : at + n]), len(view))  # noqa: B023
                except ValueError as e:
                    bands = [[path, None, None, None, None, None, None, None, str(e)]]
                else:
                    step = band_rows(image.width, rim, band_pixels)
                    bands = ([path, image.width, image.height, image.pattern, y, min(y + step, image.height), y - max(0, y - rim), _rows(image, view, max(0, y - rim), min(image.height, y + step + rim)), None] for y in range(0, image.height, step))
                for row in bands:
                    yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], names=[c.split()[0] for c in BANDS.split(", ")])

    return files.select("path", "content").mapInArrow(rows, BANDS)


def _rows(image: Image, view: memoryview, first: int, last: int) -> np.ndarray:
    return image.linear(view[image.offset + first * image.row_bytes : image.offset + last * image.row_bytes])


class FitsWriter(ds.DataSourceArrowWriter):
    """Writes each row's ``content`` to the file ``path`` in the folder, by way of another name, so that a task that runs twice leaves one whole file."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.folder = options["path"]
        system, at = self.place()
        system.create_dir(at)
        if overwrite:
            system.delete_dir_contents(at)

    def place(self) -> tuple[fs.FileSystem, str]:
        return system_of(self.folder)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> ds.WriterCommitMessage:
        system, at = self.place()
        for batch in iterator:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                part = f"{at}/.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as f:
                    f.write(content.as_buffer() if content.is_valid else b"")
                system.move(part, f"{at}/{name.as_py()}")
        return ds.WriterCommitMessage()


class FitsSource(ds.DataSource):
    """Options: path (a file, a folder or a glob; local or a URI that Arrow knows), rim (rows above and below a band), bandPixels (of a band at most)."""

    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> str:
        return BANDS

    def reader(self, schema: StructType) -> FitsReader:
        return FitsReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: StructType, overwrite: bool) -> FitsWriter:
        return FitsWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let it see filters."""
    spark.dataSource.register(FitsSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_bands(spark: SparkSession, path: str, rim: int = RIM, band_pixels: int = BAND_PIXELS) -> DataFrame:
    """Bands of all rows of the files at ``path``, bad files as rows with a message."""
    register(spark)
    return spark.read.format("fits").option("rim", rim).option("bandPixels", band_pixels).load(path)


def write_files(files: DataFrame, folder: str) -> None:
    """Write ``files`` (path, content) into ``folder``, which driver and executors share."""
    register(files.sparkSession)
    files.select("path", "content").write.format("fits").mode("append").save(folder)


