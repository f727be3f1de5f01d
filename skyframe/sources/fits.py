"""FITS files as frames and pixels."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bayer import PATTERNS, bayer_grayscale

#: Fixed values of the format: block and card sizes, and the sample formats by BITPIX.
BLOCK, CARD = 2880, 80
_NUMBER = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[EDed][+-]?[0-9]+)?")
#: No file is longer, and no header has more axes, whatever its numbers say.
MOST, MOST_AXES = 2**40, 999
FORMATS = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}

DECODED = "frame_id string, width int, height int, bayerpat string, message string, rows array<struct<y:int,v:array<double>>>"


def parse_cards(block: bytes, header: dict[str, str]) -> bool:
    """Add the keyword values of a header block as written (strings keep their quotes); whether the header ends in it."""
    for at in range(0, len(block) - CARD + 1, CARD):
        card = block[at : at + CARD].decode("latin-1")
        key, value = card[:8].strip(), card[8:]
        if key == "END":
            return True
        if value.startswith("= "):
            text = value[2:].strip()
            if text.startswith("'"):
                end = text.find("'", 1)
                text = f"'{text[1:end].rstrip()}'" if end > 0 else text
            else:
                text = text.split("/", 1)[0].strip()
            header.setdefault(key, text)
    return False


def number(header: dict[str, str], key: str) -> float | None:
    """A whole or decimal keyword value; None where it is missing or anything else, such as a quoted number."""
    value = header.get(key, "")
    return float(value.upper().replace("D", "E")) if _NUMBER.fullmatch(value) else None


def _whole(header: dict[str, str], key: str, missing: int = 0) -> int:
    """A keyword value as a whole number, ``missing`` where it is none; nothing in a file is longer than MOST."""
    value = number(header, key)
    return int(max(-MOST, min(MOST, value))) if value is not None else missing


@dataclass(frozen=True)
class Image:
    """A file's image: its size, where its samples begin, and how they become linear values."""

    width: int
    height: int
    bitpix: int
    zero: float
    scale: float
    pattern: str | None
    offset: int

    @property
    def row_bytes(self) -> int:
        return self.width * abs(self.bitpix) // 8

    def linear(self, data: bytes) -> np.ndarray:
        """Linear values of whole rows of samples, row after row."""
        return self.zero + self.scale * np.frombuffer(data, FORMATS[self.bitpix]).astype("f8")


def find_image(read: Callable[[int, int], bytes], size: int) -> Image:
    """The image of a file of ``size`` bytes, of which ``read(offset, length)`` gets header blocks only; ValueError says what is wrong with it."""
    at = 0
    while at < size:
        header: dict[str, str] = {}
        while True:
            block = read(at, min(BLOCK, size - at))
            at += BLOCK
            if parse_cards(block, header):
                break
            if len(block) < BLOCK or at >= size:
                raise ValueError("FITS file contains no image data")
        axes = [_whole(header, f"NAXIS{k}") for k in range(1, min(_whole(header, "NAXIS"), MOST_AXES) + 1)]
        samples = prod(max(0, a) for a in axes) if axes else 0
        length = abs(_whole(header, "BITPIX", 8)) // 8 * (samples + _whole(header, "PCOUNT")) * max(1, _whole(header, "GCOUNT", 1))
        # A unit with axes that are no size is still the image: its geometry is then the error.
        if at < size and (length > 0 or axes):
            return _image(header, at, min(size - at, -(-length // BLOCK) * BLOCK if length > 0 else size))
    raise ValueError("FITS file contains no image data")


def _image(header: dict[str, str], offset: int, available: int) -> Image:
    bitpix = number(header, "BITPIX")
    if bitpix not in FORMATS:
        raise ValueError("missing or unsupported BITPIX")
    width, height = number(header, "NAXIS1") or 0.0, number(header, "NAXIS2") or 0.0
    if not (0 < width <= MOST and 0 < height <= MOST):
        raise ValueError("missing or empty image geometry")
    if available < int(width) * int(height) * abs(int(bitpix)) // 8:
        raise ValueError("image data is shorter than its geometry")
    zero, scale = number(header, "BZERO") or 0.0, number(header, "BSCALE")
    pattern = header.get("BAYERPAT", "")
    pattern = pattern[1:-1].rstrip() if pattern.startswith("'") else None
    if pattern is not None and pattern not in PATTERNS:
        raise ValueError(f"unsupported Bayer pattern: {pattern}")
    return Image(int(width), int(height), int(bitpix), zero, 1.0 if scale is None else scale, pattern, offset)


def decode(content: bytes | None) -> tuple[int, int, str | None, np.ndarray]:
    """Width, height, mosaic and linear samples of a file's image, one plane; ValueError says what is wrong with it."""
    view = memoryview(content or b"")
    image = find_image(lambda at, n: bytes(view[at : at + n]), len(view))
    data = view[image.offset : image.offset + image.height * image.row_bytes]
    return image.width, image.height, image.pattern, image.linear(data).reshape(image.height, image.width)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("y", pa.int32()), ("v", pa.list_(pa.float64()))]))
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            width = height = pattern = message = None
            chunks: list = [[]]
            try:
                width, height, pattern, values = decode(content.as_py())
                step = max(1, 250_000 // width)  # of rows that leave at once
                chunks = [[{"y": y, "v": values[y]} for y in range(a, min(a + step, height))] for a in range(0, height, step)]
            except ValueError as e:
                message = str(e)
            for chunk in chunks:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([width], pa.int32()), pa.array([height], pa.int32()), pa.array([pattern], pa.string()), pa.array([message], pa.string()), pa.array([chunk], kind)],
                    names=["frame_id", "width", "height", "bayerpat", "message", "rows"],
                )


def decode_files(files: DataFrame) -> DataFrame:
    """Decoded parts of ``files`` (path, content): a row for each run of image rows, or one with a message."""
    return files.select("path", "content").mapInArrow(_decoded, DECODED)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder, or those that a glob names, for :func:`decode_files`."""
    return spark.read.format("binaryFile").load(path)


def frames_and_errors(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frames, errors) of decoded parts."""
    frames = decoded.where("message is null").select("frame_id", "width", "height", F.lit(1).alias("channels"), F.lit(False).alias("is_normalized"), "bayerpat").distinct()
    return frames, decoded.where("message is not null").select("frame_id", "message")


def linear_pixels(decoded: DataFrame) -> DataFrame:
    """Physical linear values; of colour files the mosaic."""
    rows = decoded.where("message is null").select("frame_id", "bayerpat", F.explode("rows").alias("r"))
    return rows.select("frame_id", F.col("r.y").alias("y"), F.posexplode("r.v").alias("x", "v"), "bayerpat")


def detection_pixels(decoded: DataFrame) -> DataFrame:
    """Single-channel pixels to detect stars in: linear values, mosaics turned grey."""
    linear = linear_pixels(decoded)
    grey = bayer_grayscale(linear.where("bayerpat is not null"), F.col("bayerpat"))
    return linear.where("bayerpat is null").unionByName(grey).select("frame_id", "y", "x", "v")
