"""Ordering and separating peaks, and matching stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StructField, StructType

from ..ordering import unused
from ..spool import discard, save


def rank_peaks(peaks: DataFrame, value: str, out: str = "rank") -> DataFrame:
    """Places 1, 2, ... by falling value within each frame; ties by row, then column."""
    return peaks.withColumn(out, F.row_number().over(Window.partitionBy("frame_id").orderBy(F.desc(value), "y", "x")))


def separate(peaks: DataFrame, value: str, distance: Column | float, tile: int = 64) -> DataFrame:
    """Walk each frame's peaks by falling value and keep those with no kept one nearer than ``distance``, which is one value a frame.

    Ties go by row, then column. Rounds of tiles, ``tile`` distances wide, with rims a distance
    wide: a tile walks its peaks and decides those whose stronger neighbours are all decided; the
    next round's tiles lie half a tile further, so what a border left open is inside. The
    strongest open peak is always decided, so rounds end. A task holds the peaks of tiles, which
    their pixels bound, never a frame's. Other columns are kept.
    """
    names, kept, far = peaks.columns, unused("is_kept", peaks), unused("separation_of_frame", peaks)
    distance = distance if isinstance(distance, Column) else F.lit(float(distance))
    ty, tx, home = (unused(c, peaks) for c in ("tile_row", "tile_column", "is_home"))
    live, turn = peaks.withColumn(far, distance.cast("double")).withColumn(kept, F.lit(False)), 0
    items, stay, sure_ = "items", "stay", "sure"

    def walk(v: np.ndarray, y: np.ndarray, x: np.ndarray, limit: float, sure: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Which of a tile's peaks are still there; ``sure``, changed in place, says which of them are decided."""
        size, cells, there = max(limit, 1.0), {}, np.ones(len(v), bool)
        for i in np.lexsort((x, y, -v)).tolist():
            py, px = int(y[i]), int(x[i])
            by, bx = int(py // size), int(px // size)
            if not sure[i]:
                near = (k for cy in (by - 1, by, by + 1) for cx in (bx - 1, bx, bx + 1) for qy, qx, k in cells.get((cy, cx), ()) if (py - qy) ** 2 + (px - qx) ** 2 < limit * limit)
                states = {bool(sure[k]) for k in near}
                there[i] = True not in states
                sure[i] = own[i] and not states
            if there[i]:
                cells.setdefault((by, bx), []).append((py, px, i))
        return there

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat, ends = lists.flatten(), np.cumsum([0, *lists.value_lengths().to_pylist()])
            v, y, x, limit, sure, own = (flat.field(c).to_numpy(zero_copy_only=False).copy() for c in (value, "y", "x", far, kept, home))
            there = np.ones(len(v), bool)
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                there[a:b] = walk(v[a:b], y[a:b], x[a:b], float(limit[a]), sure[a:b], own[a:b])
            offsets = pa.array(ends.astype("i4"))
            yield pa.RecordBatch.from_arrays([lists, *(pa.ListArray.from_arrays(offsets, pa.array(m)) for m in (there & own, sure.astype(bool)))], names=[items, stay, sure_])

    while True:
        side, reach = tile * F.greatest(F.col(far), F.lit(1.0)), F.greatest(F.col(far), F.lit(0.0))
        start = (turn % 2) * side / 2
        at = lambda c, off=0: F.floor((F.col(c) + start + off) / side).cast("long")  # noqa: B023, E731
        dealt = live.withColumn(ty, F.explode(F.sequence(at("y", -reach), at("y", reach)))).withColumn(tx, F.explode(F.sequence(at("x", -reach), at("x", reach))))
        dealt = dealt.withColumn(home, (F.col(ty) == at("y")) & (F.col(tx) == at("x")))
        # A tile is a list, which its pixels bound, and a task walks many lists.
        lists = dealt.groupBy("frame_id", ty, tx).agg(F.collect_list(F.struct(*[F.col(c) for c in [*live.columns, home]])).alias(items)).select(items)
        walked = lists.mapInArrow(tiles, StructType([lists.schema[items], *[StructField(c, ArrayType(BooleanType())) for c in (stay, sure_)]]))
        each = walked.select(F.explode(F.arrays_zip(items, stay, sure_)).alias("p")).where(f"p.{stay}")
        past, live = live, save(each.select(*[F.col(f"p.{items}.`{c}`").alias(c) for c in [*names, far]], F.col(f"p.{sure_}").alias(kept)), "separated")
        if turn:
            discard(past)
        if not live.where(~F.col(kept)).limit(1).count():
            return live.select(*names)
        turn += 1


def matched(expected: DataFrame, stars: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Rows of ``expected`` (frame_id, x, y) with a star less than ``tolerance`` away in each axis: an equi-join on cells of that size."""
    cell = lambda c: F.floor(F.col(c) / tolerance).cast("long")
    numbered = expected.withColumn("_bx", F.explode(F.sequence(cell("x") - 1, cell("x") + 1))).withColumn("_by", F.explode(F.sequence(cell("y") - 1, cell("y") + 1)))
    there = stars.select(F.col("frame_id").alias("_f"), F.col("x").alias("_sx"), F.col("y").alias("_sy"), cell("x").alias("_cx"), cell("y").alias("_cy"))
    on = (F.col("frame_id") == F.col("_f")) & (F.col("_bx") == F.col("_cx")) & (F.col("_by") == F.col("_cy"))
    near = (F.abs(F.col("x") - F.col("_sx")) < tolerance) & (F.abs(F.col("y") - F.col("_sy")) < tolerance)
    return numbered.join(there, on & near, "left_semi").select(*expected.columns).distinct()
