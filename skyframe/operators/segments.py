"""Connected bodies of bright samples: labelled inside bands, joined over their borders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..components import connected_components
from ..spool import discard, save
from .bands import TOGETHER as SAMPLES_TOGETHER
from .bands import frame_noise
from .cutouts import TOGETHER, Windows, half_flux_radius_about

#: Of a part of a body, what a band knows: its samples, their weight above the background, weighted means and spreads, and the brightest.
PART = "label int, area long, flux double, cx double, cy double, sxx double, syy double, sxy double, peak double, peak_y int, peak_x int"


def labelled(bright: np.ndarray) -> np.ndarray:
    """0 for dark samples, else the number of the 8-connected body, from 1 in order of its first sample."""
    wide = bright.shape[1] + 1  # a dark column behind each row ends its runs
    flat = np.pad(bright, [(0, 0), (0, 1)]).ravel()
    start, end = np.flatnonzero(np.diff(flat, prepend=False)).reshape(-1, 2).T
    # Runs of the row below touch from one column before to one behind, over a corner, too.
    first, last = np.searchsorted(end, start + wide), np.searchsorted(start, end + wide, "right")
    count = np.maximum(last - first, 0)
    above = np.repeat(np.arange(len(start)), count)
    below = np.arange(len(above)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    root = np.arange(len(start))
    while len(above):
        np.minimum.at(root, np.maximum(above, below), np.minimum(above, below))
        while (root[root] != root).any():
            root = root[root]
        above, below = root[above], root[below]
        above, below = above[above != below], below[above != below]
    _, number = np.unique(root, return_inverse=True)
    out = np.zeros(len(flat), "i8")
    out[flat] = np.repeat(number + 1, end - start)
    return out.reshape(-1, wide)[:, :-1]


def parts_of(v: np.ndarray, labels: np.ndarray, background: float | np.ndarray, first_row: int, start: int | np.ndarray = 0) -> dict[str, np.ndarray]:
    """PART of each body of a band's own rows. ``background`` and ``start``, the row that counts as 0, may be arrays that have one value for each row of ``v``."""
    n = int(labels.max(initial=0))
    row, x = np.nonzero(labels)
    per_row = lambda a: np.broadcast_to(a, len(v))[row]
    own, y, label = v[row, x], row - per_row(start), labels[row, x] - 1
    w = own - per_row(background)
    total = lambda a: np.bincount(label, a, n)
    flux = total(w)
    with np.errstate(all="ignore"):
        cx, cy = total(w * x) / flux, total(w * y) / flux
    dx, dy = x - cx[label], y - cy[label]
    peak = np.full(n, -np.inf)
    np.maximum.at(peak, label, own)
    brightest = np.flatnonzero(own == peak[label])
    top = brightest[np.unique(label[brightest], return_index=True)[1]]  # samples lie by row, then column
    return {
        "label": np.arange(1, n + 1), "area": np.bincount(label, minlength=n), "flux": flux, "cx": cx, "cy": cy + first_row, "sxx": total(w * dx * dx), "syy": total(w * dy * dy), "sxy": total(w * dx * dy),
        "peak": peak, "peak_y": y[top] + first_row, "peak_x": x[top],
    }


def _parts_and_borders(bands: DataFrame, level: Column, background: Column) -> DataFrame:
    """frame_id, y (of the band), PART, and ``borders``: places (row, column) of the part in the band's first and last own rows."""
    ready = bands.select("frame_id", "width", "y", "y_end", "top", "v", level.cast("double").alias("level"), background.cast("double").alias("background"))
    schema = StructType([bands.schema["frame_id"], *StructType.fromDDL(f"y int, {PART}, borders array<struct<row: int, col: int>>")])
    kinds = [pa.int32(), pa.int64(), *[pa.float64()] * 7, pa.int32(), pa.int32()]
    place = pa.list_(pa.struct([("row", pa.int32()), ("col", pa.int32())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                width, y, y_end, top, level_, dark = (batch.column(k)[i].as_py() for k in (1, 2, 3, 4, 6, 7))
                v = batch.column(5)[i].values.to_numpy(zero_copy_only=False).reshape(-1, width)[top : top + y_end - y]
                if level_ is None:
                    continue
                labels = labelled(v > level_)
                made = parts_of(v, labels, dark, y)
                n = len(made["label"])
                borders: list[list[dict]] = [[] for _ in range(n)]
                for row in sorted({0, len(v) - 1}):
                    for col in np.flatnonzero(labels[row]).tolist():
                        borders[labels[row, col] - 1].append({"row": row + y, "col": col})
                columns = [pa.repeat(batch.column(0)[i], n), pa.array(np.full(n, y, "i4")), *[pa.array(a, kind) for a, kind in zip(made.values(), kinds, strict=True)], pa.array(borders, place)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return ready.mapInArrow(rows, schema)


def bodies(bands: DataFrame, level: Column, background: Column) -> DataFrame:
    """(frame_id, area, flux, x, y, mxx, myy, mxy, peak, peak_y, peak_x) of the 8-connected bodies of samples above ``level``, by weights above ``background``.

    Bands label their own rows. Parts that touch over a border are joined through their samples
    there, place by place, and components of such links are found by contraction, so a body may
    reach over any number of bands. Bodies without positive flux have null moments. The brightest
    sample is the first by row, then column.
    """
    parts = save(_parts_and_borders(bands, level, background).withColumn("part", F.concat_ws(":", F.col("frame_id").cast("string"), F.col("y").cast("string"), F.col("label").cast("string"))), "segments")
    at = parts.select("frame_id", "part", "y", F.inline("borders"))
    # The lower side of each border looks for the three samples above it.
    below = at.where("row = y and row > 0").select("frame_id", F.col("part").alias("u"), (F.col("row") - 1).alias("row"), F.explode(F.array(F.col("col") - 1, F.col("col"), F.col("col") + 1)).alias("col"))
    links = below.join(at.select("frame_id", F.col("part").alias("v"), "row", "col"), ["frame_id", "row", "col"]).select("u", "v").distinct()
    roots = connected_components(links)
    whole = parts.join(roots.withColumnRenamed("node", "part"), "part", "left").withColumn("body", F.coalesce("component", "part"))
    sums = whole.groupBy("body").agg(F.sum("flux").alias("_flux"), F.sum(F.col("flux") * F.col("cx")).alias("_x"), F.sum(F.col("flux") * F.col("cy")).alias("_y"))
    centred = whole.join(sums, "body").withColumns({"dx": F.col("cx") - F.col("_x") / F.nullif("_flux", F.lit(0.0)), "dy": F.col("cy") - F.col("_y") / F.nullif("_flux", F.lit(0.0))})
    second = lambda s, a, b: F.sum(F.col(s) + F.col("flux") * F.col(a) * F.col(b))
    best = F.max_by(F.struct("peak", "peak_y", "peak_x"), F.struct("peak", -F.col("peak_y"), -F.col("peak_x")))
    out = centred.groupBy("frame_id", "body").agg(
        F.sum("area").alias("area"), F.sum("flux").alias("flux"), F.first("_x").alias("_x"), F.first("_y").alias("_y"), second("sxx", "dx", "dx").alias("_xx"), second("syy", "dy", "dy").alias("_yy"), second("sxy", "dx", "dy").alias("_xy"), best.alias("best"),
    )
    flux = F.when(F.col("flux") > 0, F.col("flux"))
    result = save(out.select("frame_id", "area", "flux", *[(F.col(c) / flux).alias(n) for c, n in (("_x", "x"), ("_y", "y"), ("_xx", "mxx"), ("_yy", "myy"), ("_xy", "mxy"))], "best.peak", "best.peak_y", "best.peak_x"), "bodies")
    discard(parts)
    return result


#: What :func:`bodies_of_frames` finds of a body, besides its frame's columns.
BODY = "median double, area long, flux double, x double, y double, mxx double, myy double, mxy double, peak double, peak_y int, peak_x int, hfr double"


def bodies_of_frames(bands: DataFrame, sigmas: float, least_pixels: int, most_pixels: int, radius: int) -> DataFrame:
    """(frame_id, width, height, BODY) of the bodies of ``bands``, each a whole frame, that have so many pixels and positive flux.

    A body is above its frame's ``median`` by so many robust sigmas and weighed above it; ``hfr`` is the half-flux radius
    about its centroid, of the samples within ``radius`` of its peak. Frames without spread have none. Frames are
    labelled and measured together where they are, so nothing but bodies leaves a task.
    """
    schema = StructType([*(bands.schema[c] for c in ("frame_id", "width", "height")), *StructType.fromDDL(BODY)])
    kinds = [pa.float64(), pa.int64(), *[pa.float64()] * 7, pa.int32(), pa.int32(), pa.float64()]

    def found(frames: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Places in ``frames``, which are of one width, and the columns of BODY."""
        noise = [frame_noise(v.ravel()) for v in frames]
        live = np.array([k for k, (_, spread) in enumerate(noise) if spread is not None and spread > 0], "i8")
        if not len(live):
            return live, [np.zeros(0) for _ in kinds]
        # A dark row behind each frame keeps bodies apart.
        dark = np.full((1, frames[0].shape[1]), np.nan)
        v = np.concatenate([rows for k in live for rows in (frames[k], dark)])
        height = np.array([len(frames[k]) for k in live])
        first = np.cumsum(height + 1) - height - 1
        per_row = lambda a: np.repeat(a, height + 1)
        median, spread = np.array([noise[k] for k in live]).T
        labels = labelled(v > per_row(median + sigmas * spread)[:, None])
        made = parts_of(v, labels, per_row(median), 0, per_row(first))
        # Labels rise with the rows, so a frame has those up to its highest.
        own = np.searchsorted(np.maximum.accumulate(np.maximum.reduceat(labels.max(axis=1), first)), made["label"])
        fine = (made["area"] >= least_pixels) & (made["area"] <= most_pixels) & (made["flux"] > 0)
        own, made = own[fine], {k: a[fine] for k, a in made.items()}
        py, px, flux = made["peak_y"], made["peak_x"], made["flux"]
        y0, y1, x0, x1 = np.maximum(py - radius, 0), np.minimum(py + radius + 1, height[own]), np.maximum(px - radius, 0), np.minimum(px + radius + 1, v.shape[1])
        hfr = np.zeros(len(own))
        for at in range(0, len(own), TOGETHER):
            some = slice(at, at + TOGETHER)
            cut = [v[a:b, c:d].ravel() for a, b, c, d in zip((first[own] + y0)[some], (first[own] + y1)[some], x0[some], x1[some], strict=True)]
            ends = np.cumsum([0, *map(len, cut)], dtype="i4")
            w = Windows({"w_y": y0[some], "w_x": x0[some], "w_cols": (x1 - x0)[some]}, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(cut))))
            hfr[some] = half_flux_radius_about(w, made["cx"][some], made["cy"][some], median[own][some])
        shape = [made[c] / flux for c in ("sxx", "syy", "sxy")]
        return live[own], [median[own], made["area"], flux, made["cx"], made["cy"], *shape, made["peak"], py, px, hfr]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width, samples = batch.column(1).to_numpy(), batch.column(3)
            turn = np.cumsum(samples.value_lengths().to_numpy()) // SAMPLES_TOGETHER
            for some in np.split(np.arange(len(width)), np.flatnonzero(np.diff(turn)) + 1):
                for size in np.unique(width[some]).tolist():
                    alike = some[width[some] == size]
                    place, columns = found([samples[k].values.to_numpy(zero_copy_only=False).reshape(-1, size) for k in alike.tolist()])
                    frame = [batch.column(k).take(pa.array(alike[place])) for k in range(3)]
                    yield pa.RecordBatch.from_arrays([*frame, *[pa.array(a, kind) for a, kind in zip(columns, kinds, strict=True)]], names=schema.names)

    return bands.select("frame_id", "width", "height", "v").mapInArrow(rows, schema)
