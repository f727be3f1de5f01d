"""Windows of peaks measured many at a time: background, sharpness, moments, half-flux radius and fits along the window axis in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .bands import TOGETHER as SAMPLES_TOGETHER
from .bands import frame_noise, maxima
from .fit import PARAMETERS, fit_gaussians

#: Windows that are measured together.
TOGETHER = 128
#: What :func:`measured` adds: the window's median, and moments and half-flux radius about the centroid of its samples above it; null without positive flux.
MEASURES = ("background", "sharpness", "x", "y", "flux", "mxx", "myy", "mxy", "hfr")
#: What says that a fit is a minimum: the squared residuals left, the largest share of a slope of theirs and the least eigenvalue of their scaled curvature.
CERTIFICATE = ("cost", "slope", "curvature")


class Windows:
    """A batch of windows padded to the longest: places, samples and which of them there are."""

    def __init__(self, columns: dict[str, np.ndarray], samples: pa.Array):
        size = samples.value_lengths().to_numpy().astype("i8")
        self.n, self.most = len(size), int(size.max(initial=0))
        self.there = np.arange(self.most) < size[:, None]
        at = np.arange(self.most) // np.maximum(columns["w_cols"], 1)[:, None], np.arange(self.most) % np.maximum(columns["w_cols"], 1)[:, None]
        self.y, self.x = columns["w_y"][:, None] + at[0], columns["w_x"][:, None] + at[1]
        self.v = np.full((self.n, self.most), np.nan)
        self.v[self.there] = samples.flatten().to_numpy(zero_copy_only=False)

    def median(self) -> np.ndarray:
        """The median of each window's samples, the mean of the middle two for even counts."""
        ordered = np.sort(np.where(self.there, self.v, np.inf), axis=1)
        count, row = self.there.sum(axis=1), np.arange(self.n)
        return (ordered[row, (count - 1) // 2] + ordered[row, count // 2]) / 2 if self.most else np.full(self.n, np.nan)


def sharpness(w: Windows, py: np.ndarray, px: np.ndarray, background: np.ndarray) -> np.ndarray:
    """The mean of the up to eight neighbours over the peak, both above background; 0 where the peak isn't above it."""
    ring = np.maximum(abs(w.y - py[:, None]), abs(w.x - px[:, None]))
    above = np.where(w.there, w.v - background[:, None], 0.0)
    near = w.there & (ring == 1)
    centre = np.where(w.there & (ring == 0), above, 0.0).sum(axis=1)
    with np.errstate(all="ignore"):
        mean = np.where(near, above, 0.0).sum(axis=1) / near.sum(axis=1)
        return np.where((centre > 0) & near.any(axis=1), mean / centre, 0.0)


def half_flux_radius(w: Windows, weight: np.ndarray, there: np.ndarray, cx: np.ndarray, cy: np.ndarray, flux: np.ndarray) -> np.ndarray:
    """Where the weight summed outwards from the centre first reaches half the flux, inside the sample that crosses; ties in radius go by row, then column. The last radius where it never does."""
    r = np.where(there, np.sqrt((w.x - cx[:, None]) ** 2 + (w.y - cy[:, None]) ** 2), np.inf)
    order = np.argsort(r, axis=1, kind="stable")  # samples lie by row, then column
    r, part = np.take_along_axis(r, order, 1), np.take_along_axis(np.where(there, weight, 0.0), order, 1)
    total, row, count = np.cumsum(part, axis=1), np.arange(w.n), there.sum(axis=1)
    crossed = (total >= flux[:, None] / 2) & (np.arange(w.most) < count[:, None])
    at = np.where(crossed.any(axis=1), crossed.argmax(axis=1), np.maximum(count - 1, 0))
    own, end = part[row, at], r[row, at]
    start = np.where(at > 0, r[row, np.maximum(at - 1, 0)], 0.0)
    before = np.where(at > 0, total[row, at] - own, 0.0)
    with np.errstate(all="ignore"):
        inside = start + np.where(own > 0, (flux / 2 - before) / own, 0.0) * (end - start)
    return np.where(crossed.any(axis=1), inside, end)


def half_flux_radius_about(w: Windows, cx: np.ndarray, cy: np.ndarray, background: np.ndarray) -> np.ndarray:
    """:func:`half_flux_radius` of all samples above ``background``; 0 without positive flux."""
    weight = np.where(w.there, w.v - background[:, None], 0.0)
    flux = weight.sum(axis=1)
    return np.where(flux > 0, half_flux_radius(w, weight, w.there, cx, cy, flux), 0.0)


def moments(w: Windows, background: np.ndarray, there: np.ndarray) -> dict[str, np.ndarray]:
    """Centroid, flux, second moments and half-flux radius of the samples ``there``, above background; NaN without positive flux."""
    weight = np.where(there, w.v - background[:, None], 0.0)
    # Added up one by one, as SQL does: where samples are as far from the centroid as others, its last bit says which comes first.
    total = lambda a: np.cumsum(a, axis=1)[:, -1] if w.most else np.zeros(w.n)
    flux = total(weight)
    with np.errstate(all="ignore"):
        flux = np.where(flux > 0, flux, np.nan)
        cx, cy = total(weight * w.x) / flux, total(weight * w.y) / flux
        dx, dy = w.x - cx[:, None], w.y - cy[:, None]
        second = {k: (weight * a * b).sum(axis=1) / flux for k, a, b in (("mxx", dx, dx), ("myy", dy, dy), ("mxy", dx, dy))}
        hfr = half_flux_radius(w, weight, there, np.nan_to_num(cx), np.nan_to_num(cy), np.nan_to_num(flux))
    return {"x": cx, "y": cy, "flux": flux, **second, "hfr": np.where(np.isnan(flux), np.nan, hfr)}


def map_windows(peaks: DataFrame, added: list[StructField], work: Callable[[dict[str, np.ndarray], Windows], dict[str, np.ndarray]], drop: tuple[str, ...] = ()) -> DataFrame:
    """``peaks`` (with windows) and the columns ``added``, which ``work`` makes for a batch of windows where they are; NaN becomes null."""
    names = [c for c in peaks.columns if c not in drop]
    schema = StructType([*(peaks.schema[c] for c in names), *added])
    numbers = [f.name for f in peaks.schema if f.dataType.simpleString() in ("int", "bigint", "double")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(at, TOGETHER)
                place = {n: k for k, n in enumerate(batch.schema.names)}
                columns = {n: batch.column(place[n]).to_numpy(zero_copy_only=False) for n in numbers}
                made = work(columns, Windows(columns, batch.column(place["samples"])))
                out = [pa.array(made[f.name], pa.int64() if f.dataType == LongType() else pa.float64(), from_pandas=True) for f in added]
                yield pa.RecordBatch.from_arrays([*(batch.column(place[n]) for n in names), *out], names=[*names, *[f.name for f in added]])

    return peaks.mapInArrow(rows, schema)


def _doubles(*names: str) -> list[StructField]:
    return [StructField(n, DoubleType()) for n in names]


def measured(peaks: DataFrame, body: str | None = None, background_of: str | None = None) -> DataFrame:
    """``peaks`` with MEASURES; ``background_of`` is a column that has the background instead of the window's median.

    With ``body``, a column, of the samples above the background by more than it, of which ``body_pixels`` is the number.
    """

    def work(columns: dict[str, np.ndarray], w: Windows) -> dict[str, np.ndarray]:
        background = w.median() if background_of is None else columns[background_of].astype("f8")
        there = w.there if body is None else w.there & (np.nan_to_num(w.v, nan=-np.inf) > (background + columns[body])[:, None])
        own = {"background": background, "sharpness": sharpness(w, columns["peak_y"], columns["peak_x"], background), "body_pixels": there.sum(axis=1)}
        return own | moments(w, background, there)

    return map_windows(peaks, [*_doubles(*MEASURES), StructField("body_pixels", LongType())], work)


def with_scale_of_frames(bands: DataFrame, sigmas: float, radius: int, body_sigmas: float, least_pixels: int, least_hfr: float, out: str) -> DataFrame:
    """``bands``, each a whole frame, with twice the median half-flux radius of its maxima ``sigmas`` above its median as ``out``; null where there is none.

    Windows reach ``radius``; of them count the samples above their median by ``body_sigmas``, if there are ``least_pixels``, and radii above ``least_hfr``. Frames are measured together where they are.
    """
    schema = StructType([*bands.schema, StructField(out, DoubleType())])

    def sizes(frames: list[np.ndarray]) -> list[float | None]:
        own, noise, places, samples = [], [], [], []
        for k, v in enumerate(frames):
            centre, spread = frame_noise(v.ravel())
            if spread is None or not spread > 0:
                continue
            for y, x in zip(*maxima(v, 0, len(v), centre + sigmas * spread), strict=True):
                y0, x0 = max(y - radius, 0), max(x - radius, 0)
                window = v[y0 : y + radius + 1, x0 : x + radius + 1]
                own.append(k)
                noise.append(spread)
                places.append((y0, x0, window.shape[1]))
                samples.append(window.ravel())
        found: list[list[float]] = [[] for _ in frames]
        for at in range(0, len(own), TOGETHER):
            some = slice(at, at + TOGETHER)
            columns = dict(zip(("w_y", "w_x", "w_cols"), np.array(places[some]).T, strict=True))
            ends = np.cumsum([0, *map(len, samples[some])], dtype="i4")
            w = Windows(columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(samples[some]))))
            background = w.median()
            body = w.there & (np.nan_to_num(w.v, nan=-np.inf) > (background + body_sigmas * np.array(noise[some]))[:, None])
            hfr = moments(w, background, body)["hfr"]
            for k, r, fine in zip(own[some], hfr, (body.sum(axis=1) >= least_pixels) & np.isfinite(hfr) & (hfr > least_hfr), strict=True):
                if fine:
                    found[k].append(2 * r)
        return [float(np.median(f)) if f else None for f in found]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            v, width = whole.column(whole.schema.names.index("v")), whole.column(whole.schema.names.index("width")).to_pylist()
            start, held, frames = 0, 0, []
            for i in range(whole.num_rows):
                frames.append(v[i].values.to_numpy(zero_copy_only=False).reshape(-1, width[i]))
                held += frames[-1].size
                if held >= SAMPLES_TOGETHER or i + 1 == whole.num_rows:
                    batch = whole.slice(start, len(frames))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes(frames), pa.float64())], names=[*whole.schema.names, out])
                    start, held, frames = i + 1, 0, []

    return bands.mapInArrow(rows, schema)


def with_half_flux_radius(windows: DataFrame, cx: str, cy: str, background: str, out: str = "hfr") -> DataFrame:
    """``windows`` with the half-flux radius about given centres above given backgrounds, all columns; 0 without positive flux."""

    def work(columns: dict[str, np.ndarray], w: Windows) -> dict[str, np.ndarray]:
        return {out: half_flux_radius_about(w, columns[cx].astype("f8"), columns[cy].astype("f8"), columns[background])}

    return map_windows(windows, _doubles(out), work)


def fitted(peaks: DataFrame) -> DataFrame:
    """``peaks`` (with windows and the seed as columns seed_<parameter>) with fit_<parameter>, CERTIFICATE, the ``steps`` taken, and ``fit_hfr``, the half-flux radius about the fitted centre above the fitted background; all null where there is no physical Gaussian."""

    def work(columns: dict[str, np.ndarray], w: Windows) -> dict[str, np.ndarray]:
        start = np.stack([columns[f"seed_{c}"] for c in PARAMETERS], axis=1).astype("f8")
        fit = fit_gaussians(w.x.astype("f8"), w.y.astype("f8"), np.where(w.there, w.v, 0.0), w.there.astype("f8"), start)
        p = np.where(fit.good[:, None], fit.parameters, np.nan)
        weight = np.where(w.there, w.v - p[:, 6:7], 0.0)
        flux = np.nan_to_num(weight.sum(axis=1))
        hfr = half_flux_radius(w, np.nan_to_num(weight), w.there, np.nan_to_num(p[:, 1]), np.nan_to_num(p[:, 2]), flux)
        out = {f"fit_{c}": p[:, k] for k, c in enumerate(PARAMETERS)} | {"fit_hfr": np.where(fit.good, np.where(flux > 0, hfr, 0.0), np.nan)}
        return out | {c: np.where(fit.good, getattr(fit, c), np.nan) for c in CERTIFICATE} | {"steps": fit.steps}

    added = [*_doubles(*[f"fit_{c}" for c in PARAMETERS], "fit_hfr", *CERTIFICATE), StructField("steps", LongType())]
    return map_windows(peaks, added, work)
