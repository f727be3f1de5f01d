"""Rotated Gaussians fitted to windows of samples."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PARAMETERS = ("amplitude", "x", "y", "sigma_x", "sigma_y", "theta", "background")


def gaussian(p: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and derivatives by the seven parameters of the Gaussians ``p`` (n, 7) at the places (n, samples)."""
    a, cx, cy, sx, sy, theta, _ = (c[:, None] for c in p.T)
    c, s = np.cos(theta), np.sin(theta)
    dx, dy = x - cx, y - cy
    u, t = dx * c + dy * s, -dx * s + dy * c
    e = np.exp(-0.5 * ((u / sx) ** 2 + (t / sy) ** 2))
    ae = a * e
    du, dt = ae * u / sx**2, ae * t / sy**2
    slopes = np.stack([e, du * c - dt * s, du * s + dt * c, du * u / sx, dt * t / sy, dt * u - du * t, np.ones_like(e)], axis=2)
    return ae + p[:, 6:7], slopes


@dataclass
class Fits:
    """Fits of many windows: parameters (n, 7), which are physical, and what shows that they are minima."""

    parameters: np.ndarray
    good: np.ndarray
    cost: np.ndarray
    slope: np.ndarray
    curvature: np.ndarray
    steps: np.ndarray


def _solved(hess: np.ndarray, grad: np.ndarray) -> np.ndarray:
    """Solutions of many systems; only those that are singular take the pseudo-inverse."""
    try:
        return np.linalg.solve(hess, grad[:, :, None])[:, :, 0]
    except np.linalg.LinAlgError:
        out = np.zeros_like(grad)
        fine = np.isfinite(hess).all(axis=(1, 2)) & np.isfinite(grad).all(axis=1)
        fine[fine] = np.linalg.matrix_rank(hess[fine]) == hess.shape[1]
        sick = ~fine & np.isfinite(hess).all(axis=(1, 2))
        try:
            out[fine] = np.linalg.solve(hess[fine], grad[fine][:, :, None])[:, :, 0]
        except np.linalg.LinAlgError:  # singular to the solver though of full rank by its singular values
            sick |= fine
        out[sick] = np.einsum("nab,nb->na", np.linalg.pinv(hess[sick]), grad[sick])
        return out


def fit_gaussians(x: np.ndarray, y: np.ndarray, v: np.ndarray, weight: np.ndarray, start: np.ndarray, steps: int = 60) -> Fits:
    """Levenberg-Marquardt for many windows at once.

    ``weight`` is 0 for places that a window doesn't have. A fit is physical if its numbers are
    finite, its amplitude is positive and neither sigma is 0. ``slope`` is the largest cosine
    between the residuals and a derivative of the model, 0 at a minimum; ``curvature`` the least
    eigenvalue of the derivatives' products, each derivative at unit length, positive where the
    minimum is one point.
    """
    p, damp = start.astype("f8").copy(), np.full(len(start), 1e-3)
    with np.errstate(all="ignore"):
        value, slope = gaussian(p, x, y)
        cost = (weight * (v - value) ** 2).sum(axis=1)
    live, taken = np.isfinite(cost), np.zeros(len(start), "i8")
    for _ in range(steps):
        if not live.any():
            break
        i = np.flatnonzero(live)
        w, off = weight[i], v[i] - value[i]
        weighted = slope[i] * w[:, :, None]
        hess = np.matmul(weighted.transpose(0, 2, 1), slope[i])
        grad = np.matmul(weighted.transpose(0, 2, 1), off[:, :, None])[:, :, 0]
        scale = np.einsum("naa->na", hess)
        hess[:, range(7), range(7)] += damp[i, None] * np.maximum(scale, 1e-12)
        tried = p[i] + _solved(hess, grad)
        with np.errstate(all="ignore"):
            new_value, new_slope = gaussian(tried, x[i], y[i])
            new_cost = (w * (v[i] - new_value) ** 2).sum(axis=1)
        better = np.isfinite(new_cost) & (new_cost < cost[i])
        done = better & (cost[i] - new_cost <= 1e-10 * cost[i])
        up = i[better]
        p[up], value[up], slope[up], cost[up] = tried[better], new_value[better], new_slope[better], new_cost[better]
        damp[up] = np.maximum(damp[up] / 10, 1e-12)
        damp[i[~better]] *= 10
        taken[i] += 1
        live[i[done]] = False
        live[i] &= damp[i] < 1e10
    good = np.isfinite(p).all(axis=1) & (p[:, 0] > 0) & (p[:, 3] != 0) & (p[:, 4] != 0)
    with np.errstate(all="ignore"):
        root = np.sqrt(weight)[:, :, None]
        unit = slope * root
        unit /= np.sqrt((unit**2).sum(axis=1, keepdims=True))
        residual = (root[:, :, 0] * (v - value)) / np.sqrt(cost)[:, None]
        cosines = np.abs(np.matmul(unit.transpose(0, 2, 1), residual[:, :, None])[:, :, 0]).max(axis=1)
        products = np.matmul(unit.transpose(0, 2, 1), unit)
        whole = np.isfinite(products).all(axis=(1, 2))
        least = np.full(len(p), np.nan)
        least[whole] = np.linalg.eigvalsh(products[whole])[:, 0]
    return Fits(p, good, cost, np.where(cost > 0, cosines, 0.0), least, taken)


def gaussian_fit(windows: DataFrame, keys: list[str]) -> DataFrame:
    """``windows`` with ``fit``, a struct of PARAMETERS, null where there is no physical Gaussian.

    ``windows`` has one row for each star: ``samples`` (array of x, y, v) and ``seed`` (PARAMETERS).
    Rows are fitted batch by batch where they are; a batch's windows are padded to the widest.
    """
    kept = windows.select(*keys, "samples", "seed")
    fields = ", ".join(f"{c}: double" for c in PARAMETERS)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(*keys).schema) + f", fit struct<{fields}>"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                samples, seeds = batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist()
                n, most = len(samples), max(map(len, samples), default=0)
                x, y, v, w = (np.zeros((n, most)) for _ in range(4))
                for i, own in enumerate(samples):
                    for out, name in ((x, "x"), (y, "y"), (v, "v")):
                        out[i, : len(own)] = [s[name] for s in own]
                    w[i, : len(own)] = 1
                start = np.array([[s[c] for c in PARAMETERS] for s in seeds], "f8").reshape(n, 7)
                found = fit_gaussians(x, y, v, w, start)
                fits = [dict(zip(PARAMETERS, row, strict=True)) if ok else None for row, ok in zip(found.parameters.tolist(), found.good, strict=True)]
                kind = pa.struct([(c, pa.float64()) for c in PARAMETERS])
                yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(keys))] + [pa.array(fits, kind)], names=[*keys, "fit"])

    return kept.mapInArrow(rows, schema)
