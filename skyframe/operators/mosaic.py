"""Colour mosaics to grey, inside bands: bilinear or gradient-corrected."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..quarantine import Quarantine, set_aside
from .bands import map_bands
from .bayer import PATTERNS

#: Weights of the nearest samples of a channel.
NEAR = np.array([[1, 2, 1], [2, 4, 2], [1, 2, 1]], "f8")
#: The published linear filters of gradient-corrected interpolation, in eighths. Green at red or blue; red or blue at a green whose neighbours of that colour are left and right (transposed: above and below); red at blue and blue at red.
GREEN = np.array([[0, 0, -1, 0, 0], [0, 0, 2, 0, 0], [-1, 2, 4, 2, -1], [0, 0, 2, 0, 0], [0, 0, -1, 0, 0]]) / 8
BESIDE = np.array([[0, 0, 0.5, 0, 0], [0, -1, 0, -1, 0], [-1, 4, 5, 4, -1], [0, -1, 0, -1, 0], [0, 0, 0.5, 0, 0]]) / 8
ACROSS = np.array([[0, 0, -1.5, 0, 0], [0, 2, 0, 2, 0], [-1.5, 0, 6, 0, -1.5], [0, 2, 0, 2, 0], [0, 0, -1.5, 0, 0]]) / 8
MODES = ("bilinear", "gradient")


def _filtered(v: np.ndarray, kernel: np.ndarray, mode: str) -> np.ndarray:
    """``v`` under the kernel; beyond its border it is 0 (``constant``) or its mirror image, which keeps the colours' places (``reflect``)."""
    reach = len(kernel) // 2
    wide = np.pad(v, reach, mode=mode)
    return sum(kernel[a, b] * wide[a : a + v.shape[0], b : b + v.shape[1]] for a, b in zip(*np.nonzero(kernel), strict=True))


def _masks(shape: tuple[int, int], pattern: str, first_row: int) -> dict[str, np.ndarray]:
    y, x = (first_row + np.arange(shape[0]))[:, None] % 2, np.arange(shape[1])[None, :] % 2
    letters = np.array(list(pattern))[2 * y + x]
    return {c: letters == c for c in "RGB"}


def demosaiced(v: np.ndarray, pattern: str, mode: str = "bilinear", first_row: int = 0) -> dict[str, np.ndarray]:
    """R, G and B of a mosaic at full resolution; ``first_row`` is the frame's row that ``v`` begins with.

    ``bilinear``: a channel's own samples, else the mean of its nearest ones in the 3 x 3 around,
    by their weights; only what is there counts. ``gradient``: what is missing from a 5 x 5 linear
    filter that adds the curvature of the colour that is there; borders are mirrored. Flat channels
    stay flat to the border in both.
    """
    masks = _masks(v.shape, pattern, first_row)
    if mode == "bilinear":
        with np.errstate(invalid="ignore"):
            return {c: np.where(m, v, _filtered(np.where(m, v, 0.0), NEAR, "constant") / _filtered(m.astype("f8"), NEAR, "constant")) for c, m in masks.items()}
    green, beside, above, across = (_filtered(v, k, "reflect") for k in (GREEN, BESIDE, BESIDE.T, ACROSS))
    # A row that has red has its greens beside red and above blue.
    red_row, blue_row = (masks[c].any(axis=1, keepdims=True) for c in "RB")
    out = {"G": np.where(masks["G"], v, green)}
    for c, own_row, other in (("R", red_row, "B"), ("B", blue_row, "R")):
        out[c] = np.where(masks[c], v, np.where(masks[other], across, np.where(own_row, beside, above)))
    return out


def mode_problem(pattern: Column, mode: str) -> Column:
    """Why mosaics of this pattern can't be turned grey in this mode; null where they can."""
    known = F.when(pattern.isNotNull() & ~pattern.isin(*PATTERNS), F.concat(F.lit("unsupported Bayer pattern: "), pattern))
    if mode not in MODES:
        return F.lit(f"unknown demosaicing mode: {mode}")
    # The filters are for greens on a diagonal.
    return known.when(pattern == "RGBG", F.lit("RGBG mosaics have no gradient-corrected mode")) if mode == "gradient" else known


def grey_bands(bands: DataFrame, mode: str = "bilinear", quarantine: Quarantine | None = None) -> DataFrame:
    """``bands`` (with ``bayerpat``) whose mosaics are the equal-weight mean of their three channels; bands without a pattern stay.

    A rim loses the two rows that its filters can't fill. Frames of patterns that aren't known, or
    not in this mode, go to ``quarantine`` or raise, as does everything in an unknown mode.
    """
    sound = set_aside(bands, mode_problem(F.col("bayerpat"), mode), "mosaic", quarantine)

    def work(band: dict, v: np.ndarray) -> dict:
        if band["bayerpat"] is None:
            return {"grey": v.ravel(), "grey_top": band["top"]}
        first, last = band["y"] - band["top"], band["y"] - band["top"] + len(v)
        channels = demosaiced(v, band["bayerpat"], mode, first)
        cut, end = (2 if first > 0 else 0), (2 if last < band["height"] else 0)
        return {"grey": ((channels["R"] + channels["G"] + channels["B"]) / 3)[cut : len(v) - end].ravel(), "grey_top": band["top"] - cut}

    made = map_bands(sound, "grey array<double>, grey_top int", work)
    return made.withColumns({"v": F.col("grey"), "top": F.col("grey_top")}).select(*bands.columns)
