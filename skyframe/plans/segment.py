"""Star detection by segmentation: bodies above a threshold, measured by their moments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import moment_eccentricity, moment_fwhm
from ..operators.bands import COLUMNS, RIM, band_noise, is_whole, windows_at
from ..operators.cutouts import with_half_flux_radius
from ..operators.grid import require_single_channel
from ..operators.peaks import rank_peaks
from ..operators.segments import bodies, bodies_of_frames
from ..quarantine import Quarantine
from ..spool import as_table, save
from .detect import as_bands, detection_level, has_parts, inside_margin


@dataclass(frozen=True)
class SegmentConfig:
    """A body is above the frame's median by so many robust sigmas; of stars, least and most pixels, largest eccentricity, margin, and how far the half-flux radius looks, which is at most a band's rim."""

    threshold_sigma: float = 5.0
    least_pixels: int = 5
    most_pixels: int = 10_000
    roundness_limit: float = 0.6
    edge_margin: int = 4
    radius: int = 10


class SegmentDetector:
    """Finds stars as round connected bodies of bright pixels."""

    def __init__(self, config: SegmentConfig | None = None):
        self.config = config or SegmentConfig()
        if not 0 < self.config.radius <= RIM:
            raise ValueError(f"a radius from 1 to {RIM} is needed, not {self.config.radius}")

    def detect(self, pixels: DataFrame, frames: DataFrame | None = None, quarantine: Quarantine | None = None) -> DataFrame:
        """Stars of each frame of ``pixels`` (bands, or dense single-channel pixels that are rows): frame_id, rank, x, y, flux, hfr, fwhm, eccentricity; ``rank`` is the order of falling peaks.

        Frames that are one band go from samples to bodies where they are; of others parts of bodies meet.
        """
        config = self.config
        if frames is not None:
            pixels = pixels.join(require_single_channel(frames, quarantine).select("frame_id"), "frame_id", "left_semi")
        bands = as_table(as_bands(pixels), "bands")
        found = bodies_of_frames(bands.where(is_whole()), config.threshold_sigma, config.least_pixels, config.most_pixels, config.radius)
        whole = _told(self._ranked(found, "hfr"))
        return whole.unionByName(self._stars_of_parts(bands.where(~is_whole()))) if has_parts(bands) else whole

    def _stars_of_parts(self, bands: DataFrame) -> DataFrame:
        """Stars of frames of several bands."""
        config = self.config
        noise = save(band_noise(bands, is_table=True).where("noise > 0"), "noise")
        known = bands.select(*COLUMNS).join(noise, "frame_id")
        found = bodies(known, detection_level(F.col("median"), F.col("noise"), config.threshold_sigma), F.col("median"))
        size = bands.where("y = 0").select("frame_id", "width", "height")
        ranked = save(self._ranked(found.join(size, "frame_id").join(noise.select("frame_id", "median"), "frame_id"), "median"), "bodies-ranked")
        return _told(with_half_flux_radius(windows_at(bands, ranked, config.radius), "cx", "cy", "median"))

    def _ranked(self, found: DataFrame, *others: str) -> DataFrame:
        """The bodies that are stars, at their peaks, with rank and the columns ``others``."""
        config = self.config
        ecc = moment_eccentricity(F.col("mxx"), F.col("myy"), F.col("mxy"))
        stars = found.where(F.col("area").between(config.least_pixels, config.most_pixels) & F.col("x").isNotNull())
        stars = stars.withColumns({"fwhm": moment_fwhm(F.col("mxx"), F.col("myy")), "eccentricity": ecc}).where(F.col("eccentricity") <= config.roundness_limit)
        stars = stars.where(inside_margin(F.col("peak_y"), F.col("peak_x"), F.col("height"), F.col("width"), config.edge_margin))
        places = stars.select("frame_id", F.col("peak_y").alias("y"), F.col("peak_x").alias("x"), "peak", F.col("x").alias("cx"), F.col("y").alias("cy"), "flux", "fwhm", "eccentricity", *others)
        return rank_peaks(places, "peak").drop("peak")


def _told(stars: DataFrame) -> DataFrame:
    return stars.select("frame_id", "rank", F.col("cx").alias("x"), F.col("cy").alias("y"), "flux", "hfr", "fwhm", "eccentricity")
