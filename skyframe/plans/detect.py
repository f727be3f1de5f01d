"""Star detection as one plan: response, peaks, separation, measurement."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DetectorConfig
from ..functions.scalars import FWHM_PER_SIGMA, effective_fwhm, fit_shape, gaussian_flux, gaussian_seed, is_finite, measurement_radius
from ..operators.bands import COLUMNS, WINDOW, band_noise, bands_of_pixels, is_whole, peaks_with_windows, with_response
from ..operators.cutouts import CERTIFICATE, fitted, measured, with_scale_of_frames
from ..operators.fit import PARAMETERS
from ..operators.grid import frames_of, require_single_channel
from ..operators.peaks import rank_peaks, separate
from ..quarantine import Quarantine, set_aside
from ..spool import as_table, save

#: Columns of a window.
WINDOW_COLUMNS = tuple(c.split()[0] for c in WINDOW.split(", "))
#: Of the scale estimate: bright maxima are so many sigma above the median, windows reach so far, a body is above the background by so many sigma and has so many pixels, and its half-flux radius is above.
BRIGHT_SIGMA, BOOT_RADIUS, BODY_SIGMA, BODY_PIXELS, LEAST_HFR = 10.0, 10, 3.0, 5, 0.3


class StarDetecting(Protocol):
    """Anything that finds the stars of frames."""

    def detect(self, pixels: DataFrame, frames: DataFrame | None = None, quarantine: Quarantine | None = None) -> DataFrame: ...


def with_background(windows: DataFrame, keys: list[str]) -> DataFrame:
    """``windows`` with the median of each window as ``background``; windows are small."""
    return windows.withColumn("background", F.median("v").over(Window.partitionBy(*keys)))


def with_sharpness(windows: DataFrame, keys: list[str]) -> DataFrame:
    """``windows`` (dy, dx, v, background) with ``sharpness``: the mean of the up to eight neighbours over the centre, both above background; 0 where the centre isn't above it."""
    over = Window.partitionBy(*keys)
    ring = F.greatest(F.abs("dy"), F.abs("dx"))
    near = F.avg(F.when(ring == 1, F.col("v") - F.col("background"))).over(over)
    centre = F.max(F.when(ring == 0, F.col("v") - F.col("background"))).over(over)
    return windows.withColumn("sharpness", F.coalesce(F.when(centre > 0, near / F.when(centre > 0, centre)), F.lit(0.0)))


def detection_level(median: Column, noise: Column, sigmas: float) -> Column:
    """So many robust sigmas above the median."""
    return median + sigmas * noise


def inside_margin(y: Column, x: Column, height: Column, width: Column, margin: int) -> Column:
    """Whether a place is ``margin`` or more from every border."""
    return (x >= margin) & (x < width - margin) & (y >= margin) & (y < height - margin)


def unsaturated(value: Column, level: float | None) -> Column:
    """Whether a peak's pixel is below the saturation level, if there is one."""
    return F.lit(True) if level is None else value < level


def sharp_enough(sharpness: Column, low: float) -> Column:
    return sharpness >= low


def separation(fwhm: Column, given: float | None) -> Column:
    """Least distance of two peaks: as given, else the FWHM."""
    return fwhm if given is None else F.lit(float(given))


def admissible_shape(fwhm: Column, eccentricity: Column, scale: Column, config: DetectorConfig) -> Column:
    """Whether a fitted star's FWHM is near the frame's and it is round; not for null or NaN."""
    near = is_finite(fwhm) & fwhm.between(config.min_fwhm_factor * scale, config.max_fwhm_factor * scale)
    return F.coalesce(near & ~F.isnan(eccentricity) & (eccentricity <= config.roundness_limit), F.lit(False))


def as_bands(frames: DataFrame) -> DataFrame:
    """Bands as they are; dense pixels that are rows as bands, a table."""
    return frames if "y_end" in frames.columns else save(bands_of_pixels(frames, frames_of(frames)), "bands")


def bright_peaks(bands: DataFrame) -> DataFrame:
    """The bright maxima of raw bands, a table, with the windows around them and their frame's ``noise``."""
    noise = save(band_noise(bands, is_table=True).where("noise > 0"), "noise")
    level = detection_level(F.col("median"), F.col("noise"), BRIGHT_SIGMA)
    return peaks_with_windows(bands.select(*COLUMNS).join(noise, "frame_id"), level, BOOT_RADIUS)


def has_parts(bands: DataFrame) -> bool:
    """Whether any frame of the table ``bands`` has several bands; samples aren't read."""
    return bool(bands.where(~is_whole()).select("frame_id").limit(1).count())


def estimated_in_place(bands: DataFrame, out: str = "fwhm") -> DataFrame:
    """``bands`` that are whole frames with the estimate of :func:`estimate_fwhm`, null where there is none."""
    return with_scale_of_frames(bands.where(is_whole()), BRIGHT_SIGMA, BOOT_RADIUS, BODY_SIGMA, BODY_PIXELS, LEAST_HFR, out)


def estimate_fwhm(frames: DataFrame) -> DataFrame:
    """(frame_id, fwhm): the median of twice the half-flux radius of each frame's bright maxima, of bands or pixels; frames without any have no row.

    Frames that are one band are measured where they are; maxima of others meet.
    """
    bands = as_table(as_bands(frames), "bands")
    whole = estimated_in_place(bands.select("frame_id", "width", "height", "y", "y_end", "v")).where("fwhm is not null").select("frame_id", "fwhm")
    return whole.unionByName(_estimate_of_parts(bands.where(~is_whole()))) if has_parts(bands) else whole


def _estimate_of_parts(bands: DataFrame) -> DataFrame:
    peaks = bright_peaks(bands).withColumn("body", BODY_SIGMA * F.col("noise"))
    sizes = measured(peaks, "body").where((F.col("body_pixels") >= BODY_PIXELS) & is_finite(F.col("hfr")) & (F.col("hfr") > LEAST_HFR))
    return sizes.groupBy("frame_id").agg(F.median(2 * F.col("hfr")).alias("fwhm"))


def scale_of(bands: DataFrame, config: DetectorConfig) -> DataFrame:
    """(frame_id, fwhm) of every frame of several bands: as configured, else estimated, else 3; at least 1. Only an estimate reads the samples."""
    frames = bands.where("y = 0").select("frame_id")
    if config.expected_fwhm is not None:
        return frames.withColumn("fwhm", effective_fwhm(config.expected_fwhm))
    found = _estimate_of_parts(bands).withColumnRenamed("fwhm", "_found")
    return frames.join(found, "frame_id", "left").select("frame_id", effective_fwhm(F.col("_found")).alias("fwhm"))


def rim_needed(fwhm: Column) -> Column:
    """Rows that a band must have beyond its own for the filter, its maxima and the windows at this scale."""
    return F.greatest(F.ceil(3 * fwhm / FWHM_PER_SIGMA).cast("int") + 1, measurement_radius(fwhm))


def with_rims(bands: DataFrame, quarantine: Quarantine | None) -> DataFrame:
    """``bands`` (with fwhm) of the frames all of whose bands have the rims that their scale needs; the others go to ``quarantine`` or raise."""
    below = F.size("v") / F.col("width") - F.col("top") - (F.col("y_end") - F.col("y"))
    need = rim_needed(F.col("fwhm"))
    short = (F.col("top") < F.least(need, F.col("y"))) | (below < F.least(need, F.col("height") - F.col("y_end")))
    bad = bands.where(short).select("frame_id").distinct()
    if not bad.limit(1).count():
        return bands
    set_aside(bad, F.lit("its stars need wider rims than its bands have"), "rims", quarantine)
    return bands.join(bad, "frame_id", "left_anti")


def response_peaks(bands: DataFrame, config: DetectorConfig, quarantine: Quarantine | None = None) -> DataFrame:
    """Local maxima of the zero-sum response of the table ``bands`` above its median by robust sigmas, with windows of the raw samples and the frame's fwhm; frames without spread have none.

    Frames that are one band go from samples to peaks where they are. Of others only numbers of
    frames meet: their scale, then their response's noise, for which the response is a table.
    """
    some = bands.select(*COLUMNS)
    whole = some.where(is_whole())
    scaled = estimated_in_place(whole, "_found") if config.expected_fwhm is None else whole.withColumn("_found", F.lit(float(config.expected_fwhm)))
    scaled = scaled.withColumn("fwhm", effective_fwhm(F.col("_found"))).drop("_found")
    peaks = _peaks_of_response(with_response(scaled, F.col("fwhm") / FWHM_PER_SIGMA, noise=True).where("noise > 0"), config)
    if not has_parts(bands):
        return peaks
    parts = some.where(~is_whole())
    known = with_rims(parts.join(save(scale_of(parts, config), "scale"), "frame_id"), quarantine)
    response = save(with_response(known, F.col("fwhm") / FWHM_PER_SIGMA), "response")
    noise = save(band_noise(response, "response", "response_top").where("noise > 0"), "response-noise")
    return peaks.unionByName(_peaks_of_response(response.join(noise, "frame_id"), config))


def _peaks_of_response(response: DataFrame, config: DetectorConfig) -> DataFrame:
    level = detection_level(F.col("median"), F.col("noise"), config.threshold_sigma)
    return peaks_with_windows(response, level, measurement_radius(F.col("fwhm")), "response", "response_top")


def seeds(amplitude: Column) -> dict[str, Column]:
    """Columns seed_<parameter> to start a fit from, of moments and a background."""
    sx, sy, theta = gaussian_seed(F.col("mxx"), F.col("myy"), F.col("mxy"))
    values = (amplitude, F.col("x"), F.col("y"), sx, sy, theta, F.col("background"))
    return {f"seed_{c}": e for c, e in zip(PARAMETERS, values, strict=True)}


class MatchedFilterDetector:
    """Finds stars by a zero-sum matched filter at the stars' own scale, then by cuts on shape."""

    def __init__(self, config: DetectorConfig | None = None):
        self.config = config or DetectorConfig()

    def detect(self, pixels: DataFrame, frames: DataFrame | None = None, quarantine: Quarantine | None = None) -> DataFrame:
        """Stars of each frame of ``pixels`` (bands, or dense single-channel pixels that are rows): frame_id, rank, x, y, flux, hfr, fwhm, eccentricity.

        ``rank`` is the order of falling response among the frame's separated peaks. Frames of more
        channels, and those whose bands have too narrow rims, go to ``quarantine`` or raise. Peaks
        are written as a table, so are the bands unless they are a saved table, and scales and
        response of frames of several bands.
        """
        config = self.config
        if frames is not None:
            pixels = pixels.join(require_single_channel(frames, quarantine).select("frame_id"), "frame_id", "left_semi")
        bands = as_table(as_bands(pixels), "bands")
        peaks = save(response_peaks(bands, config, quarantine).withColumnsRenamed({"height_of_peak": "response"}), "peaks")
        slim = peaks.select("frame_id", F.col("peak_y").alias("y"), F.col("peak_x").alias("x"), "response", "fwhm")
        apart = separate(slim, "response", separation(F.col("fwhm"), config.min_separation))
        ranked = save(rank_peaks(apart, "response"), "ranks").select("frame_id", F.col("y").alias("peak_y"), F.col("x").alias("peak_x"), "rank")
        return self.measure(peaks.join(ranked, ["frame_id", "peak_y", "peak_x"]))

    def measure(self, peaks: DataFrame) -> DataFrame:
        """Stars among ``peaks`` (with windows, rank, fwhm and the frame's width and height): margin and saturation, sharpness, moments, fit, shape."""
        return self.certified(peaks).select("frame_id", "rank", "x", "y", "flux", "hfr", "fwhm", "eccentricity")

    def certified(self, peaks: DataFrame) -> DataFrame:
        """:meth:`measure` with all parameters of the fits and their certificates."""
        config = self.config
        inside = inside_margin(F.col("peak_y"), F.col("peak_x"), F.col("height"), F.col("width"), config.edge_margin)
        some = measured(peaks.where(inside & unsaturated(F.col("peak"), config.saturation_level)))
        some = some.where(sharp_enough(F.col("sharpness"), config.sharpness_low) & F.col("flux").isNotNull())
        fits = fitted(some.withColumns(seeds(F.col("peak") - F.col("background"))))
        fwhm, ecc = fit_shape(F.col("fit_sigma_x"), F.col("fit_sigma_y"))
        stars = fits.where("fit_x is not null").withColumn("star_fwhm", fwhm).withColumn("star_ecc", ecc)
        stars = stars.where(admissible_shape(F.col("star_fwhm"), F.col("star_ecc"), F.col("fwhm"), config))
        flux = gaussian_flux(F.col("fit_amplitude"), F.col("fit_sigma_x"), F.col("fit_sigma_y"))
        return stars.select(
            "frame_id", "rank", F.col("fit_x").alias("x"), F.col("fit_y").alias("y"), flux.alias("flux"), F.col("fit_hfr").alias("hfr"), F.col("star_fwhm").alias("fwhm"), F.col("star_ecc").alias("eccentricity"),
            *WINDOW_COLUMNS, *[f"fit_{c}" for c in PARAMETERS], *CERTIFICATE, "steps",
        )
