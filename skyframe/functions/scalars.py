"""Column expressions of star and noise measures."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: FWHM of a Gaussian over its sigma; standard deviation of normal noise over its median absolute deviation, a fixed value.
FWHM_PER_SIGMA = 2 * math.sqrt(2 * math.log(2))
MAD_TO_SIGMA = 1.4826


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def snr_weight(noise: Column) -> Column:
    """1 / noise squared; infinite for no noise."""
    return F.when(noise == 0, F.lit(float("inf"))).otherwise(1 / (noise * noise))


def half_spread(mxx: Column, myy: Column, mxy: Column) -> tuple[Column, Column]:
    """Mean of the principal second moments and half of their difference."""
    half = (mxx - myy) / 2
    return (mxx + myy) / 2, F.sqrt(half * half + mxy * mxy)


def moment_fwhm(mxx: Column, myy: Column) -> Column:
    return FWHM_PER_SIGMA * F.sqrt(F.greatest((mxx + myy) / 2, F.lit(0.0)))


def moment_eccentricity(mxx: Column, myy: Column, mxy: Column) -> Column:
    """0 where the major moment isn't positive; above 1 where the minor one is negative."""
    mean, spread = half_spread(mxx, myy, mxy)
    major = mean + spread
    return F.when(major <= 0, 0.0).otherwise(F.sqrt(F.greatest(1 - (mean - spread) / F.when(major > 0, major), F.lit(0.0))))


def gaussian_seed(mxx: Column, myy: Column, mxy: Column) -> tuple[Column, Column, Column]:
    """sigma_x (along the major axis), sigma_y and theta to start a fit from."""
    mean, spread = half_spread(mxx, myy, mxy)
    axis = lambda x: F.sqrt(F.greatest(x, F.lit(1e-6)))
    return axis(mean + spread), axis(mean - spread), F.atan2(2 * mxy, mxx - myy) / 2


def fit_shape(sigma_x: Column, sigma_y: Column) -> tuple[Column, Column]:
    """FWHM (of the geometric mean sigma) and eccentricity of a fitted Gaussian; null where the larger sigma is 0."""
    major, minor = F.greatest(F.abs(sigma_x), F.abs(sigma_y)), F.least(F.abs(sigma_x), F.abs(sigma_y))
    ratio = minor / F.when(major > 0, major)
    return F.when(major > 0, FWHM_PER_SIGMA * F.sqrt(major * minor)), F.sqrt(F.greatest(1 - ratio * ratio, F.lit(0.0)))


def gaussian_flux(amplitude: Column, sigma_x: Column, sigma_y: Column) -> Column:
    return 2 * math.pi * amplitude * F.abs(sigma_x) * F.abs(sigma_y)


def effective_fwhm(*choices: Column | float | None) -> Column:
    """The first choice that isn't null, 3 if none, and at least 1."""
    given = [c if isinstance(c, Column) else F.lit(float(c)) for c in choices if c is not None]
    return F.greatest(F.coalesce(*given, F.lit(3.0)), F.lit(1.0))


def measurement_radius(fwhm: Column) -> Column:
    """1.5 FWHM rounded half up, at least 3."""
    return F.greatest(F.lit(3), F.round(1.5 * fwhm).cast("int"))


def linear(stored: Column, bzero: Column | float, bscale: Column | float) -> Column:
    return F.coalesce(F.lit(bzero).cast("double"), F.lit(0.0)) + F.coalesce(F.lit(bscale).cast("double"), F.lit(1.0)) * stored


def gaussian_value(fit: Column, x: Column, y: Column) -> Column:
    """A fitted Gaussian (a struct of its parameters) at a place."""
    dx, dy, c, s = x - fit["x"], y - fit["y"], F.cos(fit["theta"]), F.sin(fit["theta"])
    u, t = (dx * c + dy * s) / fit["sigma_x"], (dy * c - dx * s) / fit["sigma_y"]
    return fit["background"] + fit["amplitude"] * F.exp(-(u * u + t * t) / 2)


def rms(difference: Column) -> Column:
    """Root mean square, as an aggregate."""
    return F.sqrt(F.avg(difference * difference))


def reported_hfr(path: Column) -> Column:
    """The half-flux radius that acquisition software puts into file names (..._H3.69.fits); null where there is none."""
    return F.regexp_extract(path, r"_H([0-9]+(?:\.[0-9]+)?)\.fits?$", 1).try_cast("double")
