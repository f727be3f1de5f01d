"""Tunables of the star detector."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class DetectorConfig:
    """Defaults suit linear frames. None leaves a value to be found from the frame or a test off."""

    expected_fwhm: float | None = None
    threshold_sigma: float = 5.0
    sharpness_low: float = 0.2
    roundness_limit: float = 0.6
    min_fwhm_factor: float = 0.5
    max_fwhm_factor: float = 2.0
    min_separation: float | None = None
    edge_margin: int = 4
    saturation_level: float | None = None
