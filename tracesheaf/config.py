"""Run parameters and their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Parameters of an analysis. The defaults that existing recordings were analysed with."""

    dff_window: int = 30
    decay_constant: float = 0.0
    peaks_height_value: float = 3.0
    peaks_height_mode: str = "multiplier"
    peaks_distance: int = 2
    peaks_prominence_multiplier: float = 1.0
    calcium_sync_jitter_window: int = 2
    calcium_network_threshold: float = 90.0
    spike_threshold_value: float = 1.0
    spike_threshold_mode: str = "multiplier"
    burst_threshold: float = 30.0
    burst_min_duration: int = 3
    burst_gaussian_sigma: float = 2.0
    spikes_sync_cross_corr_lag: int = 5
    neuropil_inner_radius: int = 0
    neuropil_min_pixels: int = 0
    neuropil_correction_factor: float = 0.0
    led_power_equation: str = ""


MIN_AREA = 10.0
STIM_OVERLAP = 0.1
MAX_FRAMES_AFTER_STIMULUS = 5
DEFAULT_FRAME_RATE = 10.0
