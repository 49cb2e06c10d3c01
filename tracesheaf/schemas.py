"""Declared schemas: records of one region of interest, pixel, label and metadata tables."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT = ["well_fov_position", "condition_1", "condition_2", "cell_size_units", "led_pulse_duration", "led_power_equation"]
_SERIES = ["raw_trace", "corrected_trace", "neuropil_trace", "dff", "dec_dff", "inferred_spikes", "elapsed_time_list_ms", "iei", "peaks_amplitudes_dec_dff"]
_NUMBERS = ["neuropil_correction_factor", "peaks_prominence_dec_dff", "peaks_height_dec_dff", "inferred_spikes_threshold", "dec_dff_frequency", "cell_size", "total_recording_time_sec", "calcium_network_threshold", "spikes_burst_threshold", "spikes_burst_gaussian_sigma"]
_COUNTS = ["calcium_sync_jitter_window", "spikes_sync_cross_corr_lag", "spikes_burst_min_duration"]
MASKS = ["mask_coord_and_shape", "neuropil_mask_coord_and_shape"]
_FLAGS = ["active", "evoked_experiment", "stimulated"]

#: Masks are heterogeneous JSON ([[ys], [xs]], [h, w]); they are read as text parts and parsed each on its own.
ROI_JSON = T.StructType(
    [T.StructField(n, T.StringType()) for n in _TEXT]
    + [T.StructField(n, T.ArrayType(T.DoubleType())) for n in _SERIES]
    + [T.StructField("peaks_dec_dff", T.ArrayType(T.IntegerType()))]
    + [T.StructField(n, T.DoubleType()) for n in _NUMBERS]
    + [T.StructField(n, T.IntegerType()) for n in _COUNTS]
    + [T.StructField(n, T.BooleanType()) for n in _FLAGS]
    + [T.StructField("stimulations_frames_and_powers", T.MapType(T.StringType(), T.IntegerType()))]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in MASKS]
)
PIXELS = "dataset string, p int, t int, c int, z int, y int, x int, value double"
LABELS = "dataset string, p int, y int, x int, label int"
FRAME_META = "dataset string, p int, t int, pos_name string, exposure_ms double, runner_time_ms double, pixel_size_um double, index map<string,int>"
PLATE_MAP = "well string, row int, col int, condition string, color string"
