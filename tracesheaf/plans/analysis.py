"""From pixels to records: one lazy plan, keyed by (dataset, p, roi)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesheaf.config import MIN_AREA, Settings
from tracesheaf.functions import exprs
from tracesheaf.operators import deconv, events, evoked, pixels, select, traces
from tracesheaf.operators.pixels import AT
from tracesheaf.schemas import ROI_JSON

KEYS = [*AT, "roi"]


def analyse(
    pixel_table: DataFrame, labels: DataFrame, frame_meta: DataFrame, settings: Settings = Settings(), plate: DataFrame | None = None, height: int = 0, width: int = 0,
    stim_pixels: DataFrame | None = None, stimuli: DataFrame | None = None,
) -> DataFrame:
    """Records of all regions of positions that have labels, with every field of recorded results.

    With neuropil correction on (radius and pixels above 0) the eroded mask carries trace and area, and the ring's mean times the factor is
    taken off; otherwise the neuropil fields are null. ``plate``: (well, condition_1, condition_2). ``stim_pixels`` (y, x, and dataset and p where they
    differ by position), the stimulated area, and ``stimuli`` (dataset, p, frame, power, pulse) make an evoked experiment.
    """
    ring_on = settings.neuropil_inner_radius > 0 and settings.neuropil_min_pixels > 0
    cells = pixels.erode(labels) if ring_on else labels.where("label <> 0")
    long = pixels.roi_traces(pixel_table, cells).withColumnRenamed("label", "roi")
    if ring_on:
        ring = pixels.neuropil_ring(labels, settings.neuropil_inner_radius, settings.neuropil_min_pixels, height, width)
        around = pixels.roi_traces(pixel_table, ring).withColumnRenamed("label", "roi")
        long = traces.neuropil_corrected(long, around, settings.neuropil_correction_factor, KEYS).withColumnRenamed("value", "raw")
    else:
        long = long.select("*", F.lit(None).cast("double").alias("neuropil"), F.col("value").alias("corrected")).withColumnRenamed("value", "raw")
    based = traces.delta_f(long, settings.dff_window, value="corrected", keys=KEYS)
    rows = F.array_sort(F.collect_list(F.struct("frame", "raw", "neuropil", "corrected", "dff")))
    recs = based.groupBy(*KEYS).agg(rows.alias("r"), F.count("neuropil").alias("ringed"))
    recs = recs.select(*KEYS, F.col("r.raw").alias("raw_trace"), F.when(F.col("ringed") > 0, F.col("r.neuropil")).alias("neuropil_trace"), F.col("r.corrected").alias("corrected_trace"), F.col("r.dff").alias("dff"))

    times = traces.elapsed_times(frame_meta, AT)
    per = times.groupBy(*AT).agg(F.array_sort(F.collect_list(F.struct("t", "t_ms"))).alias("tt"), F.first("pos_name").alias("pos_name"), F.first("pixel_size_um").alias("px"))
    per = per.select(*AT, "pos_name", "px", F.col("tt.t_ms").alias("times"), ((F.array_max("tt.t_ms") - F.array_min("tt.t_ms")) / 1000).alias("seconds"))
    masks = pixels.to_masks(cells, height, width).select(*AT, F.col("label").alias("roi"), F.col("mask").alias("mask_coord_and_shape"))
    recs = recs.join(per, AT).join(masks, KEYS)
    if ring_on:
        rings = pixels.to_masks(ring, height, width).select(*AT, F.col("label").alias("roi"), F.col("mask").alias("neuropil_mask_coord_and_shape"))
        recs = recs.join(rings, KEYS, "left")
    else:
        recs = recs.withColumn("neuropil_mask_coord_and_shape", F.lit(None).cast(masks.schema["mask_coord_and_shape"].dataType))
    recs = recs.withColumn("cell_size", exprs.cell_area(F.size("mask_coord_and_shape.ys"), F.col("px"))).where((F.coalesce("px", F.lit(0.0)) == 0) | (F.col("cell_size") >= MIN_AREA))
    recs = _stimulation(recs, cells, stim_pixels, stimuli)
    recs = deconv.deconvolve(recs, "dff", "seconds", settings.decay_constant).withColumnsRenamed({"dec": "dec_dff", "spikes": "inferred_spikes"})
    recs = events.detect_peaks(recs, "dec_dff", settings)
    positive = F.filter("inferred_spikes", lambda v: v > 0)
    reference = exprs.let(F.array_sort(positive), lambda s: F.when(F.size(s) > 5, _interpolated(s, 0.05)).otherwise(0.01))
    fixed = settings.spike_threshold_mode.startswith("global")
    recs = recs.withColumn("inferred_spikes_threshold", F.lit(settings.spike_threshold_value) if fixed else reference * settings.spike_threshold_value)
    recs = recs.withColumn("fov", exprs.fov_name(F.col("pos_name"), F.col("p"))).withColumn("well", exprs.well_name(F.col("fov")))
    recs = recs.join(plate, "well", "left") if plate is not None else recs.withColumns({"condition_1": F.lit(None).cast("string"), "condition_2": F.lit(None).cast("string")})
    parameters = {
        "neuropil_correction_factor": settings.neuropil_correction_factor if ring_on else None, "calcium_network_threshold": settings.calcium_network_threshold,
        "calcium_sync_jitter_window": settings.calcium_sync_jitter_window, "spikes_sync_cross_corr_lag": settings.spikes_sync_cross_corr_lag,
        "spikes_burst_threshold": settings.burst_threshold, "spikes_burst_min_duration": settings.burst_min_duration, "spikes_burst_gaussian_sigma": settings.burst_gaussian_sigma,
        "led_power_equation": settings.led_power_equation or None,
    }
    kinds = {f.name: f.dataType for f in ROI_JSON}
    return recs.select(
        "fov", "roi", F.col("fov").alias("well_fov_position"), "condition_1", "condition_2", exprs.condition_key(F.col("condition_1"), F.col("condition_2")).alias("condition"),
        "raw_trace", "neuropil_trace", "corrected_trace", "dff", "dec_dff", "inferred_spikes", "inferred_spikes_threshold", F.col("peaks").alias("peaks_dec_dff"), F.col("amplitudes").alias("peaks_amplitudes_dec_dff"),
        F.col("peaks_height").alias("peaks_height_dec_dff"), F.col("peaks_prominence").alias("peaks_prominence_dec_dff"), events.frequency(F.col("peaks"), F.col("seconds")).alias("dec_dff_frequency"),
        events.inter_event_intervals(F.col("peaks"), F.col("times")).alias("iei"), "cell_size", exprs.area_unit(F.col("px")).alias("cell_size_units"),
        F.col("seconds").alias("total_recording_time_sec"), select.active().alias("active"), "evoked_experiment", "stimulated", "stimulations_frames_and_powers", "led_pulse_duration",
        "mask_coord_and_shape", "neuropil_mask_coord_and_shape", *[F.lit(v).cast(kinds[k]).alias(k) for k, v in parameters.items()],
    )


def _stimulation(recs: DataFrame, cells: DataFrame, stim_pixels: DataFrame | None, stimuli: DataFrame | None) -> DataFrame:
    """Adds evoked_experiment, stimulated, stimulations_frames_and_powers and led_pulse_duration."""
    if stim_pixels is not None:
        keys = [k for k in AT if k in stim_pixels.columns]
        lab = cells.select(*AT, F.col("label").alias("roi"), "y", "x")
        flags = evoked.stimulated(evoked.overlap(lab, stim_pixels, KEYS, keys)).select(*KEYS, "stimulated")
        recs = recs.join(flags, KEYS, "left")
    recs = recs.withColumn("stimulated", F.coalesce("stimulated", F.lit(False)) if stim_pixels is not None else F.lit(False))
    if stimuli is None:
        empty = {"stimulations_frames_and_powers": "map<string,int>", "led_pulse_duration": "string"}
        return recs.withColumns({"evoked_experiment": F.lit(stim_pixels is not None)} | {k: F.lit(None).cast(t) for k, t in empty.items()})
    pairs = F.array_sort(F.collect_set(F.struct(F.col("frame").cast("string").alias("key"), F.col("power").cast("int").alias("value"))))
    per = stimuli.groupBy(*AT).agg(F.map_from_entries(pairs).alias("stimulations_frames_and_powers"), F.min_by(F.col("pulse").cast("string"), "frame").alias("led_pulse_duration"))
    return recs.join(per, AT, "left").withColumn("evoked_experiment", F.lit(True))


def _interpolated(s, q: float):
    """The q-quantile of a sorted array, linear between neighbours."""
    at = (F.size(s) - 1) * q
    lo = F.floor(at).cast("int")
    return F.get(s, lo) + (F.get(s, F.least(lo + 1, F.size(s) - 1)) - F.get(s, lo)) * (at - lo)
