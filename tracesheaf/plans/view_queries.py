"""Every view as a registered query ``view_<name>``, over records that the adapters' tables give. The SQL is in plans/view_sql.py."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracesheaf.config import Settings
from tracesheaf.operators import events, grouped, pixels, stats, traces
from tracesheaf.operators.evoked import overlap, stimulated
from tracesheaf.plans.views import GROUPED, SINGLE, view
from tracesheaf.sources import adapters as A

#: Height and prominence of one noise level, bursts from a fifth of the regions on.
SETTINGS = Settings(peaks_height_value=1.0, burst_threshold=20.0)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tr`` as records: its values are the deconvolved trace, twice them the raw one, three times the spikes, a quarter the neuropil, half of which is taken off the values."""
    tr = A.traces(spark, sf_dir)
    rows = F.array_sort(F.collect_list(F.struct("frame", "value", "t_ms")))
    a = tr.groupBy("fov", "roi").agg(rows.alias("r"), ((F.max("t_ms") - F.min("t_ms")) / 1000).alias("seconds"), (F.percentile("value", 0.75) * 3).alias("inferred_spikes_threshold"))
    a = a.select("fov", "roi", F.col("r.value").alias("trace"), F.col("r.t_ms").alias("times"), "seconds", "inferred_spikes_threshold")
    p = events.detect_peaks(a, "trace", SETTINGS)
    power = F.map_from_entries(F.collect_list(F.struct(F.col("frame").cast("string"), "power")))
    stim = A.stimuli(spark, sf_dir).groupBy("fov").agg(power.alias("stimulations_frames_and_powers"))
    p = p.join(stim, "fov", "left")
    times = lambda k: F.transform("trace", lambda v: v * k)
    quarter, twice, thrice = times(0.25), times(2), times(3)
    return A.conditions(p).select(
        "fov", "roi", "condition", twice.alias("raw_trace"), quarter.alias("neuropil_trace"), F.zip_with("trace", quarter, lambda v, n: v - 0.5 * n).alias("corrected_trace"),
        F.col("trace").alias("dec_dff"), thrice.alias("inferred_spikes"), "inferred_spikes_threshold", F.col("peaks").alias("peaks_dec_dff"), F.col("amplitudes").alias("peaks_amplitudes_dec_dff"),
        F.col("peaks_height").alias("peaks_height_dec_dff"), F.col("peaks_prominence").alias("peaks_prominence_dec_dff"), events.frequency(F.col("peaks"), F.col("seconds")).alias("dec_dff_frequency"),
        events.inter_event_intervals(F.col("peaks"), F.col("times")).alias("iei"), (40 + F.col("roi") % 7).cast("double").alias("cell_size"), F.lit("µm").alias("cell_size_units"),
        F.col("seconds").alias("total_recording_time_sec"), (F.size("peaks") > 0).alias("active"), (F.col("roi") % 4 == 0).alias("stimulated"), "stimulations_frames_and_powers", F.lit("100").alias("led_pulse_duration"),
    )


def dff_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fov, roi, dff) of ``tr``."""
    return traces.to_arrays(traces.delta_f(A.traces(spark, sf_dir)), "dff", "dff")


def vector_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``arr`` as records of 64 frames: all active, spikes above 0.15, one pixel a region."""
    arr = A.arrays(spark, sf_dir)
    place = F.struct(F.array(F.col("roi") % 32).alias("ys"), F.array(F.col("roi") % 29).alias("xs"), F.lit(32).alias("h"), F.lit(32).alias("w"))
    return arr.select("fov", "roi", F.col("trace").alias("dec_dff"), F.col("trace").alias("inferred_spikes"), F.lit(0.15).alias("inferred_spikes_threshold"), F.lit(True).alias("active"), place.alias("mask_coord_and_shape"))


def mask_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fov, roi, both masks) of ``lab``."""
    lab = A.labels(spark, sf_dir)
    ring = pixels.to_masks(pixels.neuropil_ring(lab, 1, 20, 32, 32), 32, 32).withColumnRenamed("mask", "neuropil_mask_coord_and_shape")
    both = pixels.to_masks(lab, 32, 32).withColumnRenamed("mask", "mask_coord_and_shape").join(ring, [*pixels.AT, "label"])
    return both.select(F.col("p").alias("fov"), F.col("label").alias("roi"), "mask_coord_and_shape", "neuropil_mask_coord_and_shape")


def by_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``records`` with each field cut by condition, so that a field has one condition."""
    return records(spark, sf_dir).withColumn("fov", F.concat_ws("_", F.col("fov").cast("string"), "condition"))


def _area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.labels(spark, sf_dir).where("(y - 14) * (y - 14) + (x - 12) * (x - 12) < 90").select("y", "x").distinct()


def _classes(spark: SparkSession, sf_dir: str, area: bool) -> DataFrame:
    lab = A.labels(spark, sf_dir).select(F.col("p").alias("fov"), F.col("label").alias("roi"), "y", "x")
    flags = stimulated(overlap(lab, _area(spark, sf_dir)))
    return view("stim_rois_area" if area else "stim_rois", lab, SETTINGS, flags=flags, **({"area": _area(spark, sf_dir)} if area else {}))


def _stim_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = pixels.max_projection(A.pixels(spark, sf_dir)).select(*pixels.AT, F.col("y").cast("int"), F.col("x").cast("int"), "value")
    return view("stim_area", image, SETTINGS, height=32, width=32, keys=pixels.AT).drop("dataset")


_DFF = ["dff", "dff_normalized"]
_VECTORS = ["network", "connectivity_matrix", "trace_xcorr", "trace_clustering", "trace_dendrogram", "spike_xcorr", "spike_clustering", "spike_dendrogram"]


def _single(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    source = dff_records if name in _DFF else vector_records if name in _VECTORS else mask_records if name == "neuropil_masks" else records
    return view(name, source(spark, sf_dir), SETTINGS)


def _evoked_rows(spark: SparkSession, sf_dir: str, stim: bool) -> DataFrame:
    return grouped.evoked(by_condition(spark, sf_dir), stim, digits=None)


def _mean(column: str):
    return lambda spark, sf_dir: stats.grouped_mean(records(spark, sf_dir), column, digits=None)


_ROWS = {
    "mw_cell_size": _mean("cell_size"),
    "mw_amplitude": _mean("peaks_amplitudes_dec_dff"),
    "mw_frequency": _mean("dec_dff_frequency"),
    "mw_iei": _mean("iei"),
    "mw_percentage_active": lambda spark, sf_dir: stats.percentage_active(records(spark, sf_dir).withColumn("active", F.size("peaks_dec_dff") > 8), digits=None),
    "mw_peak_synchrony": lambda spark, sf_dir: grouped.peak_synchrony(by_condition(spark, sf_dir)),
    "mw_spike_synchrony": lambda spark, sf_dir: grouped.spike_synchrony(by_condition(spark, sf_dir)),
    "mw_stim_amplitude": partial(_evoked_rows, stim=True),
    "mw_non_stim_amplitude": partial(_evoked_rows, stim=False),
} | {f"mw_burst_{k}": lambda spark, sf_dir: grouped.burst_activity(by_condition(spark, sf_dir), SETTINGS) for k in ("count", "duration", "interval", "rate")}


def _multi(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(name, _ROWS[name](spark, sf_dir))


def queries() -> dict:
    own = {"stim_rois": partial(_classes, area=False), "stim_rois_area": partial(_classes, area=True), "stim_area": _stim_area}
    found = {n: own.get(n, partial(_single, n)) for n in SINGLE} | {n: partial(_multi, n) for n in GROUPED}
    return {f"view_{n}": f for n, f in found.items()}
