"""Measures of whole fields by condition, from records (see plans/analysis.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesheaf.config import Settings
from tracesheaf.functions.exprs import threshold_spikes
from tracesheaf.operators import bursts, events, pairs, select, stats
from tracesheaf.operators import evoked as stimulus


def spike_events(records: DataFrame, active: bool = True) -> DataFrame:
    """(fov, roi, frame, amplitude) of spikes above their threshold, of active regions only unless told otherwise."""
    rows = records.where("active") if active else records
    spikes = threshold_spikes(F.col("inferred_spikes"), F.col("inferred_spikes_threshold"))
    return rows.select("fov", "roi", F.posexplode(spikes).alias("frame", "amplitude")).where("amplitude > 0")


def peak_events(records: DataFrame) -> DataFrame:
    """(fov, roi, frame, amplitude) of the peaks of active regions."""
    return events.raster(records.where("active"), "peaks_dec_dff", "peaks_amplitudes_dec_dff")


def frame_counts(records: DataFrame) -> DataFrame:
    """(fov, n_frames, seconds): the longest trace and the mean recording time of each field."""
    return records.groupBy("fov").agg(F.max(F.size("raw_trace")).cast("long").alias("n_frames"), F.avg("total_recording_time_sec").alias("seconds"))


def conditions(records: DataFrame) -> DataFrame:
    """(fov, condition): a field lies in one well and has one condition."""
    return records.groupBy("fov").agg(F.min("condition").alias("condition"))


def peak_trains(records: DataFrame) -> DataFrame:
    """The peak events of fields that can be paired."""
    n = F.size("corrected_trace")
    return events.peak_trains(records.where("active").withColumn("n_frames", n), peaks="peaks_dec_dff")


def peak_synchrony(records: DataFrame) -> DataFrame:
    """M6: (condition, fov, value), the global synchrony of peak trains by correlation."""
    e = peak_trains(records)
    edges = pairs.synchrony("correlation", e, e, frame_counts(records), give="regions")
    return pairs.global_synchrony(edges).join(conditions(records), "fov")


def spike_synchrony(records: DataFrame) -> DataFrame:
    """M7: (condition, fov, value), as M6 on spike trains; regions that are inactive or silent take part with 0."""
    edges = pairs.synchrony("correlation", records.where("inferred_spikes is not null"), spike_events(records), frame_counts(records), give="regions")
    return pairs.global_synchrony(edges).join(conditions(records), "fov")


def network_density(records: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(condition, fov, value), the percentage of pairs of active regions that are connected; the threshold is that of the field's first region."""
    own = records.where("active")
    linked = pairs.connectivity(pairs.trace_correlation(own, "dec_dff"), settings.calcium_network_threshold)
    return pairs.network_statistics(linked, pairs.correlated_regions(own, "dec_dff")).select("fov", F.col("density_pct").alias("value")).join(conditions(records), "fov")


def burst_activity(records: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """A5 by condition: (condition, fov, count, avg_duration_sec, avg_interval_sec, rate_burst_per_min)."""
    frames = frame_counts(records)
    found = bursts.bursts(spike_events(records), frames, settings.burst_threshold, settings.burst_min_duration, settings.burst_gaussian_sigma)
    return bursts.burst_statistics(found, frames).join(conditions(records), "fov")


def stimuli(records: DataFrame) -> DataFrame:
    """(fov, frame, power, pulse) of the records' stimulations; the pulse is that of the first region."""
    pulses = select.first_setting(records, ["led_pulse_duration"]).withColumnRenamed("led_pulse_duration", "pulse")
    return stimulus.stimulus_frames(records).join(pulses, "fov")


def evoked(records: DataFrame, stimulated: bool, digits: int | None = 5) -> DataFrame:
    """(condition, fov, power_pulse, mean, sem, n) of stimulus-locked amplitudes; the LED equation is not applied."""
    rows = stimulus.evoked_amplitudes(stimuli(records), peak_events(records), records).where(F.col("stimulated") == stimulated)
    rows = rows.join(conditions(records), "fov").withColumn("condition", stimulus.evoked_condition(F.col("condition"), F.col("stimulated"), F.col("power_pulse")))
    return stats.grouped_mean(rows, "amplitude", ["condition", "fov", "power_pulse"], digits)
