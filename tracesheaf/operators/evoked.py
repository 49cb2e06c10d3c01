"""Stimulus-locked operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesheaf.config import MAX_FRAMES_AFTER_STIMULUS, STIM_OVERLAP
from tracesheaf.functions.exprs import numeric_intensity, power_label
from tracesheaf.operators.stats import grouped_mean, sem_population


def forward_asof(stimuli: DataFrame, events: DataFrame, tolerance: int = MAX_FRAMES_AFTER_STIMULUS, keys: list[str] = ["fov"]) -> DataFrame:
    """Each stimulus with every region's first event at or after it, at most ``tolerance`` frames later.

    An equi-join on frame buckets: an event lies in the stimulus' bucket or the next one. One event may serve two stimuli.
    """
    size = tolerance + 1
    s = stimuli.withColumnRenamed("frame", "stim_frame").withColumn("__b", F.explode(F.array(F.floor(F.col("stim_frame") / size), F.floor(F.col("stim_frame") / size) + 1)))
    e = events.withColumn("__b", F.floor(F.col("frame") / size))
    hit = s.join(e, [*keys, "__b"]).where((F.col("frame") >= F.col("stim_frame")) & (F.col("frame") <= F.col("stim_frame") + tolerance))
    extra = [c for c in stimuli.columns if c not in (*keys, "frame")]
    return hit.groupBy(*keys, "roi", "stim_frame", *extra).agg(F.min("frame").alias("frame"), F.min_by("amplitude", "frame").alias("amplitude"))


def first_after(peaks: Column, frame: Column, tolerance: int = MAX_FRAMES_AFTER_STIMULUS) -> Column:
    """J11 on a sorted array of peaks."""
    return F.get(F.filter(peaks, lambda p: (p >= frame) & (p <= frame + tolerance)), F.lit(0))


def overlap(labels: DataFrame, stim_pixels: DataFrame, keys: list[str] = ["fov", "roi"], at: list[str] = []) -> DataFrame:
    """Each region's share of pixels inside the stimulated area, which is one for all images or differs by ``at``."""
    s = stim_pixels.select(*at, "y", "x").distinct().withColumn("__s", F.lit(1))
    return labels.join(s, [*at, "y", "x"], "left").groupBy(*keys).agg((F.count("__s") / F.count("*")).alias("overlap"))


def stimulated(overlaps: DataFrame, least: float = STIM_OVERLAP) -> DataFrame:
    """Adds ``stimulated``, overlap above a tenth."""
    return overlaps.withColumn("stimulated", F.col("overlap") > least)


def evoked_amplitudes(stimuli: DataFrame, events: DataFrame, rois: DataFrame, equation: str | None = None) -> DataFrame:
    """(fov, roi, stimulated, power_pulse, amplitude). ``stimuli``: (fov, frame, power, pulse); ``rois``: (fov, roi, stimulated)."""
    hits = forward_asof(stimuli, events).withColumn("power_pulse", power_label(F.col("power"), equation, F.col("pulse")))
    flags = rois.select("fov", "roi", F.coalesce("stimulated", F.lit(False)).alias("stimulated"))
    return hits.join(flags, ["fov", "roi"]).select("fov", "roi", "stimulated", "power_pulse", "amplitude")


def evoked_condition(condition: Column, stim: Column, power_pulse: Column) -> Column:
    """``<condition>_evk_stim_<power>_<pulse>`` or ``…_evk_non_stim_…``."""
    return F.concat_ws("_", condition, F.when(stim, "evk_stim").otherwise("evk_non_stim"), power_pulse)


def by_condition(evoked: DataFrame, conditions: DataFrame, digits: int | None = 5) -> DataFrame:
    """Mean, sem, n of evoked amplitudes by evoked condition and field; X2: regions of a field are pooled by label."""
    c = evoked.join(conditions.select("fov", "condition").distinct(), "fov")
    c = c.withColumn("condition", evoked_condition(F.col("condition"), F.col("stimulated"), F.col("power_pulse")))
    return grouped_mean(c, "amplitude", digits=digits)


def panel(evoked: DataFrame) -> DataFrame:
    """Mean and population error of evoked amplitudes by field, stimulation and power label."""
    return evoked.groupBy("fov", "stimulated", "power_pulse").agg(F.avg("amplitude").alias("mean"), sem_population("amplitude").alias("err"), F.count("amplitude").alias("n"))


def by_power(rows: DataFrame) -> DataFrame:
    """Rows in order of field and LED power, the number at the start of the power label."""
    return rows.orderBy("fov", numeric_intensity(F.col("power_pulse"), 0), "power_pulse")


def label_class(labels: DataFrame, flags: DataFrame) -> DataFrame:
    """Each pixel's class: stimulated, non_stimulated, or other for regions without a record."""
    f = flags.select("fov", "roi", "stimulated")
    return labels.join(f, ["fov", "roi"], "left").withColumn("class", F.when(F.col("stimulated").isNull(), "other").when(F.col("stimulated"), "stimulated").otherwise("non_stimulated")).drop("stimulated")


def stimulus_frames(df: DataFrame, column: str = "stimulations_frames_and_powers") -> DataFrame:
    """Rows (fov, frame, power) from the records' map of frames to powers."""
    return df.select("fov", F.explode(column).alias("k", "power")).select("fov", F.col("k").cast("int").alias("frame"), "power").distinct()
