"""Population activity and bursts."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracesheaf.config import DEFAULT_FRAME_RATE
from tracesheaf.operators.traces import along


def population_activity(events: DataFrame, frames: DataFrame) -> DataFrame:
    """A4: (fov, frame, activity), the share of regions with a spike on each frame, over regions that have any; fields with under two give none.

    ``events``: (fov, roi, frame), ``frames``: (fov, n_frames).
    """
    e = events.select("fov", "roi", "frame").distinct()
    n = e.groupBy("fov").agg(F.countDistinct("roi").alias("rois")).where("rois >= 2")
    hits = e.groupBy("fov", "frame").agg(F.count("*").alias("c"))
    grid = frames.join(n, "fov").select("fov", "rois", F.explode(F.sequence(F.lit(0), (F.col("n_frames") - 1).cast("int"))).alias("frame"))
    return grid.join(hits, ["fov", "frame"], "left").select("fov", "frame", (F.coalesce("c", F.lit(0)) / F.col("rois")).alias("activity"))


def gaussian_kernel(sigma: float) -> list[tuple[int, float]]:
    radius = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [(k - radius, v / sum(w)) for k, v in enumerate(w)]


def smoothed(df: DataFrame, sigma: float, value: str = "activity", keys: list[str] = ["fov"]) -> DataFrame:
    """Adds ``smooth``, a Gaussian over frames (sigma in frames) with the ends mirrored; sigma 0 copies. Frames without a row count as 0."""
    if sigma <= 0:
        return df.withColumn("smooth", F.col(value))
    kernel = gaussian_kernel(sigma)

    def weighted(frames: np.ndarray, values: list) -> list:
        n = int(frames[-1]) + 1
        dense, total = np.zeros(n), np.zeros(len(frames))
        dense[frames] = [v or 0.0 for v in values]
        for k, w in kernel:
            at = (frames + k) % (2 * n)
            total += w * dense[np.where(at < n, at, 2 * n - 1 - at)]
        return total.tolist()

    return along(df, value, "smooth", weighted, keys)


def runs_above(df: DataFrame, value: str, threshold: float, least: int, keys: list[str] = ["fov"]) -> DataFrame:
    """(keys, burst_id, start, end) of runs above the threshold of at least ``least`` frames, end exclusive."""
    high = df.where(F.col(value) > threshold).withColumn("__g", F.col("frame") - F.row_number().over(Window.partitionBy(*keys).orderBy("frame")))
    runs = high.groupBy(*keys, "__g").agg(F.min("frame").alias("start"), (F.max("frame") + 1).alias("end")).where(F.col("end") - F.col("start") >= least)
    return runs.withColumn("burst_id", F.row_number().over(Window.partitionBy(*keys).orderBy("start"))).select(*keys, "burst_id", "start", "end")


def bursts(events: DataFrame, frames: DataFrame, threshold_pct: float = 30.0, least: int = 3, sigma: float = 2.0) -> DataFrame:
    """B1: population activity, smoothed, and its runs above a percentage."""
    return runs_above(smoothed(population_activity(events, frames), sigma), "smooth", threshold_pct / 100, least)


def burst_overlay(spikes: DataFrame, threshold_pct: float = 30.0, least: int = 3, sigma: float = 2.0) -> DataFrame:
    """B2: as B1, each active region's thresholded spikes (fov, roi, frame, value) binarised above its own 75th percentile."""
    p = spikes.groupBy("fov", "roi").agg(F.percentile("value", 0.75).alias("p75"))
    n = p.groupBy("fov").agg(F.count("*").alias("rois")).where("rois > 1")
    mean = spikes.join(p, ["fov", "roi"]).join(n, "fov").groupBy("fov", "frame").agg((F.sum((F.col("value") > F.col("p75")).cast("int")) / F.first("rois")).alias("activity"))
    return runs_above(smoothed(mean, sigma), "smooth", threshold_pct / 100, least)


def burst_statistics(found: DataFrame, frames: DataFrame, panel: bool = False) -> DataFrame:
    """A5 (exports) or A6 (``panel``): count, avg_duration_sec, avg_interval_sec, rate_burst_per_min for each field of ``frames`` (fov, n_frames, seconds).

    Exports measure to the frame after a burst, the panel to its last frame. Without recording time 10 frames a second
    count. Fields without bursts get zeros.
    """
    rate = F.when(F.coalesce("seconds", F.lit(0.0)) > 0, F.col("seconds")).otherwise((F.col("n_frames") - 1) / DEFAULT_FRAME_RATE)
    time = frames.select("fov", "n_frames", rate.alias("total")).withColumn("dt", F.try_divide("total", F.col("n_frames") - 1))
    w = Window.partitionBy("fov").orderBy("start")
    gap = (F.col("start") - (F.lag("end").over(w) - 1)) if panel else (F.lead("start").over(w) - F.col("end"))
    length = F.col("end") - F.col("start") - (1 if panel else 0)
    each = found.withColumn("gap", gap).withColumn("length", length)
    per = each.groupBy("fov").agg(F.count("*").alias("count"), F.avg("length").alias("length"), F.avg("gap").alias("gap"))
    out = time.join(per, "fov", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(
        "fov", F.coalesce("count", F.lit(0)).alias("count"), zero(F.col("length") * F.col("dt")).alias("avg_duration_sec"),
        zero(F.col("gap") * F.col("dt")).alias("avg_interval_sec"), zero(F.try_divide(F.col("count"), F.col("total") / 60)).alias("rate_burst_per_min"),
    )
