"""Peaks, spikes and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracesheaf.config import Settings
from tracesheaf.functions.exprs import let
from tracesheaf.operators.traces import KEYS, noise_of


def local_maxima(trace: Column) -> Column:
    """Frames of local maxima in one pass; of a plateau its middle sample, rounded down. Ends of the trace are never maxima."""
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(None).cast("double").alias("prev"), F.lit(-1).alias("rise"), F.lit(0).alias("i"), none.alias("out"))

    def step(a: Column, x: Column) -> Column:
        fell = (x < a["prev"]) & (a["rise"] >= 0)
        rise = F.when(x > a["prev"], a["i"]).when(x < a["prev"], -1).otherwise(a["rise"])
        middle = F.floor((a["rise"] + a["i"] - 1) / 2).cast("int")
        out = F.when(fell, F.concat(a["out"], F.array(middle))).otherwise(a["out"])
        return F.struct(x.cast("double").alias("prev"), rise.alias("rise"), (a["i"] + 1).alias("i"), out.alias("out"))

    return F.aggregate(trace, start, step, lambda a: a["out"])


def prominence(trace: Column, p: Column) -> Column:
    """Height above the higher of the two lowest points on the way to a higher sample, or to the end, on each side."""

    def of(v: Column) -> Column:
        n = F.size(trace)
        left = F.array_position(F.reverse(F.transform(F.slice(trace, 1, p), lambda x: x > v)), True)
        right = F.array_position(F.transform(F.slice(trace, p + 2, n), lambda x: x > v), True)
        before = let(left, lambda k: F.when(k > 0, k.cast("int") - 1).otherwise(p))
        after = let(right, lambda k: F.when(k > 0, k.cast("int") - 1).otherwise(n - p - 1))
        low_left = let(before, lambda k: F.array_min(F.slice(trace, p - k + 1, k + 1)))
        low_right = let(after, lambda k: F.array_min(F.slice(trace, p + 1, k + 1)))
        return v - F.greatest(low_left, low_right)

    return let(F.get(trace, p), lambda v: of(v))


def apart(trace: Column, peaks: Column, distance: int) -> Column:
    """Peaks at least ``distance`` frames apart, higher ones first (of equal ones the later)."""
    if distance <= 2:  # strict maxima are two frames apart anyway
        return peaks
    ranked = F.array_sort(F.transform(peaks, lambda p: F.struct((-F.get(trace, p)).alias("h"), (-p).alias("p"))))
    keep = lambda out, s: F.when(F.exists(out, lambda q: F.abs(q + s["p"]) < distance), out).otherwise(F.concat(out, F.array(-s["p"])))
    return F.array_sort(F.aggregate(ranked, F.array().cast("array<int>"), keep))


def peaks_of(trace: Column, height: Column, least: Column, distance: int = 2) -> Column:
    """Frames of peaks: height, then distance, then prominence."""
    high = let(F.filter(local_maxima(trace), lambda p: F.get(trace, p) >= height), lambda c: apart(trace, c, distance))
    return F.filter(high, lambda p: prominence(trace, p) >= least)


def find_peaks(df: DataFrame, trace: str, height: Column, prominence_at_least: Column, distance: int = 2, out: str = "peaks") -> DataFrame:
    """Adds ``out``, frames of peaks. Null traces give null, short ones an empty array."""
    both = F.struct(height.alias("h"), prominence_at_least.alias("p"))
    return df.withColumn(out, let(both, lambda x: peaks_of(F.col(trace), x["h"], x["p"], distance)))


def height_threshold(noise: Column, settings: Settings) -> Column:
    """A fixed value, or a multiple of the noise level."""
    return F.lit(settings.peaks_height_value) if settings.peaks_height_mode.startswith("global") else noise * settings.peaks_height_value


def detect_peaks(df: DataFrame, trace: str = "trace", settings: Settings = Settings()) -> DataFrame:
    """D4 to D8 on array traces: adds noise, peaks_height, peaks_prominence, peaks and peak amplitudes."""
    t = F.col(trace)

    def thresholds(noise: Column) -> Column:
        return F.struct(noise.alias("noise"), height_threshold(noise, settings).alias("peaks_height"), (noise * settings.peaks_prominence_multiplier).alias("peaks_prominence"))

    def found(x: Column) -> Column:
        return let(peaks_of(t, x["peaks_height"], x["peaks_prominence"], settings.peaks_distance), lambda p: F.struct(x["noise"].alias("noise"), x["peaks_height"].alias("peaks_height"), x["peaks_prominence"].alias("peaks_prominence"), p.alias("peaks"), F.transform(p, lambda i: F.get(t, i)).alias("amplitudes")))

    got = let(let(noise_of(t), lambda n: thresholds(n)), lambda x: found(x))
    return df.withColumn("__d", got).select(*df.columns, "__d.*")


def frequency(peaks: Column, seconds: Column) -> Column:
    """Peaks a second; null without peaks or time."""
    return F.when((F.size(peaks) > 0) & (seconds > 0), F.size(peaks) / seconds)


def inter_event_intervals(peaks: Column, times_ms: Column) -> Column:
    """Seconds between successive peaks; null with under two peaks or time stamps."""
    at = F.transform(peaks, lambda p: F.get(times_ms, p))
    gaps = F.zip_with(F.slice(at, 2, F.size(at)), F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))), lambda b, a: (b - a) / 1000)
    return F.when((F.size(peaks) >= 2) & (F.size(times_ms) > 1), gaps)


def interval_rows(events: DataFrame, t: str = "t_ms", keys: list[str] = KEYS) -> DataFrame:
    """W3 on event rows (keys, t): adds ``iei``, null on the first of each key; of equal times the lower frame comes first."""
    order = Window.partitionBy(*keys).orderBy(t, *(["frame"] if "frame" in events.columns else []))
    return events.withColumn("iei", (F.col(t) - F.lag(t).over(order)) / 1000)


def spike_thresholds(spikes: DataFrame, settings: Settings = Settings(), value: str = "value", keys: list[str] = KEYS) -> DataFrame:
    """(keys, reference, threshold) from long spike trains: the 5th percentile of positive spikes if over five, else 0.01."""
    positive = F.when(F.col(value) > 0, F.col(value))
    got = spikes.groupBy(*keys).agg(F.count(positive).alias("n"), F.percentile(positive, 0.05).alias("p5"))
    reference = F.when(F.col("n") > 5, F.col("p5")).otherwise(0.01)
    fixed = settings.spike_threshold_mode.startswith("global")
    threshold = F.lit(settings.spike_threshold_value) if fixed else reference * settings.spike_threshold_value
    return got.select(*keys, reference.alias("reference"), threshold.alias("threshold"))


def events_above(spikes: DataFrame, thresholds: DataFrame, value: str = "value", keys: list[str] = KEYS) -> DataFrame:
    """Rows (keys, frame, amplitude) of spikes above their region's threshold."""
    hit = spikes.join(thresholds.select(*keys, "threshold"), keys).where((F.col(value) > F.col("threshold")) & (F.col(value) > 0))
    return hit.select(*keys, "frame", F.col(value).alias("amplitude"))


def raster(df: DataFrame, peaks: str = "peaks", amplitudes: str = "amplitudes", keys: list[str] = KEYS) -> DataFrame:
    """A row (keys, frame, amplitude) for each peak."""
    zipped = F.explode(F.arrays_zip(F.col(peaks).alias("frame"), F.col(amplitudes).alias("amplitude")))
    return df.select(*keys, zipped.alias("e")).select(*keys, "e.frame", "e.amplitude")


def peak_trains(df: DataFrame, n_frames: str = "n_frames", peaks: str = "peaks", corrected: str | None = "corrected_trace") -> DataFrame:
    """Event rows of active regions with in-range peaks; fields with under two such regions, or with an active region without trace, give none."""
    rows = df.where(F.size(peaks) > 0)
    if corrected:
        rows = rows.withColumn("__ok", F.bool_and(F.col(corrected).isNotNull()).over(Window.partitionBy("fov"))).where("__ok").drop("__ok")
    e = rows.select("fov", "roi", F.col(n_frames).alias("n_frames"), F.explode(peaks).alias("frame")).where((F.col("frame") >= 0) & (F.col("frame") < F.col("n_frames")))
    w = Window.partitionBy("fov")
    return e.withColumn("__lo", F.min("roi").over(w)).withColumn("__hi", F.max("roi").over(w)).where("__lo < __hi").drop("__lo", "__hi")


def color_scale(events: DataFrame, amplitude: str = "amplitude", spikes: bool = False) -> DataFrame:
    """adds vmin and vmax of each field. Peaks: half the maximum, else the maximum, else minimum + 0.1; spikes: half way up."""
    w = Window.partitionBy("fov")
    lo, hi = F.min(amplitude).over(w), F.max(amplitude).over(w)
    half = F.when(hi * 0.5 > lo, hi * 0.5).when(hi > lo, hi).otherwise(lo + 0.1)
    return events.withColumn("vmin", lo).withColumn("vmax", lo + (hi - lo) * 0.5 if spikes else half)


def region_shade(scaled: DataFrame, amplitude: str = "amplitude") -> DataFrame:
    """adds each region's mean_amplitude and its shade, the place of that mean between vmin and vmax, within 0 to 1."""
    mean = F.avg(amplitude).over(Window.partitionBy("fov", "roi"))
    place = (F.col("mean_amplitude") - F.col("vmin")) / (F.col("vmax") - F.col("vmin"))
    return scaled.withColumn("mean_amplitude", mean).withColumn("shade", F.least(F.lit(1.0), F.greatest(F.lit(0.0), place)))
