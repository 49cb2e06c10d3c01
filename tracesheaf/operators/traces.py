"""Trace operators on long traces (fov, roi, frame, value) and array traces (fov, roi, trace)."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracesheaf.functions.exprs import let
from tracesheaf.sources.scratch import saved

KEYS = ["fov", "roi"]


def to_arrays(df: DataFrame, value: str = "value", out: str = "trace", keys: list[str] = KEYS) -> DataFrame:
    """Long traces as one array for each key, in order of frame."""
    pairs = F.array_sort(F.collect_list(F.struct("frame", F.col(value).alias("v"))))
    return df.groupBy(*keys).agg(F.transform(pairs, lambda s: s["v"]).alias(out))


def to_long(df: DataFrame, trace: str = "trace", keys: list[str] = KEYS) -> DataFrame:
    """Array traces as rows (keys, frame, value)."""
    return df.select(*keys, F.posexplode(trace).alias("frame", "value"))


def sliding_percentile(values: list[float | None], half: int, q: float) -> list[float | None]:
    """The q-quantile of each value's neighbours up to ``half`` away, linear between two of them; nulls do not count, NaN is the greatest.

    One pass over a sorted window, which gains and loses a value at each step: the work hardly grows with the window.
    """
    window, blanks, out, n = [], 0, [], len(values)
    for i in range(-half, n):
        if i + half < n and (v := values[i + half]) is not None:
            if v != v:
                blanks += 1
            else:
                insort(window, v)
        if i > half and (v := values[i - half - 1]) is not None:
            if v != v:
                blanks -= 1
            else:
                del window[bisect_left(window, v)]
        if i >= 0:
            held = len(window)
            at = (held + blanks - 1) * q
            lo = int(at)
            hi = lo + (at > lo)
            if not held + blanks:
                out.append(None)
            elif hi >= held:
                out.append(math.nan if hi > lo or lo >= held else window[lo])
            else:
                out.append(window[lo] if lo == hi or window[lo] == window[hi] else (hi - at) * window[lo] + (at - lo) * window[hi])
    return out


def along(df: DataFrame, value: str, out: str, work: Callable[[np.ndarray, list], list], keys: list[str]) -> DataFrame:
    """Adds ``out``, what ``work`` (frames, values, both in order of frame) gives for each trace.

    A trace's rows meet in one array, as they do in a window, and only its frames and values go to Python.
    """
    rows = df.groupBy(*keys).agg(F.collect_list(F.struct(*[c for c in df.columns if c not in (*keys, out)])).alias("__rows"))

    @F.arrow_udf("array<double>")
    def each(frames: pa.Array, values: pa.Array) -> pa.Array:
        ends = values.offsets.to_numpy() - values.offsets[0].as_py()
        flat, order, found = values.flatten().to_pylist(), frames.flatten().to_numpy(zero_copy_only=False), []
        for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist()):
            by = np.argsort(order[lo:hi], kind="stable")
            result = work(order[lo:hi][by], [flat[lo + k] for k in by.tolist()])
            back = np.empty(hi - lo, np.int64)
            back[by] = np.arange(hi - lo)
            found += [result[k] for k in back.tolist()]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found, pa.float64()))

    made = rows.withColumn("__out", each(F.col("__rows.frame").cast("array<long>"), F.col(f"__rows.{value}").cast("array<double>")))
    one = made.select(*keys, F.explode(F.arrays_zip(F.col("__rows").alias("r"), F.col("__out").alias("o"))).alias("__z"))
    return one.select(*[F.col(c) if c in keys else F.col(f"__z.r.{c}") for c in df.columns if c != out], F.col("__z.o").alias(out))


def sliding_baseline(df: DataFrame, window: int = 30, percentile: float = 10.0, value: str = "value", keys: list[str] = KEYS) -> DataFrame:
    """Adds ``baseline``, the percentile over the frames within half a window on both sides (cut at the ends)."""
    return along(df, value, "baseline", lambda _, v: sliding_percentile(v, window // 2, percentile / 100), keys)


def delta_f(df: DataFrame, window: int = 30, percentile: float = 10.0, value: str = "value", keys: list[str] = KEYS) -> DataFrame:
    """Adds ``dff`` = (F - baseline) / baseline, null where the baseline is 0."""
    based = sliding_baseline(df, window, percentile, value, keys)
    return based.withColumn("dff", F.try_divide(F.col(value) - F.col("baseline"), F.col("baseline")))


def neuropil_corrected(traces: DataFrame, neuropil: DataFrame, factor: float, keys: list[str] = KEYS) -> DataFrame:
    """Value - factor * neuropil on each frame; a region without a ring keeps its trace."""
    n = neuropil.select(*keys, "frame", F.col("value").alias("neuropil"))
    return traces.join(n, [*keys, "frame"], "left").withColumn("corrected", F.col("value") - factor * F.coalesce("neuropil", F.lit(0.0)))


def noise_level(df: DataFrame, value: str = "value", keys: list[str] = KEYS) -> DataFrame:
    """Median absolute deviation over 0.6745 for each trace."""
    centre = df.groupBy(*keys).agg(F.percentile(value, 0.5).alias("m"))
    return df.join(centre, keys).groupBy(*keys).agg((F.percentile(F.abs(F.col(value) - F.col("m")), 0.5) / 0.6745).alias("noise"))


def median_of(trace: Column) -> Column:
    def middle(s: Column) -> Column:
        n = F.size(s)
        return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)

    return let(F.array_sort(trace), lambda s: middle(s))


def noise_of(trace: Column) -> Column:
    """A11 on an array trace."""
    return let(median_of(trace), lambda m: median_of(F.transform(trace, lambda v: F.abs(v - m)))) / 0.6745


def zscore(df: DataFrame, value: str = "value", keys: list[str] = KEYS, zero: bool = False) -> DataFrame:
    """Adds ``z`` by population deviation; a flat trace gives null, or 0 where ``zero``."""
    w = Window.partitionBy(*keys)
    z = F.try_divide(F.col(value) - F.avg(value).over(w), F.stddev_pop(value).over(w))
    return df.withColumn("z", F.coalesce(z, F.lit(0.0)) if zero else z)


def _bin(value: Column) -> Column:
    """A whole number that never falls as the value rises: a 1,024th of a power of two, by sign."""
    level = F.floor((F.least(F.log2(F.abs(value)), F.lit(1025.0)) + 1100) * 1024) + 1
    return F.when(F.isnan(value), F.lit(1 << 40)).when(value == 0, F.lit(0)).otherwise(F.when(value > 0, level).otherwise(-level)).cast("long")


def _ranked(parts: DataFrame, q: float, keys: list[str], known: DataFrame | None = None) -> DataFrame:
    """Adds to parts of groups (keys, __part, __n, __m), in order of value: __before, the rank __at, top, and whether a part holds the neighbour below (__lower), above (__upper).

    ``known``: (keys, __skip, __at, top) where the parts are not all of a group but follow __skip others.
    """
    whole = Window.partitionBy(*keys)
    before = F.sum("__n").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    if known is None:
        per = parts.select(*keys, "__part", "__n", before.alias("__before"), ((F.sum("__n").over(whole) - 1) * F.lit(q)).alias("__at"), F.max("__m").over(whole).alias("top"))
    else:
        per = parts.join(F.broadcast(known.select(*keys, "__skip", "__at", "top")), keys).select(*keys, "__part", "__n", (before + F.col("__skip")).alias("__before"), "__at", "top")
    return per.withColumns({f"__{k}": (F.col("__before") <= edge("__at")) & (edge("__at") < F.col("__before") + F.col("__n")) for k, edge in (("lower", F.floor), ("upper", F.ceil))})


def exact_percentile(df: DataFrame, value: str, q: float, keys: list[str], weight: str | None = None, coarse: bool = False) -> DataFrame:
    """(keys, q, top): the exact q-quantile of a large group, linear between neighbours, and its maximum; nulls do not count, a row counts ``weight`` times.

    Equal values are counted, and the counts dealt out by ranges of (keys, value) to a written table. Sums by range and a running sum over
    ranges show which ranges hold a group's two neighbours, and only these are run through: no task holds a group. ``coarse`` is for rows of which
    most values differ and that are cheaper to make twice than to write: a first run counts by bins, and only values of the neighbours' bins are kept.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"), (F.lit(1) if weight is None else F.col(weight)).alias("__w"))
    known = None
    if coarse:
        bins = saved(rows.groupBy(*keys, _bin(F.col("__v")).alias("__part")).agg(F.sum("__w").alias("__n"), F.max("__v").alias("__m")), "bins")
        ends = [F.min(F.when(F.col(f"__{k}"), F.col("__part"))).alias(f"__{k}") for k in ("lower", "upper")]
        per = _ranked(bins, q, keys).groupBy(*keys).agg(*ends, F.min(F.when(F.col("__lower"), F.col("__before"))).alias("__skip"), F.first("__at").alias("__at"), F.first("top").alias("top"))
        known = saved(per, "bounds")
        rows = rows.join(F.broadcast(known.select(*keys, "__lower", "__upper")), keys).where(_bin(F.col("__v")).between(F.col("__lower"), F.col("__upper"))).select(*keys, "__v", "__w")
    n = rows.groupBy(*keys, "__v").agg(F.sum("__w").alias("__c"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = saved(n.repartitionByRange(parts, *keys, "__v").withColumn("__part", F.spark_partition_id()), "ranges")
    per = _ranked(n.groupBy(*keys, "__part").agg(F.sum("__c").alias("__n"), F.max("__v").alias("__m")), q, keys, known)
    near = n.join(per.where("__lower or __upper").drop("__lower", "__upper"), [*keys, "__part"])
    upto = F.col("__before") + F.sum("__c").over(Window.partitionBy(*keys, "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("__upto", upto)
    lo, hi = (F.min(F.when(F.col("__upto") > edge("__at"), F.col("__v"))) for edge in (F.floor, F.ceil))
    ends = near.groupBy(*keys).agg(lo.alias("__lo"), hi.alias("__hi"), F.first("top").alias("top"), F.first("__at").alias("__at"))
    part = F.col("__at") - F.floor("__at")
    return ends.select(*keys, ((1 - part) * F.col("__lo") + part * F.col("__hi")).alias("q"), "top")


def normalise(df: DataFrame, value: str = "value", keys: list[str] = ["fov"]) -> DataFrame:
    """adds ``norm``, (v - p5) / (p100 - p5) within 0 to 1 over all values of the selection; 0 where the range is 0.

    The range, a row for each group, is broadcast: a group's rows do not meet.
    """
    p = exact_percentile(df, value, 0.05, keys).withColumnsRenamed({"q": "__low", "top": "__top"})
    lo, hi = F.col("__low"), F.col("__top")
    norm = F.when(hi == lo, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(value) - lo) / (hi - lo))))
    return df.join(F.broadcast(p), keys).withColumn("norm", norm).drop("__low", "__top")


def recording_time(frames: DataFrame, keys: list[str] = KEYS, t: str = "t_ms") -> DataFrame:
    """(keys, n_frames, seconds) from the first to the last time stamp."""
    return frames.groupBy(*keys).agg(F.count("*").alias("n_frames"), ((F.max(t) - F.min(t)) / 1000).alias("seconds"))


def elapsed_times(frame_meta: DataFrame, keys: list[str]) -> DataFrame:
    """Ms of each frame from the recorded times, or frame number times exposure where any time is missing."""
    w = Window.partitionBy(*keys)
    whole = F.count("runner_time_ms").over(w) == F.count("*").over(w)
    return frame_meta.withColumn("t_ms", F.when(whole, F.col("runner_time_ms")).otherwise(F.col("t") * F.col("exposure_ms")))
