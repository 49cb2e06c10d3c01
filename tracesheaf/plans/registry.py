"""Registered queries: every operator over the given tables, seen as recordings by sources/adapters.py."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracesheaf.config import Settings
from tracesheaf.functions import exprs
from tracesheaf.operators import bursts, cluster, deconv, events, evoked, pairs, pixels, select, stats, traces
from tracesheaf.plans import file_queries, oracle, view_queries
from tracesheaf.sources import adapters as A
from tracesheaf.sources import readers, sinks
from tracesheaf.sources.scratch import saved, scratch_path

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
#: Peaks of these tables: height and prominence of one noise level.
SETTINGS = Settings(peaks_height_value=1.0)


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Whole numbers as bigint, other numbers rounded to 6 decimals: what the SQL side returns."""
    for name, kind in df.dtypes:
        if kind in ("int", "smallint", "tinyint"):
            df = df.withColumn(name, F.col(name).cast("long"))
        elif kind in ("double", "float") or kind.startswith("decimal"):
            df = df.withColumn(name, rounded(F.col(name).cast("double"), digits))
    return df


def rounded(x: Column, digits: int) -> Column:
    """``F.round``, which goes through the decimal text of each number, by a product where that is far enough from half a unit to be sure of the same result."""
    scale = 10.0**digits
    units = F.abs(x) * scale
    sure = (units < 2.0**30) & (F.abs(units - F.floor(units) - 0.5) > 1e-6)
    return F.when(sure, F.signum(x) * F.floor(units + 0.5) / scale + 0.0).otherwise(F.round(x, digits))


def query(f: Query, digits: int = 6) -> Query:
    _QUERIES[f.__name__] = lambda spark, sf_dir: tidy(f(spark, sf_dir), digits)
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracle.SQL.items() if k in _QUERIES}


# Shared inputs.


def _peak_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fov, roi, trace, times, seconds, noise, peaks, amplitudes) of ``tr``."""
    tr = A.traces(spark, sf_dir)
    rows = F.array_sort(F.collect_list(F.struct("frame", "value", "t_ms")))
    a = tr.groupBy("fov", "roi").agg(rows.alias("r"), ((F.max("t_ms") - F.min("t_ms")) / 1000).alias("seconds"))
    a = a.select("fov", "roi", F.col("r.value").alias("trace"), F.col("r.t_ms").alias("times"), "seconds")
    return events.detect_peaks(a, "trace", SETTINGS)


def _rois(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.traces(spark, sf_dir).select("fov", "roi").distinct()


def _conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.conditions(_peak_arrays(spark, sf_dir))


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.grouped_mean(_conditions(spark, sf_dir), "amplitudes", digits=None)


def _geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.geometry(A.labels(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to baseline, noise, peaks, frequency, and mean, sem, n by condition and field."""
    based = traces.delta_f(A.traces(spark, sf_dir))
    rows = F.array_sort(F.collect_list(F.struct("frame", F.coalesce("dff", F.lit(0.0)).alias("dff"))))
    a = based.groupBy("fov", "roi").agg(rows.alias("r"), ((F.max("t_ms") - F.min("t_ms")) / 1000).alias("seconds")).select("fov", "roi", F.col("r.dff").alias("dff"), "seconds")
    p = events.detect_peaks(a, "dff", SETTINGS).withColumn("frequency", events.frequency(F.col("peaks"), F.col("seconds")))
    return tidy(stats.grouped_mean(A.conditions(p), "frequency", digits=None))


# Selection and names.


@query
def roi_select(spark, sf_dir):
    """F1, F2."""
    return select.select_rois(A.traces(spark, sf_dir).select("fov", "roi", "frame", "value"), "3-20, 25, x, 9-7")


@query
def random_rois(spark, sf_dir):
    """The limit is the feature; a hash picks, so the regions have no SQL, but query ``random_choice`` has."""
    return select.random_rois(_rois(spark, sf_dir), 3)


@query
def active_filter(spark, sf_dir):
    """F10."""
    return _peak_arrays(spark, sf_dir).where(select.active()).select("fov", "roi", F.size("peaks").alias("n_peaks"))


@query
def condition_key(spark, sf_dir):
    """F8 on names of which some are empty or null."""
    p = A.plate(spark, sf_dir)
    c1 = F.when(F.length("condition_2") % 3 == 0, "").otherwise(F.col("condition_1"))
    c2 = F.when(F.length("condition_1") % 2 == 0, F.lit(None)).otherwise(F.col("condition_2"))
    return p.select("well", exprs.condition_key(c1, c2).alias("condition"))


@query
def fov_name(spark, sf_dir):
    """F5, F6."""
    s = A.table(spark, sf_dir, "supplier")
    pos = F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit("B"), F.col("s_nationkey").cast("string"), F.lit("_0000")))
    named = s.select("s_suppkey", exprs.fov_name(pos, F.col("s_suppkey")).alias("fov"))
    return named.withColumn("well", exprs.well_name(F.col("fov")))


@query
def small_roi_filter(spark, sf_dir):
    """F9, F16."""
    g = _geometry(spark, sf_dir).withColumn("px", F.when(F.col("p") == 1, None).when(F.col("p") == 2, 0.0).otherwise(0.45))
    g = g.withColumn("area", exprs.cell_area(F.col("n"), F.col("px"))).withColumn("unit", exprs.area_unit(F.col("px")))
    return select.drop_small(g, "area", "px").select("p", "label", "area", "unit")


@query
def missing_labels(spark, sf_dir):
    """Of label images that lack the last positions."""
    return select.missing_labels(A.pixels(spark, sf_dir), A.labels(spark, sf_dir).where("p < 6"))


@query
def plate_join(spark, sf_dir):
    """J2, J3, X1."""
    p = A.plate(spark, sf_dir)
    a = p.where("length(well) <> 3").select("well", F.col("condition_1").alias("condition"))
    b = p.where("condition_2 <> 'nation_1'").select("well", F.col("condition_2").alias("condition"))
    rows = A.table(spark, sf_dir, "supplier").select(F.concat(F.lit("W"), F.col("s_suppkey").cast("string"), F.lit("_0000_p0")).alias("fov"))
    return readers.with_plate(rows, readers.full_plate(a, b))


@query
def plate_faults(spark, sf_dir):
    """F27."""
    p = A.plate(spark, sf_dir).select(F.col("condition_1").alias("condition"), F.col("condition_2").alias("color"))
    return select.plate_map_faults(p.distinct())


@query
def isel(spark, sf_dir):
    """S1."""
    px = A.pixels(spark, sf_dir)
    return readers.isel(px, {"p": 2}, t=px.agg(F.min("t")).first()[0] + 20)


@query
def metadata_at(spark, sf_dir):
    """S2, J9 on index maps read from the events' JSON."""
    e = A.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,int>").alias("index"))
    return readers.metadata_at(e, {"k": 3}).select("event_id")


# Traces.


@query
def dff(spark, sf_dir):
    """W1, D1."""
    return traces.delta_f(A.traces(spark, sf_dir)).select("fov", "roi", "frame", "baseline", "dff")


@query
def dff_big(spark, sf_dir):
    """W1 on line items."""
    return traces.sliding_baseline(A.big_traces(spark, sf_dir)).select("roi", "frame", "baseline")


@query
def noise_mad(spark, sf_dir):
    """A11."""
    return traces.noise_level(A.traces(spark, sf_dir))


@query
def zscore(spark, sf_dir):
    """W7."""
    return traces.zscore(A.traces(spark, sf_dir)).select("fov", "roi", "frame", "z")


@query
def normalize_pct(spark, sf_dir):
    """F15."""
    return traces.normalise(A.traces(spark, sf_dir)).select("fov", "roi", "frame", "norm")


@query
def recording_time(spark, sf_dir):
    """A19."""
    return traces.recording_time(A.traces(spark, sf_dir))


@query
def elapsed_times(spark, sf_dir):
    """Recorded times, or exposure times frame number where some are missing."""
    t = A.traces(spark, sf_dir).withColumn("first", F.min("t_ms").over(Window.partitionBy("roi")))
    m = t.select("roi", F.col("frame").alias("t"), F.lit(50.0).alias("exposure_ms"), F.when((F.col("roi") % 2 == 0) | (F.col("frame") % 9 > 0), (F.col("t_ms") - F.col("first")).cast("double")).alias("runner_time_ms"))
    return traces.elapsed_times(m, ["roi"]).select("roi", F.col("t").alias("frame"), "t_ms")


@query
def neuropil_correct(spark, sf_dir):
    """The rings' stand-in is the region with the next number."""
    tr = A.traces(spark, sf_dir).select("fov", "roi", "frame", "value")
    other = tr.select("fov", (F.col("roi") - 10).alias("roi"), "frame", "value")
    return traces.neuropil_corrected(tr, other, 0.7).select("fov", "roi", "frame", "corrected")


@query
def deconvolve(spark, sf_dir):
    """D3 on array traces; tests/test_recorded.py holds the solver against recorded outputs."""
    d = deconv.deconvolve(traces.to_arrays(traces.delta_f(A.traces(spark, sf_dir)), "dff"), "trace")
    return d.select("fov", "roi", F.size("dec").alias("n"), "dec_baseline", "dec_g", F.aggregate("spikes", F.lit(0.0), lambda a, x: a + x).alias("total"))


# Events.


@query
def peaks(spark, sf_dir):
    """D4 to D8, W2."""
    return events.raster(_peak_arrays(spark, sf_dir))


@partial(query, digits=9)  # means of whole milliseconds often end in an exact half at the seventh decimal
def iei(spark, sf_dir):
    """W3, A15."""
    p = _peak_arrays(spark, sf_dir).select("fov", "roi", F.explode(events.inter_event_intervals(F.col("peaks"), F.col("times"))).alias("iei"))
    return stats.interval_summary(p)


@query
def frequency(spark, sf_dir):
    """A13."""
    return _peak_arrays(spark, sf_dir).select("fov", "roi", events.frequency(F.col("peaks"), F.col("seconds")).alias("frequency"))


@query
def amplitude(spark, sf_dir):
    """A14."""
    return stats.amplitude_rows(events.raster(_peak_arrays(spark, sf_dir)))


@query
def spike_threshold(spark, sf_dir):
    """A12, D7."""
    return events.spike_thresholds(A.traces(spark, sf_dir).withColumn("value", F.col("value") - 60), SETTINGS)


@query
def thresholded_spikes(spark, sf_dir):
    """F12."""
    tr = A.traces(spark, sf_dir)
    thr = tr.groupBy("fov", "roi").agg(F.percentile("value", 0.5).alias("threshold"))
    a = traces.to_arrays(tr).join(thr, ["fov", "roi"]).withColumn("trace", exprs.threshold_spikes(F.col("trace"), F.col("threshold")))
    return traces.to_long(a)


@query
def raster_scale(spark, sf_dir):
    """D11, F21."""
    return events.color_scale(events.raster(_peak_arrays(spark, sf_dir))).select("fov", "roi", "frame", "amplitude", "vmin", "vmax")


@query
def spike_raster(spark, sf_dir):
    """F13, D10, F21 on spikes."""
    return events.color_scale(A.spikes(spark, sf_dir), spikes=True).select("fov", "roi", "frame", "vmin", "vmax")


# Grouped statistics and tables.


@query
def grouped_mean_sem(spark, sf_dir):
    """A1, A1a to A1d."""
    return _grouped(spark, sf_dir)


@query
def percent_active(spark, sf_dir):
    """A3."""
    return stats.percentage_active(_conditions(spark, sf_dir).withColumn("active", F.size("peaks") > 8), digits=None)


@query
def weighted_pooled_sem(spark, sf_dir):
    """A7."""
    return stats.pooled(_grouped(spark, sf_dir))


@query
def binomial_sem(spark, sf_dir):
    """A8."""
    return stats.binomial(percent_active(spark, sf_dir))


@query
def single_value_stats(spark, sf_dir):
    """A9."""
    return stats.single_values(_grouped(spark, sf_dir).select("condition", F.col("mean").alias("value")))


@query
def wide_pivot(spark, sf_dir):
    """K7, O1."""
    return stats.wide(_grouped(spark, sf_dir))


@query
def ragged_columns(spark, sf_dir):
    """Fields of unequal number."""
    rows = percent_active(spark, sf_dir).where("not (condition = 'c1' and fov > 6)")
    return stats.ragged(rows, {"pct": "_pct", "n": "_n"})


@query
def value_table(spark, sf_dir):
    """K9."""
    return sinks.value_table(_grouped(spark, sf_dir).select("condition", "fov", F.col("sem").alias("value")).where("not (condition = 'c2' and fov < 3)"))


@query
def trace_table(spark, sf_dir):
    """K2: a row for each region, a column for each frame."""
    return sinks.wide_traces(A.arrays(spark, sf_dir), "trace")


@query
def first_settings(spark, sf_dir):
    """O5."""
    return select.first_setting(traces.noise_level(A.traces(spark, sf_dir)), ["noise"])


# Pairs.


@query
def jitter_sync(spark, sf_dir):
    """M1, J4, J5."""
    return pairs.jitter_synchrony(_rois(spark, sf_dir), A.spikes(spark, sf_dir), 2)


@query
def xcorr_sync(spark, sf_dir):
    """M2, J6."""
    return pairs.lag_synchrony(_rois(spark, sf_dir), A.spikes(spark, sf_dir), 5)


def _pearson(spark, sf_dir, give="pairs"):
    return pairs.correlation_synchrony(_rois(spark, sf_dir), A.spikes(spark, sf_dir), A.field_frames(spark, sf_dir), give)


@query
def pearson_sync(spark, sf_dir):
    """M3."""
    return _pearson(spark, sf_dir)


@query
def global_sync(spark, sf_dir):
    """A10."""
    return pairs.global_synchrony(_pearson(spark, sf_dir, "regions"))


@query
def phase_locking(spark, sf_dir):
    """M14."""
    return pairs.phase_locking(events.raster(_peak_arrays(spark, sf_dir)).select("fov", "roi", "frame"), A.field_frames(spark, sf_dir))


@query
def trace_xcorr(spark, sf_dir):
    """M8."""
    return pairs.trace_correlation(A.arrays(spark, sf_dir))


@query
def spike_xcorr(spark, sf_dir):
    """M9."""
    a = A.arrays(spark, sf_dir).withColumn("trace", F.transform("trace", lambda v: (v > 0.15).cast("double")))
    return pairs.trace_correlation(a, absolute=True)


@query
def connectivity(spark, sf_dir):
    """M10."""
    return pairs.connectivity(_pearson(spark, sf_dir), values=_pearson(spark, sf_dir, "values"))


@query
def network_density(spark, sf_dir):
    """M11, A20 on the counts of pairs by value."""
    values = saved(_pearson(spark, sf_dir, "values").groupBy("fov", "value").agg(F.sum("pairs").alias("pairs")), "values")
    return pairs.network_statistics(pairs.connectivity(values), pairs.paired_regions(_rois(spark, sf_dir)))


@query
def network_edges(spark, sf_dir):
    """Places of the regions are drawn from their numbers."""
    places = _rois(spark, sf_dir).select("fov", "roi", (F.col("roi") % 32).alias("cy"), (F.col("roi") % 29).alias("cx"))
    return pairs.network_edges(connectivity(spark, sf_dir), places)


@query
def clustering(spark, sf_dir):
    """M13; tests hold it against a plain linkage."""
    return cluster.tree(A.arrays(spark, sf_dir))


# Bursts.


def _activity(spark, sf_dir):
    return bursts.population_activity(A.spikes(spark, sf_dir), A.field_frames(spark, sf_dir))


@query
def population_activity(spark, sf_dir):
    """A4."""
    return _activity(spark, sf_dir)


@query
def smoothed(spark, sf_dir):
    """W5."""
    return bursts.smoothed(_activity(spark, sf_dir), 2.0).select("fov", "frame", "smooth")


def _bursts(spark, sf_dir):
    return bursts.bursts(A.spikes(spark, sf_dir), A.field_frames(spark, sf_dir), threshold_pct=20.0)


@query
def burst_runs(spark, sf_dir):
    """B1, W4."""
    return _bursts(spark, sf_dir)


@query
def burst_stats(spark, sf_dir):
    """A5, W6."""
    return bursts.burst_statistics(_bursts(spark, sf_dir), A.field_frames(spark, sf_dir))


@query
def burst_stats_panel(spark, sf_dir):
    """A6."""
    return bursts.burst_statistics(_bursts(spark, sf_dir), A.field_frames(spark, sf_dir), panel=True)


@query
def burst_overlay(spark, sf_dir):
    """B2."""
    return bursts.burst_overlay(A.traces(spark, sf_dir).select("fov", "roi", "frame", "value"), threshold_pct=25.0)


# Stimulation.


@query
def forward_asof(spark, sf_dir):
    """J11."""
    return evoked.forward_asof(A.stimuli(spark, sf_dir), events.raster(_peak_arrays(spark, sf_dir)))


def _evoked(spark, sf_dir):
    flags = _rois(spark, sf_dir).withColumn("stimulated", F.col("roi") % 4 == 0)
    return evoked.evoked_amplitudes(A.stimuli(spark, sf_dir), events.raster(_peak_arrays(spark, sf_dir)), flags)


@partial(query, digits=9)  # amplitudes have two decimals, and means of 32 of them end in an exact half at the seventh
def evoked_amplitudes(spark, sf_dir):
    """E2, E3, E4, X2."""
    c = A.plate(spark, sf_dir).select((F.substring("well", 2, 9).cast("long") % 10).alias("fov"), F.col("condition_1").alias("condition"))
    first = c.groupBy("fov").agg(F.min("condition").alias("condition"))
    e = _evoked(spark, sf_dir).join(first, "fov")
    e = e.withColumn("condition", evoked.evoked_condition(F.col("condition"), F.col("stimulated"), F.col("power_pulse")))
    return stats.grouped_mean(e, "amplitude", digits=None)


@query
def evoked_panel(spark, sf_dir):
    """E5, A16."""
    return evoked.panel(_evoked(spark, sf_dir))


@query
def led_power(spark, sf_dir):
    """Five equations and one that is none, on the events' numbers."""
    x = A.table(spark, sf_dir, "events").select("event_id", (F.get_json_object("props", "$.k").cast("int") + 1).alias("k"))
    forms = {"lin": "y = 11 * x - 6", "quad": "y = 0.5 * x^2 + 2 * x - 1", "exp": "y = 2 * exp(0.1 * x) + 1", "pow": "y = 3 * x^1.5 + 2", "log": "y = 4 * log(x) + 1", "none": "z = x"}
    x = x.select("event_id", "k", *[exprs.led_power(e, F.col("k")).alias(n) for n, e in forms.items()], exprs.power_label(F.col("k"), forms["lin"], F.lit("100")).alias("label"))
    key = F.concat_ws("_", F.lit("c1_evk_stim"), "label")
    return x.withColumn("tag", exprs.condition_tag(key)).withColumn("intensity", exprs.numeric_intensity(key, -2)).withColumn("tick", exprs.tick_label(F.col("label"))).withColumn("unit", exprs.axis_unit(key))


@query
def display_condition(spark, sf_dir):
    """F17."""
    e = _evoked(spark, sf_dir).select(evoked.evoked_condition(F.lit("c1_t1"), F.col("stimulated"), F.col("power_pulse")).alias("key")).distinct()
    return e.withColumn("label", exprs.display_condition(F.col("key")))


def _stim_pixels(spark, sf_dir):
    return A.labels(spark, sf_dir).where("(y - 14) * (y - 14) + (x - 12) * (x - 12) < 90").select("y", "x").distinct()


@query
def stim_overlap(spark, sf_dir):
    """J7, E1."""
    lab = A.labels(spark, sf_dir).select(F.col("p").alias("fov"), F.col("label").alias("roi"), "y", "x")
    return evoked.stimulated(evoked.overlap(lab, _stim_pixels(spark, sf_dir)))


@query
def label_class(spark, sf_dir):
    """E7."""
    lab = A.labels(spark, sf_dir).select(F.col("p").alias("fov"), F.col("label").alias("roi"), "y", "x")
    return evoked.label_class(lab, stim_overlap(spark, sf_dir).where("roi % 5 <> 0"))


# Pixels.


@query
def roi_traces(spark, sf_dir):
    """J1, A2."""
    return pixels.roi_traces(A.pixels(spark, sf_dir), A.labels(spark, sf_dir)).drop("dataset")


@query
def max_projection(spark, sf_dir):
    """A18."""
    return pixels.max_projection(A.pixels(spark, sf_dir)).drop("dataset")


@query
def roi_geometry(spark, sf_dir):
    """A17, A21."""
    return _geometry(spark, sf_dir).drop("dataset")


@query
def erode(spark, sf_dir):
    """I3."""
    return pixels.erode(A.labels(spark, sf_dir)).drop("dataset")


@query
def grow(spark, sf_dir):
    """I1."""
    return pixels.grown(A.labels(spark, sf_dir), 2, 32, 32).drop("dataset")


@query
def neuropil_ring(spark, sf_dir):
    """I2, X4."""
    return pixels.neuropil_ring(A.labels(spark, sf_dir), 1, 20, 32, 32).drop("dataset")


@query
def composite(spark, sf_dir):
    """I6 on overlapping regions."""
    grown = pixels.grown(A.labels(spark, sf_dir), 2, 40, 40)
    return pixels.composite(grown, 32, 32).drop("dataset")


@query
def masks(spark, sf_dir):
    """I5 both ways."""
    return pixels.from_masks(pixels.to_masks(A.labels(spark, sf_dir), 32, 32)).drop("dataset")


@query
def highlight(spark, sf_dir):
    """I7."""
    lab = A.labels(spark, sf_dir)
    return pixels.highlight(lab, [2, 5, 7]).join(pixels.roi_at(lab, 9, 4).select("p", F.col("label").alias("under")), "p", "left").drop("dataset")


@query
def stim_mask(spark, sf_dir):
    """I4 on every position's projection."""
    image = pixels.max_projection(A.pixels(spark, sf_dir)).select(*pixels.AT, F.col("y").cast("int"), F.col("x").cast("int"), "value")
    return pixels.stimulation_mask(image, 32, 32, keys=pixels.AT).drop("dataset")


def brightest(pdf):
    """A stand-in for a segmentation model: pixels above the image's mean are region 1."""
    out = pdf[pdf["value"] > pdf["value"].mean()][["dataset", "p", "y", "x"]].copy()
    out["label"] = 1
    return out


@query
def batch_inference(spark, sf_dir):
    """I8, U2."""
    return pixels.batch_inference(pixels.max_projection(A.pixels(spark, sf_dir)), brightest, "dataset string, p long, y long, x long, label long").drop("dataset")


# Documents of results.


@query
def json_roundtrip(spark, sf_dir):
    """Records to a JSON file for each field in the shared folder and back."""
    recs = _peak_arrays(spark, sf_dir).select(F.col("fov"), "roi", F.col("peaks").alias("peaks_dec_dff"), F.col("amplitudes").alias("peaks_amplitudes_dec_dff"), (F.size("peaks") > 0).alias("active"))
    path = scratch_path(spark, "records")
    sinks.write_results(recs, path)
    back, _, _ = readers.read_results(spark, path)
    return back.select(F.col("fov").cast("long").alias("fov"), "roi", F.size("peaks_dec_dff").alias("n_peaks"), F.aggregate("peaks_amplitudes_dec_dff", F.lit(0.0), lambda a, x: a + x).alias("total"), "active")


@query
def plate_map_json(spark, sf_dir):
    """A plate map for each nation to JSON and back."""
    s = A.table(spark, sf_dir, "supplier").select("s_nationkey", F.concat(F.lit("W"), F.col("s_suppkey").cast("string")).alias("well"), (F.col("s_suppkey") % 8).cast("int").alias("row"), (F.col("s_suppkey") % 12).cast("int").alias("col"), F.col("s_name").alias("condition"), F.lit("coral").alias("color"))
    return readers.parse_plate_map(sinks.plate_map_json(s, ["s_nationkey"]))


for _name, _view in (file_queries.queries() | view_queries.queries()).items():
    _QUERIES[_name] = lambda spark, sf_dir, _view=_view, _digits=9 if _name in ("view_iei", "view_mw_iei", "grouped_evoked") else 6: tidy(_view(spark, sf_dir), _digits)
