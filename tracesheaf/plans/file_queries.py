"""Queries that write files of the adapters' tables to the shared folder and read them back, and those of names, choices and methods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracesheaf.config import Settings
from tracesheaf.functions import exprs
from tracesheaf.operators import blocks, deconv, events, evoked, grouped, pairs, pixels, select, stats, traces
from tracesheaf.plans import analysis
from tracesheaf.plans.view_queries import SETTINGS, by_condition, records
from tracesheaf.sources import adapters as A
from tracesheaf.sources import readers, sinks
from tracesheaf.sources.scratch import scratch_path

_QUERIES: dict = {}


def query(f):
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict:
    return dict(_QUERIES)




@query
def frame_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metadata file for each of ten groups of users, even ones under the legacy key, and a key that is none."""
    e = A.table(spark, sf_dir, "events").select(F.col("event_id"), (F.col("user_id") % 10).alias("p"), F.from_json("props", "k int").getField("k").alias("k"))
    index = F.create_map(F.lit("p"), F.col("p").cast("int"), F.lit("k"), F.col("k"))
    frame = F.when(F.col("p") % 2 == 0, F.to_json(F.struct(F.struct(index.alias("index")).alias("Event"), "event_id"))).otherwise(F.to_json(F.struct(F.struct(index.alias("index")).alias("mda_event"), "event_id")))
    frames = e.groupBy("p").agg(F.array_join(F.array_sort(F.collect_list(frame)), ",").alias("f"))
    files = frames.select(F.concat(F.lit('{"p'), F.col("p").cast("string"), F.lit('":['), "f", F.lit('],"other":[{"a":1}]}')).alias("value"))
    path = scratch_path(spark, "metadata")
    files.write.option("maxRecordsPerFile", 1).text(path)
    found = readers.read_frame_meta(spark, path)
    return found.select("key", F.get_json_object("raw", "$.event_id").cast("long").alias("event_id"), F.col("index")["k"].alias("k"), F.col("index")["p"].alias("p"))


@query
def raw_metadata(spark, sf_dir):
    """Index maps of metadata under the present key or the legacy one."""
    e = A.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,int>").alias("index"))
    either = lambda even: F.when((F.col("event_id") % 2 == 0) == F.lit(even), F.struct("index"))
    raw = e.select("event_id", either(True).alias("mda_event"), either(False).alias("Event"))
    return raw.select("event_id", readers.event_index(raw)["k"].alias("k"))


@query
def stage_positions(spark, sf_dir):
    """The positions of an acquisition sequence for each nation."""
    s = A.table(spark, sf_dir, "supplier").select("s_nationkey", F.struct(F.col("s_suppkey").alias("o"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 7).cast("double").alias("x"), (F.col("s_suppkey") % 5).cast("double").alias("y"), F.lit(1.5).alias("z")).alias("s"))
    stages = s.groupBy("s_nationkey").agg(F.array_sort(F.collect_list("s")).alias("stage_positions"))
    text = stages.select(F.to_json(F.struct("stage_positions")).alias("sequence"))
    return readers.stage_positions(text)


@query
def datasets(spark, sf_dir):
    """Positions exported to two datasets and all datasets of the folder read."""
    root, px = scratch_path(spark, "datasets"), A.pixels(spark, sf_dir)
    meta = px.select("dataset", "p").distinct()
    for name, wanted in (("a.ome.zarr", [1, 2]), ("b.tensorstore.zarr", [3])):
        sinks.export_positions(px.drop("dataset"), meta, wanted, f"{root}/{name}")
    back = readers.read_datasets(spark, root, "*.parquet")
    return back.groupBy("dataset").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query
def label_file(spark, sf_dir):
    """Labels written and read, and the pixels of any region."""
    path = scratch_path(spark, "labels")
    sinks.write_labels(A.labels(spark, sf_dir), path)
    return pixels.union_mask(spark.read.parquet(path)).drop("dataset")


@query
def trace_files(spark, sf_dir):
    """K2 to K6: all trace tables, each of its own values, written as CSV and read back."""
    path = scratch_path(spark, "traces")
    recs = records(spark, sf_dir).withColumn("dff", F.transform("dec_dff", lambda v: v * 5))
    failed = sinks.export_traces(recs.select("fov", "roi", "raw_trace", "corrected_trace", "dff", "dec_dff", "inferred_spikes", "inferred_spikes_threshold"), path)
    if failed:
        raise RuntimeError(str(failed))
    names = [*sinks.TRACES, "inferred_spikes_thresholded_data"]
    parts = [traces.to_long(readers.read_trace_csv(spark, f"{path}/{n}")).withColumn("kind", F.lit(n)) for n in names]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.select("kind", F.col("fov").cast("long").alias("fov"), "roi", "frame", "value")


@query
def grouped_file(spark, sf_dir):
    """The table of amplitudes by condition written as CSV, read back and made long."""
    path = scratch_path(spark, "grouped")
    table = stats.wide(stats.grouped_mean(records(spark, sf_dir), "peaks_amplitudes_dec_dff"))
    sinks.write_csv(table, f"{path}/calcium_peaks_amplitude")
    long = readers.read_grouped_csv(spark, path, "calcium_peaks_amplitude")
    return long.select(F.col("fov").cast("long").alias("fov"), "condition", "mean", "sem", F.col("n").cast("long").alias("n"))


@query
def burst_file(spark, sf_dir):
    """Four columns for each condition."""
    return sinks.burst_table(grouped.burst_activity(by_condition(spark, sf_dir), SETTINGS))


@query
def evoked_file(spark, sf_dir):
    """A row for each field and intensity; powers are counted in steps of 40 %."""
    stim = A.stimuli(spark, sf_dir).withColumn("power", F.floor(F.col("power") / 40).cast("int"))
    recs = records(spark, sf_dir)
    rows = evoked.evoked_amplitudes(stim, grouped.peak_events(recs), recs)
    rows = rows.withColumn("condition", evoked.evoked_condition(F.lit("c1"), F.col("stimulated"), F.col("power_pulse")))
    return sinks.evoked_table(stats.grouped_mean(rows, "amplitude", ["condition", "fov", "power_pulse"], digits=None))


@query
def plate_records(spark, sf_dir):
    """Plate maps in the legacy layout of records, one for each nation."""
    s = A.table(spark, sf_dir, "supplier")
    one = F.struct(F.col("s_name").alias("name"), (F.col("s_suppkey") % 8).cast("int").alias("row"), (F.col("s_suppkey") % 12).cast("int").alias("column"), F.array(F.concat(F.lit("c"), (F.col("s_suppkey") % 3).cast("string")), F.lit("coral")).alias("condition"))
    return readers.parse_plate_records(s.groupBy("s_nationkey").agg(F.to_json(F.collect_list(one)).alias("value")))


@query
def legacy_names(spark, sf_dir):
    """Results under the full name, the bare one, or both, by both priorities."""
    s = A.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("pos_name"), F.col("s_suppkey").alias("p"))
    full = s.where("p % 3 <> 0").select(F.concat_ws("_p", "pos_name", F.col("p").cast("string")).alias("fov"), F.lit("full").alias("kind"))
    short = s.where("p % 2 = 0").select(F.col("pos_name").alias("fov"), F.lit("short").alias("kind"))
    have = full.union(short)
    each = [readers.with_legacy_name(s, have, first).withColumn("short_first", F.lit(first)) for first in (False, True)]
    return each[0].union(each[1])


@query
def result_file_names(spark, sf_dir):
    """Names of files made of supplier numbers, of which some are no results."""
    k = F.col("s_suppkey")
    forms = ["B{k}_0000_p{k}.json", "B{k}_x.json", "B{k}_00x0_p1.json", "B{k}_0000_p.json", "B-{k}_0000_p1.json", ".B{k}_0000_p1.json", "genotype_plate_map.json", "plate_plan.json", "settings.json", "B{k}.json", "B{k}_0000_p{k}.csv", "a_b_c_{k}.json"]
    name = F.element_at(F.array(*[F.lit(f) for f in forms]), (k % len(forms) + 1).cast("int"))
    named = A.table(spark, sf_dir, "supplier").select(F.replace(name, F.lit("{k}"), k.cast("string")).alias("name"))
    return named.withColumn("is_result", readers.is_result_file(F.col("name")))


@query
def chosen_positions(spark, sf_dir):
    """positions with labels, and listed ones."""
    px, lab = A.pixels(spark, sf_dir), A.labels(spark, sf_dir).where("p < 6")
    every, listed = select.positions_to_analyse(px, lab), select.positions_to_analyse(px, lab, [2, 7])
    return every.withColumn("how", F.lit("labels")).union(listed.withColumn("how", F.lit("listed")))


@query
def fields_of_well(spark, sf_dir):
    """F7 with and without a plate plan."""
    s = A.table(spark, sf_dir, "supplier").select(F.concat(F.lit("B"), F.col("s_nationkey").cast("string"), F.lit("_0000_p"), F.col("s_suppkey").cast("string")).alias("fov"))
    return select.fovs_of_well(s, "B1").withColumn("plan", F.lit(True)).union(select.fovs_of_well(s, "B1", has_plate=False).withColumn("plan", F.lit(False)))


@query
def stimulation_groups(spark, sf_dir):
    """The regions of both groups, the stimulated ones last."""
    r = records(spark, sf_dir).select("fov", "roi", F.when(F.col("roi") % 3 > 0, F.col("stimulated")).alias("stimulated"))
    both = [select.by_stimulation(r, s).withColumn("shown_as", F.lit(s)) for s in (True, False)]
    return select.stimulated_last(both[0].union(both[1]))


@query
def chosen_conditions(spark, sf_dir):
    """F20."""
    return select.with_conditions(records(spark, sf_dir), ["c0", "c2"]).select("fov", "roi", "condition")


@query
def spikes_above(spark, sf_dir):
    """Events above each region's threshold, a multiple of its 5th percentile."""
    tr = A.traces(spark, sf_dir).select("fov", "roi", "frame", "value")
    return events.events_above(tr, events.spike_thresholds(tr, SETTINGS))


@query
def interval_rows(spark, sf_dir):
    """W3 on event rows: milliseconds since the region's event before."""
    e = A.traces(spark, sf_dir).select("fov", "roi", "frame", "t_ms")
    return events.interval_rows(e).select("fov", "roi", "frame", F.round(F.col("iei") * 1000).cast("long").alias("gap_ms"))


@query
def first_peak_after(spark, sf_dir):
    """J11 on peak arrays, for a stimulus at frame 10."""
    return records(spark, sf_dir).select("fov", "roi", evoked.first_after(F.col("peaks_dec_dff"), F.lit(10)).alias("frame"))


@query
def time_axis(spark, sf_dir):
    """F22."""
    r = records(spark, sf_dir)
    long = r.select("fov", "roi", F.posexplode("raw_trace").alias("frame", "v")).join(grouped.frame_counts(r), "fov")
    return long.select("fov", "roi", "frame", exprs.seconds(F.col("frame"), F.col("seconds"), F.col("n_frames")).alias("s"))


@query
def power_names(spark, sf_dir):
    """the leading number and the pulse of power labels."""
    e = A.table(spark, sf_dir, "events").select("event_id", exprs.power_label(F.get_json_object("props", "$.k").cast("int"), None, F.lit("100")).alias("label"))
    return e.select("event_id", exprs.leading_number(F.col("label")).alias("power"), exprs.pulse_of(F.col("label")).alias("pulse"))


@query
def synchrony_methods(spark, sf_dir):
    """Edges by each method name."""
    spk, frames = A.spikes(spark, sf_dir), A.field_frames(spark, sf_dir)
    rois = A.traces(spark, sf_dir).select("fov", "roi").distinct()
    return pairs.synchronies(["jitter_window", "cross_correlation", "correlation"], rois, spk, frames)


@query
def grouped_peak_synchrony(spark, sf_dir):
    """M6, D9."""
    return grouped.peak_synchrony(by_condition(spark, sf_dir))


@query
def grouped_spike_synchrony(spark, sf_dir):
    """M7, D10."""
    return grouped.spike_synchrony(by_condition(spark, sf_dir))


@query
def grouped_evoked(spark, sf_dir):
    """The evoked amplitudes of a field by condition, stimulation and power."""
    r = records(spark, sf_dir)
    e = evoked.evoked_amplitudes(grouped.stimuli(r), grouped.peak_events(r), r)
    return evoked.by_condition(e, grouped.conditions(r), digits=None)


@query
def random_choice(spark, sf_dir):
    """F3, O6 by what holds of any choice: how many regions of a field are chosen, and that all are active ones of it."""
    r = records(spark, sf_dir).select("fov", "roi", (F.col("roi") % 5 > 0).alias("on"))
    chosen = select.random_rois(r, 3, active="on")
    return chosen.groupBy("fov").agg(F.count("*").alias("n"), F.countDistinct("roi").alias("rois"), F.bool_and("on").alias("active"))


@query
def global_heights(spark, sf_dir):
    """Peaks above a fixed height."""
    a = records(spark, sf_dir).select("fov", "roi", F.col("dec_dff").alias("trace"))
    from dataclasses import replace

    found = events.detect_peaks(a, "trace", replace(SETTINGS, peaks_height_mode="global_height", peaks_height_value=60.0))
    return events.raster(found)


@query
def settings_files(spark, sf_dir):
    """A settings file for each nation, made of its suppliers' number and names, under both spellings of a key, read back with defaults."""
    s = A.table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").cast("int").alias("n"), F.min("s_name").alias("name"))
    odd = F.col("s_nationkey") % 2 == 1
    given = F.struct(F.col("n").alias("dff_window"), (F.col("n") / 8).alias("decay constant"), F.when(odd, F.col("n") * 2.5).alias("peaks_height_value"), F.when(odd, "global_height").alias("peaks_height_mode"), F.when(~odd, F.col("name")).alias("led_power_equation"))
    path = scratch_path(spark, "settings")
    s.select("s_nationkey", F.to_json(given).alias("value")).write.partitionBy("s_nationkey").text(path)
    read = readers.read_all_settings(spark, path)
    return read.withColumn("s_nationkey", F.regexp_extract("path", r"/s_nationkey=(\d+)/", 1).cast("long")).drop("path")


@query
def analysed_records(spark, sf_dir):
    """The whole analysis from images to records, with rings and plate; the fields that SQL can express, and the number of deconvolved samples."""
    px = A.pixels(spark, sf_dir)
    p = F.col("p").cast("string")
    meta = px.select("dataset", "p", "t").distinct().select("*", F.concat(F.lit("B"), p, F.lit("_0000")).alias("pos_name"), F.lit(50.0).alias("exposure_ms"), (F.col("t") * 100.0).alias("runner_time_ms"), F.lit(2.0).alias("pixel_size_um"))
    plate = px.select("p").distinct().select(F.concat(F.lit("B"), p).alias("well"), F.concat(F.lit("c"), (F.col("p") % 3).cast("string")).alias("condition_1"), F.when(F.col("p") % 2 == 0, "t1").alias("condition_2"))
    area = A.labels(spark, sf_dir).where("(y - 14) * (y - 14) + (x - 12) * (x - 12) < 90").select("y", "x").distinct()
    settings = Settings(neuropil_inner_radius=1, neuropil_min_pixels=20, neuropil_correction_factor=0.5)
    recs = analysis.analyse(blocks.to_blocks(px), A.labels(spark, sf_dir), meta, settings, plate, 32, 32, area)
    total = lambda c: F.aggregate(F.filter(c, lambda v: v.isNotNull()), F.lit(0.0), lambda a, v: a + v)
    return recs.select(
        "fov", "roi", "condition", F.size("raw_trace").alias("frames"), F.size("dec_dff").alias("deconvolved"), total("raw_trace").alias("raw"), total("neuropil_trace").alias("neuropil"),
        total("corrected_trace").alias("corrected"), total("dff").alias("dff"), "cell_size", "cell_size_units", "total_recording_time_sec", "stimulated", F.size("mask_coord_and_shape.ys").alias("pixels"),
        F.size("neuropil_mask_coord_and_shape.ys").alias("ring_pixels"), "neuropil_correction_factor", "calcium_network_threshold",
    )


@query
def deconvolve_certificate(spark, sf_dir):
    """D3: the conditions that a solution must meet, of every trace; the SQL says that all of them hold."""
    solved = deconv.deconvolve(traces.to_arrays(traces.delta_f(A.traces(spark, sf_dir)), "dff"), "trace")
    return deconv.certificate(solved).select("fov", "roi", F.size("dec").alias("n"), "feasible", "stationary", "at_noise")
