"""Pair jobs whose pairs are many times their regions: what is run once, what is never shuffled, and the sums that stand for the pairs."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracesheaf.operators import cluster, pairs, traces
from tracesheaf.plans import file_queries, registry
from tracesheaf.plans.views import view
from tracesheaf.sources import adapters


@pytest.fixture(scope="module")
def arrays(spark):
    rng = np.random.default_rng(5)
    rows = [(f, f * 100 + r, [float(x) for x in np.round(rng.normal(size=12 if r % 9 else 7), 3)]) for f in (1, 2) for r in range(30)] + [(3, 1, [1.0, 2.0])]
    return spark.createDataFrame(rows, "fov long, roi long, trace array<double>").cache()


@pytest.fixture
def no_small_tables(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_square_runs_its_pairs_once(arrays):
    edges = pairs.trace_correlation(arrays)
    square = pairs.matrix(edges, regions=pairs.correlated_regions(arrays))
    assert plan(square).count("FlatMapGroupsInArrow") == 1 and plan(pairs.mirrored(edges)).count("FlatMapGroupsInArrow") == 1
    assert rows(square) == rows(pairs.matrix(edges)) and square.where("roi_i = roi_j").count() == 60


def test_lags_as_products_equal_spectra(arrays, monkeypatch):
    for absolute in (False, True):
        direct = rows(pairs.trace_correlation(arrays, absolute=absolute, block=7))
        with monkeypatch.context() as m:
            m.setattr(pairs, "DIRECT_FRAMES", 0)
            spectra = rows(pairs.trace_correlation(arrays, absolute=absolute))
        assert [r[:3] for r in direct] == [r[:3] for r in spectra] and np.allclose([r[3] for r in direct], [r[3] for r in spectra], atol=1e-12)


def test_pairs_do_not_meet_by_field(arrays, no_small_tables):
    """Thresholds, statistics and places are small beside the pairs, which stay where they were made."""
    linked = pairs.connectivity(pairs.trace_correlation(arrays), 80)
    edges = pairs.network_edges(linked, arrays.select("fov", "roi", F.lit(1.0).alias("cy"), F.lit(2.0).alias("cx")))
    assert "SortMergeJoin" not in plan(linked) and "SortMergeJoin" not in plan(edges) and edges.count() == linked.where("connected").count() > 0


def test_a_pair_job_has_a_task_for_each_two_blocks(arrays):
    assert "REPARTITION_BY_NUM" in plan(pairs.trace_correlation(arrays, block=4))


def test_sums_and_counts_stand_for_the_pairs(spark):
    rng = random.Random(6)
    events = spark.createDataFrame([(f, r, t) for f in (1, 2) for r in range(40) for t in rng.sample(range(50), r % 8)], "fov long, roi long, frame long")
    rois = spark.createDataFrame([(f, r) for f in (1, 2) for r in range(40)] + [(3, 1)], "fov long, roi long")
    frames = spark.createDataFrame([(1, 50), (2, 50), (3, 50)], "fov long, n_frames long")
    for method in ("jitter_window", "cross_correlation", "correlation"):
        each, sums, values = (pairs.synchrony(method, rois, events, frames, give=g) for g in ("pairs", "regions", "values"))
        assert np.allclose(rows(pairs.global_synchrony(sums)), rows(pairs.global_synchrony(each)), atol=1e-12)
    counted, whole = pairs.connectivity(values, 90), pairs.connectivity(each, 90)
    assert np.allclose(rows(pairs.network_statistics(counted, pairs.paired_regions(rois))), rows(pairs.network_statistics(whole)))


def test_trains_of_several_methods_are_made_once(spark, sf):
    """The plan of all methods reads saved trains and no table of events."""
    found = file_queries.synchrony_methods(spark, sf)
    assert not any(f.endswith("events.parquet") for f in found.inputFiles()) and any("/trains-" in f for f in found.inputFiles())
    assert {r.method for r in found.select("method").distinct().collect()} == {"jitter_window", "cross_correlation", "correlation"}


def test_ranks_by_bins(spark):
    rng = random.Random(7)
    groups = {"a": [rng.gauss(0, 1) for _ in range(2000)], "b": [5.0] * 40, "c": [-1.0], "d": [0.0, -0.0, 1e-320, -1e300, 1e300, float("inf")], "e": [rng.choice([-3.0, 0.0, 3.0]) for _ in range(60)]}
    df = spark.createDataFrame([(k, x) for k, v in groups.items() for x in v] + [("f", None)], "fov string, value double")
    for q in (0.3, 0.5):
        assert rows(traces.exact_percentile(df, "value", q, ["fov"], coarse=True)) == rows(traces.exact_percentile(df, "value", q, ["fov"]))


def test_equal_distances_do_not_slow_the_linkage():
    d = np.ones((600, 600))
    began = time.perf_counter()
    merges = cluster.complete_linkage(d)
    assert len(merges) == 599 and merges[0] == (0, 1, 1.0, 2) and merges[-1][3] == 600
    assert time.perf_counter() - began < 10


@pytest.mark.parametrize("most", [16_384, 3])
def test_squares_of_blocks_give_the_tree_of_the_edges(arrays, monkeypatch, most):
    few = arrays.where("roi % 100 < 9")
    monkeypatch.setattr(cluster, "MATRIX_REGIONS", most)
    filled = lambda df: rows(df.fillna(-1))
    want = filled(cluster.cluster(pairs.trace_correlation(few))) if most > 3 else None
    for block in (1, 5) if most > 3 else (5,):
        got = filled(cluster.cluster(pairs.trace_correlation(few, block=block, give="distances"), pairs.correlated_regions(few)))
        assert len(got) == 30 and (want is None or got == want)


@pytest.mark.parametrize("absolute", [False, True])
def test_trees_come_from_the_nearest_pairs(spark, arrays, monkeypatch, absolute):
    """Runs over the pairs that let out only the nearest give the rows of a tree from all edges, also with equal traces, equal distances, flat traces and several lengths."""
    rng = random.Random(8)
    more = [(4, r, [float(rng.random() < 0.3) for _ in range(10)]) for r in range(40)] + [(5, r, [1.0, 0.0, 2.0] if r % 3 else [0.0] * 3) for r in range(20)] + [(6, r, [float(r == k) for k in range(9)]) for r in range(9)]
    traces = arrays.union(spark.createDataFrame(more, "fov long, roi long, trace array<double>"))
    filled = lambda df: rows(df.fillna(-1))
    want = filled(cluster.cluster(pairs.trace_correlation(traces, absolute=absolute)))
    assert filled(cluster.tree(traces, absolute=absolute)) == want
    for k, v in {"WHOLE": 12, "NEAREST": 2, "PARTS": 2, "STRIP": 7}.items():
        monkeypatch.setattr(cluster, k, v)
    monkeypatch.setattr(pairs, "BLOCK", 20)
    assert filled(cluster.tree(traces, absolute=absolute)) == want


def test_squares_leave_their_tasks_whole(arrays):
    """Both directions and the diagonal, with places and without, are what mirroring the pairs gives; no row is exploded."""
    square = pairs.trace_square(arrays)
    assert rows(square) == rows(pairs.matrix(pairs.trace_correlation(arrays)))
    tree = cluster.tree(arrays)
    placed = pairs.trace_square(arrays, places=tree.where("kind = 'leaf'").select("fov", "roi", F.col("step").alias("place")))
    assert rows(placed) == rows(cluster.reordered(pairs.trace_correlation(arrays), tree))
    assert "Generate" not in plan(square).split("FlatMapGroupsInArrow")[0]


def test_no_square_of_a_field_leaves_the_tasks(spark, monkeypatch):
    """Of a field of more than WHOLE regions few pairs are written, however many it has."""
    rng, let_out = np.random.default_rng(9), []
    traces = spark.createDataFrame([(1, r, [float(x) for x in rng.normal(size=8)]) for r in range(300)], "fov long, roi long, trace array<double>")
    nearest = cluster._nearest
    monkeypatch.setattr(cluster, "WHOLE", 50)
    monkeypatch.setattr(cluster, "NEAREST", 4)
    monkeypatch.setattr(cluster, "_nearest", lambda *a: let_out.append(nearest(*a)) or let_out[-1])
    assert cluster.tree(traces).count() == 599
    assert len(let_out) > 1 and max(df.agg(F.sum(F.size("d"))).first()[0] for df in let_out) < 300 * 16


def test_frames_keep_their_power_and_not_the_whole_map(spark, no_small_tables):
    """Rows of a field do not meet in one task, and none carries the powers of all frames."""
    schema = "fov long, roi long, dec_dff array<double>, active boolean, stimulated boolean, stimulations_frames_and_powers map<string,int>"
    records = spark.createDataFrame([(1, r, [float(r), 2.0, 3.0], True, r == 1, {"0": 7, "2": 9}) for r in (1, 2)] + [(2, 3, [1.0, 5.0], True, True, None)], schema)
    shown = view("stim_vs_non_traces", records)
    rows_side = plan(shown).split("BroadcastExchange")[0]
    assert "SortMergeJoin" not in rows_side and "hashpartitioning(fov" not in rows_side
    assert "stimulations_frames_and_powers" not in rows_side.split("BroadcastHashJoin")[0]
    assert [(r.roi, r.frame, r.stim_power) for r in shown.collect()] == [(2, 0, 7), (2, 1, None), (2, 2, 9), (1, 0, 7), (1, 1, None), (1, 2, 9), (3, 0, None), (3, 1, None)]


def test_traces_are_dealt_to_all_partitions(spark, sf):
    assert "REPARTITION_BY_NUM" in plan(adapters.traces(spark, sf)) and adapters.traces(spark, sf).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_trains_are_dealt_eight_times_however_many(spark):
    """What is shuffled grows with the regions of a field and not with their square; a task gives its pairs a strip at a time."""
    many = spark.range(20_000).select(F.lit(1).cast("long").alias("fov"), F.col("id").alias("roi"), F.array(F.lit(1.0), F.lit(2.0)).alias("trace"))
    assert pairs.dealt_blocks(many, ("trace",)).count() == 8 * 20_000


def test_strips_of_a_task_give_its_pairs(arrays, monkeypatch):
    """Pairs, both directions, sums and counts are the same from strips of any size, also where rows of a region come twice."""
    traces = arrays.union(arrays.where("roi = 101"))
    gives = ("pairs", "square", "values", "regions")
    job = lambda give: pairs.trace_correlation(traces, give=give)
    whole = {give: job(give) for give in gives}
    sums = lambda df: rows(df.groupBy("fov", "roi").agg(F.sum("pairs"), F.round(F.sum("total"), 9)))
    counts = lambda df: rows(df.groupBy("fov", F.round("value", 9)).agg(F.sum("pairs")))
    seen = {"pairs": rows, "square": rows, "values": counts, "regions": sums}
    near = lambda found: [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in found]
    want = {give: near(seen[give](df)) for give, df in whole.items()}
    monkeypatch.setattr(pairs, "HELD", 7)
    for give in gives:
        assert near(seen[give](job(give))) == want[give]
    monkeypatch.setattr(pairs, "TILE", 4)
    assert near(rows(job("pairs"))) == want["pairs"]
    assert len(want["pairs"]) > 0 and not any(r[1] == r[2] for r in want["pairs"])


@pytest.mark.parametrize("size", [1, 5, 64, 255])
def test_counts_of_several_lags_in_one_product(size, monkeypatch):
    """Trains of 0 and 1 come from packed counts, which are those of a product for each lag."""
    rng = np.random.default_rng(10)
    x, y = ((rng.random((n, size)) < p).astype(float) for n, p in ((20, 0.5), (13, 1.0)))
    monkeypatch.setattr(pairs, "TILE", 6)
    for a, b in ((x, y), (y, x), (x, x)):
        single = [z.astype(np.float32) for z in (a, b)]
        assert (pairs._counted(a, b) == pairs._direct(*single, True)).all() and (pairs._best_lag(a, b, True) == pairs._counted(a, b)).all()


def test_rounding_by_a_product_is_rounding(spark):
    """Results are those of ``round`` to the last bit, with ties, signs, nulls and what is too large for a product."""
    rng = random.Random(11)
    some = [0.0, -0.0, 0.0078125, -0.0078125, 0.1234565, 1.0000005, -2.5e-7, 5e-7, 1e-320, 1e17, -1e300, float("nan"), float("inf"), float("-inf"), None]
    some += [rng.uniform(-1, 1) for _ in range(3000)] + [rng.randrange(10**9) / 1e7 for _ in range(3000)] + [rng.gauss(0, 1e6) for _ in range(500)]
    found = spark.createDataFrame([(x,) for x in some], "x double").select(registry.rounded(F.col("x"), 6).alias("a"), F.round("x", 6).alias("b")).collect()
    assert [repr(r.a) for r in found] == [repr(r.b) for r in found]


@pytest.mark.parametrize("about", [0.005, 0.0])
def test_a_threshold_takes_one_run_over_the_pairs(spark, arrays, monkeypatch, about):
    """Threshold and number of links are those of all pairs, also where the first range does not hold the rank; values of other ranges leave no task."""
    rng = random.Random(12)
    more = [(4, r, [float(rng.random() < 0.3) for _ in range(10)]) for r in range(60)] + [(5, r, [1.0, 0.0, 2.0]) for r in range(20)]
    traces = arrays.union(spark.createDataFrame(more, "fov long, roi long, trace array<double>"))
    whole = pairs.trace_correlation(traces)
    monkeypatch.setattr(pairs, "GUESS", (9, 20))
    monkeypatch.setattr(pairs, "ABOUT", about)
    for percentile in (90, 0, 99.9):
        linked = pairs.connectivity(whole, percentile)
        want = rows(linked.groupBy("fov").agg(F.round(F.first("threshold"), 9), F.count(F.when(F.col("connected"), 1))))
        found = pairs.links(traces, percentile)
        assert rows(found.select("fov", F.round("threshold", 9), "edges")) == want
    assert rows(pairs.trace_correlation(traces, least=found).select("fov", "roi_i", "roi_j")) == rows(linked.where("connected").select("fov", "roi_i", "roi_j"))


def test_views_of_networks_let_out_what_they_show(spark, monkeypatch):
    """The pairs are run through once for the threshold and once for the rows, and no job gives every pair but that of the matrix."""
    records = spark.createDataFrame([(1, r, [math.sin(r * k) for k in range(9)], True) for r in range(40)], "fov long, roi long, dec_dff array<double>, active boolean")
    jobs, run = [], pairs.block_pairs
    monkeypatch.setattr(pairs, "block_pairs", lambda *a, **k: jobs.append(k.get("give", a[4] if len(a) > 4 else "pairs")) or run(*a, **k))
    shown = view("network", records)
    assert jobs == ["pairs", "window", "pairs"] and 0 < shown.count() < 100
    jobs.clear()
    assert view("connectivity_matrix", records).count() == 40 * 39 and jobs == ["pairs", "window", "square"]


def test_trees_take_single_precision_for_what_is_far(monkeypatch):
    """Distances of clusters are those of double precision to the last unit, with equal and flat traces and unequal lengths, though most pairs are not correlated in it."""
    rng = np.random.default_rng(13)
    calls, best = [], pairs._best_lag
    monkeypatch.setattr(pairs, "_best_lag", lambda *a: calls.append(1) or best(*a))
    monkeypatch.setattr(cluster, "STRIP", 50)
    monkeypatch.setattr(cluster, "FEW", 1.5)
    traces = [np.round(rng.normal(size=30 if k % 9 else 20), 2) for k in range(160)]
    traces[1], traces[2] = traces[3], np.ones(30)
    names = [np.sort(rng.integers(0, 12, 90)), np.sort(rng.integers(20, 24, 70))]
    off = int(np.ceil(pairs.single_error(30) * 1e8)) + 1
    for sides, same in (([(names[0], traces[:90]), (names[1], traces[90:])], False), ([(names[0], traces[:90])] * 2, True)):
        which, held = [s[0] for s in sides], [s[1] for s in sides]
        want = cluster._cluster_distances(which, held, same, False)
        calls.clear()
        assert (cluster._cluster_distances(which, held, same, False, off) == want)[~np.eye(*want.shape, dtype=bool) if same else ...].all() and not calls
        left, right = np.array([0, 1, 3]), np.array([1, 2, 2]) if not same else np.array([1, 2, 4])
        monkeypatch.setattr(cluster, "FEW", 0.001)
        assert (cluster._exactly(which, held, np.unique(which[0])[left], np.unique(which[1])[right]) == want[left, right]).all()
        monkeypatch.setattr(cluster, "FEW", 1.5)


def test_views_of_synchrony_make_their_trains_once(spark, sf):
    found = registry.queries()["view_spike_synchrony"](spark, sf)
    assert not any(f.endswith("events.parquet") for f in found.inputFiles()) and any("/trains-" in f for f in found.inputFiles())
