"""The mechanisms behind traces, pixels and pairs against plain Python: windows, ranks, blocks, distances, tiles, lags."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracesheaf.operators import blocks, bursts, cluster, pairs, pixels, shapes, traces


@pytest.mark.parametrize("half", [0, 3, 400])
def test_sliding_percentile(half):
    rng = random.Random(half)
    v = [rng.choice([None, float(rng.randint(0, 9)), rng.random() * 9]) for _ in range(300)]
    for q in (0.0, 0.1, 0.5, 1.0):
        got = traces.sliding_percentile(v, half, q)
        for i in range(len(v)):
            near = [x for x in v[max(0, i - half) : i + half + 1] if x is not None]
            assert (got[i] is None) if not near else math.isclose(got[i], np.quantile(near, q), abs_tol=1e-12)
    assert traces.sliding_percentile([], 3, 0.1) == [] and math.isnan(traces.sliding_percentile([1.0, math.nan], 3, 1.0)[0])
    assert traces.sliding_percentile([1.0, 2.0, math.nan], 3, 0.5)[0] == 2.0


def test_baseline_keeps_every_column_and_row(spark):
    rows = [(1, r, f, float(f % 7) if f % 5 else None, {"a": f}) for r in (1, 2) for f in range(40)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "fov long, roi long, frame long, value double, m map<string,long>")
    got = traces.sliding_baseline(df, 6)
    assert got.columns == [*df.columns, "baseline"]
    w = {(r.roi, r.frame): r for r in got.collect()}
    assert len(w) == 80 and all(r.m == {"a": r.frame} for r in w.values())
    for (roi, f), r in w.items():
        near = [k % 7 for k in range(max(0, f - 3), min(40, f + 4)) if k % 5]
        assert math.isclose(r.baseline, np.quantile(near, 0.1), abs_tol=1e-12)
    assert traces.sliding_baseline(df.limit(0)).count() == 0


def test_ranks_of_large_groups(spark):
    """A group of most rows, one of equal values, one value, and nulls: all over more ranges than groups."""
    rng = random.Random(2)
    groups = {"a": [rng.gauss(0, 1) for _ in range(3000)], "b": [5.0] * 40, "c": [1.0], "d": [float(rng.randint(0, 3)) for _ in range(101)]}
    df = spark.createDataFrame([(k, x) for k, v in groups.items() for x in v] + [("a", None), ("e", None)], "fov string, value double")
    for q in (0.0, 0.05, 0.5, 0.9, 1.0):
        got = {r.fov: r for r in traces.exact_percentile(df, "value", q, ["fov"]).collect()}
        assert set(got) == set(groups)
        assert all(math.isclose(got[k].q, np.quantile(v, q), abs_tol=1e-9) and got[k].top == max(v) for k, v in groups.items())


def test_smoothing_mirrors_the_ends(spark):
    rng = random.Random(3)
    v = [rng.random() for _ in range(11)]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)] + [("b", 0, 1.0), ("b", 4, 1.0)], "fov string, frame long, activity double")
    got = bursts.smoothed(df, 2.0)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    rows = {(r.fov, r.frame): r.smooth for r in got.collect()}
    for name, w in (("a", v), ("b", [1.0, 0, 0, 0, 1.0])):
        n = len(w)
        at = lambda i: (lambda m: m if m < n else 2 * n - 1 - m)(i % (2 * n))  # noqa: B023, E731
        for i in range(n):
            if (name, i) in rows:
                assert math.isclose(rows[name, i], sum(k[1] * w[at(i + k[0])] for k in bursts.gaussian_kernel(2.0)), abs_tol=1e-12)


def pixel_table(spark, frames=4, side=70):
    rng = np.random.default_rng(4)
    v = rng.random((frames, side, side))
    rows = [("d", 1, t, y, x, float(v[t, y, x])) for t in range(frames) for y in range(side) for x in range(side) if (y + x + t) % 11]
    labels = [("d", 1, y, x, k) for k, (y0, x0) in enumerate([(0, 0), (20, 25), (30, 30), (60, 60)], 1) for y in range(y0, y0 + 10) for x in range(x0, x0 + 10)] + [("d", 1, 5, 50, 0)]
    return v, spark.createDataFrame(rows, "dataset string, p int, t int, y int, x int, value double"), labels, spark.createDataFrame(labels, "dataset string, p int, y int, x int, label int")


def test_block_tables(spark, tmp_path):
    v, px, cells, labels = pixel_table(spark)
    table = blocks.to_blocks(px).persist()
    assert table.count() == 4 * 9 and blocks.to_pixels(table).count() == px.count()
    want = {}
    for _, _, y, x, k in cells:
        for t in range(4):
            if k and (y + x + t) % 11:
                want.setdefault((k, t), []).append(v[t, y, x])
    for source in (table, px):
        got = {(r.label, r.frame): r.value for r in pixels.roi_traces(source, labels).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], np.mean(w)) for k, w in want.items())
    for source in (table, px):
        top = {(r.y, r.x): r.value for r in pixels.max_projection(source).collect()}
        assert top == {(y, x): max(v[t, y, x] for t in (2, 3) if (y + x + t) % 11) for y in range(70) for x in range(70) if any((y + x + t) % 11 for t in (2, 3))}
    assert pixels.roi_traces(table.limit(0), labels).count() == 0


def test_saved_blocks_meet_without_a_shuffle_of_pixels(spark, tmp_path):
    _, px, _, labels = pixel_table(spark, 2)
    names = {"block_images": blocks.to_blocks(px), "block_regions": blocks.region_blocks(labels)}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        for name, df in names.items():
            blocks.save_blocks(df, name, 4, str(tmp_path / name))
        found = blocks.roi_traces(spark.table("block_images"), spark.table("block_regions"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and plan.index("Exchange") < plan.index("partial_avg") < plan.index("SortMergeJoin")
        assert found.count() == 8
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in names:
            spark.sql(f"drop table if exists {name}")


def test_distances_by_rows_then_columns():
    rng = np.random.default_rng(5)
    for _ in range(20):
        mask = rng.random((rng.integers(1, 9), rng.integers(1, 12))) < 0.2
        mask.flat[rng.integers(mask.size)] = True
        y, x = np.nonzero(mask)
        want = np.array([[min(abs(y - i) + abs(x - j)) for j in range(mask.shape[1])] for i in range(mask.shape[0])])
        assert (shapes.l1_distance(mask) == want).all()


def plain_ring(cells, label, inner, least, height, width, step, rounds):
    own = [(y, x) for y, x, k in cells if k == label]
    taken = {(y, x) for y, x, _ in cells}
    near = {(y, x): min(abs(y - a) + abs(x - b) for a, b in own) for y in range(height) for x in range(width) if (y, x) not in taken}
    for k in range(1, rounds + 1):
        got = {at for at, d in near.items() if inner < d <= inner + k * step}
        if len(got) >= least:
            break
    return got


@pytest.mark.parametrize("inner,least,step,rounds", [(0, 5, 1, 100), (2, 60, 5, 100), (3, 300, 2, 30), (1, 10**6, 3, 6)])
def test_rings(spark, inner, least, step, rounds):
    """Rings that need one widening, several, or more than there is; regions at borders, overlapping and beyond the image."""
    cells = [(y, x, k) for k, (y0, x0) in enumerate([(0, 0), (9, 10), (11, 12), (20, 25)], 1) for y in range(y0, y0 + 3) for x in range(x0, x0 + 4)] + [(23, 29, 4), (24, 30, 4)]
    df = spark.createDataFrame([("d", p, y, x, k) for p in (1, 2) for y, x, k in cells], "dataset string, p long, y int, x int, label long")
    got = pixels.neuropil_ring(df, inner, least, 24, 30, step, rounds).collect()
    for p in (1, 2):
        for k in (1, 2, 3, 4):
            want = plain_ring([(y, x, k) for y, x, k in cells], k, inner, least, 24, 30, step, rounds)
            assert {(r.y, r.x) for r in got if (r.p, r.label) == (p, k)} == want
    assert pixels.neuropil_ring(df.limit(0), inner, least, 24, 30).count() == 0 and pixels.grown(df.limit(0), 2, 24, 30).count() == 0


def test_growth_has_the_distance_of_every_pixel(spark):
    cells = [(0, 0, 1), (5, 6, 1), (5, 7, 1), (3, 3, 2), (12, 3, 3)]
    df = spark.createDataFrame([("d", 0, *c) for c in cells], "dataset string, p int, y int, x int, label int")
    got = {(r.label, r.y, r.x): r.d for r in pixels.grown(df, 3, 10, 9).collect()}
    want = {}
    for k in (1, 2, 3):
        own = [(y, x) for y, x, q in cells if q == k]
        for y in range(10):
            for x in range(9):
                d = min(abs(y - a) + abs(x - b) for a, b in own)
                if d <= 3:
                    want[k, y, x] = d
        want |= {(k, y, x): 0 for y, x in own}
    assert got == want


def test_tiles_give_the_mask_of_the_whole_image(spark):
    rng = np.random.default_rng(6)
    y, x = np.mgrid[:90, :75]
    v = rng.normal(5, 1, (90, 75)) + 40 * ((y - 33) ** 2 + (x - 30) ** 2 < 150) + 40 * (x > 60)
    df = spark.createDataFrame([(i, j, float(v[i, j])) for i in range(90) for j in range(75) if (i * j) % 13], "y int, x int, value double")
    whole = {tuple(r) for r in pixels.stimulation_mask(df, 90, 75).collect()}
    assert whole and {tuple(r) for r in pixels.stimulation_mask(df, 90, 75, side=16).collect()} == whole


def test_lags_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(f, r, rng.normal(size=12 if r % 5 else 9).tolist()) for f in (1, 2) for r in range(14)] + [(1, 20, [2.0] * 12), (1, 21, None), (1, 22, [])]
    df = spark.createDataFrame(rows, "fov int, roi long, trace array<double>")
    want = {}
    for f, i, a in rows:
        for g, j, b in rows:
            if f == g and i < j and a and b and len(a) == len(b):
                x, y = np.array(a) - np.mean(a), np.array(b) - np.mean(b)
                n = np.sqrt((x**2).sum() * (y**2).sum())
                want[f, i, j] = 0.0 if n < 1e-9 else max(np.correlate(x, y, "full")) / n
    for held in (1, 100, 1 << 22):
        monkeypatch.setattr(pairs, "SPECTRUM_VALUES", held)
        got = {(r.fov, r.roi_i, r.roi_j): r.value for r in pairs.trace_correlation(df, block=5).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], w, abs_tol=1e-9) for k, w in want.items())


def test_matrix_in_leaf_order(spark):
    d = {(1, 2): 0.9, (1, 3): 0.1, (1, 4): -0.2, (2, 3): 0.3, (2, 4): 0.0, (3, 4): 0.8}
    edges = spark.createDataFrame([(7, a, b, v) for (a, b), v in d.items()], "fov int, roi_i long, roi_j long, value double")
    tree = cluster.cluster(edges)
    order = {r.step: r.roi for r in tree.where("kind = 'leaf'").collect()}
    got = {(r.row, r.col): r.value for r in cluster.reordered(edges, tree).collect()}
    assert got == {(i, j): 1.0 if i == j else d[min(order[i], order[j]), max(order[i], order[j])] for i in range(4) for j in range(4)}


def test_linkage_by_rounds(spark, monkeypatch):
    """Fields with ties, without, with pairs missing, and of two regions: the rows of the search in one task."""
    rng = random.Random(8)
    rows = []
    for fov, (n, levels, share) in enumerate([(13, 4, 1.0), (17, 1000, 1.0), (14, 3, 0.6), (2, 5, 1.0), (11, 2, 0.3)]):
        rows += [(fov, 10 * i, 10 * j, rng.randint(0, levels) / levels * rng.choice([1, -1])) for i in range(n) for j in range(i + 1, n) if rng.random() < share or j == i + 1]
    edges = spark.createDataFrame(rows, "fov int, roi_i long, roi_j long, value double")
    want = sorted(map(str, cluster.cluster(edges).collect()))
    monkeypatch.setattr(cluster, "MATRIX_REGIONS", 13)
    mixed = sorted(map(str, cluster.cluster(edges).collect()))
    assert mixed == want
    monkeypatch.setattr(cluster, "MATRIX_REGIONS", 0)
    assert sorted(map(str, cluster.cluster(edges).collect())) == want
    assert cluster.cluster(edges.limit(0)).count() == 0
