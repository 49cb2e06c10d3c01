"""Operators against plain Python on small inputs, and sources against what sinks wrote."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracesheaf.config import Settings
from tracesheaf.functions import exprs
from tracesheaf.operators import cluster, deconv, events, pixels, stats
from tracesheaf.plans import analysis, views
from tracesheaf.schemas import ROI_JSON
from tracesheaf.sources import readers, sinks


def plain_peaks(v, height, least, distance):
    n, found, i = len(v), [], 1
    while i < n - 1:
        if v[i] > v[i - 1]:
            j = i
            while j < n - 1 and v[j + 1] == v[i]:
                j += 1
            if j < n - 1 and v[j + 1] < v[i]:
                found.append((i + j) // 2)
            i = j + 1
        else:
            i += 1
    found = [p for p in found if v[p] >= height]
    kept = []
    for p in sorted(found, key=lambda p: (-v[p], -p)):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)

    def prom(p):
        lo = []
        for step in (-1, 1):
            k, m = p, v[p]
            while 0 <= k < n and v[k] <= v[p]:
                m = min(m, v[k])
                k += step
            lo.append(m)
        return v[p] - max(lo)

    return [p for p in sorted(kept) if prom(p) >= least]


@pytest.mark.parametrize("distance", [2, 5])
def test_peaks(spark, distance):
    rng = random.Random(distance)
    rows = [(i, [float(rng.randint(0, 6)) for _ in range(rng.randint(1, 60))]) for i in range(60)] + [(98, []), (99, None)]
    df = spark.createDataFrame(rows, "roi int, trace array<double>")
    got = {r.roi: r.peaks for r in events.find_peaks(df, "trace", F.lit(2.0), F.lit(1.5), distance).collect()}
    assert got[99] is None and got[98] == []
    for i, v in rows[:-2]:
        assert got[i] == plain_peaks(v, 2.0, 1.5, distance), v


def test_deconvolution_properties():
    rng = np.random.default_rng(3)
    s = (rng.random(300) < 0.03) * rng.random(300)
    c = np.zeros(300)
    for t in range(1, 300):
        c[t] = 0.85 * c[t - 1] + s[t]
    dec, spikes, b, g = deconv.deconvolve_trace(c + 0.3 + 0.03 * rng.standard_normal(300))
    assert 0.6 < g < 1 and (spikes >= 0).all() and (dec >= 0).all()
    assert np.abs(dec[1:] - g * dec[:-1] - spikes[1:]).max() < 1e-9
    assert np.corrcoef(dec, c)[0, 1] > 0.95


def test_linkage_merges_every_cluster_once():
    d = np.array([[0, 1, 4, 5], [1, 0, 3, 6], [4, 3, 0, 2], [5, 6, 2, 0]], float)
    merges = cluster.complete_linkage(d)
    assert merges == [(0, 1, 1.0, 2), (2, 3, 2.0, 2), (4, 5, 6.0, 4)]
    assert cluster.leaf_order(merges, 4) == [0, 1, 2, 3]


def test_led_equations(spark):
    row = spark.range(1).select(*[exprs.led_power(e, F.lit(3)).alias(f"c{i}") for i, e in enumerate(["y = 2 * x + 3", "y = 1 * x^2 - 2 * x + 1", "y = 2 * exp(0.5 * x) + 1", "y = 2 * x^0.5 + 1", "y = 3 * log(x) + 2", "", "y = ax + b", None])]).first()
    want = [9, 4, 2 * np.exp(1.5) + 1, 2 * 3**0.5 + 1, 3 * np.log(3) + 2, 3, 3, 3]
    assert np.allclose(list(row), want)


def test_grown_is_step_by_step_growth(spark):
    rng = random.Random(5)
    cells = {(rng.randint(0, 11), rng.randint(0, 11)) for _ in range(9)}
    df = spark.createDataFrame([("d", 0, y, x, 1) for y, x in cells], "dataset string, p int, y int, x int, label int")
    got = {(r.y, r.x) for r in pixels.grown(df, 3, 12, 12).collect()}
    grown = set(cells)
    for _ in range(3):
        grown |= {(y + dy, x + dx) for y, x in grown for dy, dx in pixels.STEPS if 0 <= y + dy < 12 and 0 <= x + dx < 12}
    assert got == grown


def _recording(spark, frames=60):
    rng = np.random.default_rng(1)
    wave = {k: 1 + 0.05 * rng.standard_normal(frames) + sum(3 * np.exp(-np.maximum(np.arange(frames) - at, 0) / 4) * (np.arange(frames) >= at) for at in (10 + k, 35)) for k in (1, 2, 3)}
    block = {(y, x): 1 + (x // 5) for y in range(4) for x in range(15) if x % 5 < 4}
    labels = spark.createDataFrame([("d", 0, y, x, k) for (y, x), k in block.items()], "dataset string, p int, y int, x int, label int")
    px = spark.createDataFrame([("d", 0, t, y, x, float(wave[k][t])) for (y, x), k in block.items() for t in range(frames)], "dataset string, p int, t int, y int, x int, value double")
    meta = spark.createDataFrame([("d", 0, t, "B5_0000", 100.0, t * 100.0, 1.0) for t in range(frames)], "dataset string, p int, t int, pos_name string, exposure_ms double, runner_time_ms double, pixel_size_um double")
    plate = spark.createDataFrame([("B5", "c1", "t1")], "well string, condition_1 string, condition_2 string")
    return px, labels, meta, plate


def test_from_pixels_to_views_and_tables(spark, tmp_path):
    px, labels, meta, plate = _recording(spark)
    area = labels.where("label = 2").select("y", "x")
    stim = spark.createDataFrame([("d", 0, 34, 5, "100")], "dataset string, p int, frame int, power int, pulse string")
    recs = analysis.analyse(px, labels, meta, Settings(), plate, 4, 15, area, stim).persist()
    rows = {r.roi: r for r in recs.collect()}
    assert set(ROI_JSON.names) - set(recs.columns) == {"elapsed_time_list_ms"}
    assert [rows[k].stimulated for k in (1, 2, 3)] == [False, True, False] and rows[1].stimulations_frames_and_powers == {"34": 5} and rows[1].evoked_experiment
    assert rows[2].mask_coord_and_shape.ys == [y for y in range(4) for _ in range(4)] and rows[2].mask_coord_and_shape.w == 15
    assert sorted(rows) == [1, 2, 3] and rows[1].fov == "B5_0000_p0" and rows[1].condition == "c1_t1" and rows[1].cell_size == 16
    assert all(r.active and len(r.raw_trace) == 60 for r in rows.values())
    skip = {"neuropil_masks", "neuropil_traces", "stim_area", "stim_rois", "stim_rois_area"}
    for name in set(views.SINGLE) - skip:
        assert views.view(name, recs).count() >= 0, name
    assert views.view("stim_peaks_amp", recs).first().power_pulse == "5%_100" and views.view("non_stim_peaks_amp", recs).first().n == 2
    assert not sinks.export_traces(recs, str(tmp_path / "t")) and not sinks.export_grouped(recs, str(tmp_path / "g"))
    back = {r.roi: r.trace for r in readers.read_trace_csv(spark, str(tmp_path / "t" / "raw_data")).collect()}
    assert np.allclose(back[2], rows[2].raw_trace)
    grouped = readers.read_grouped_csv(spark, str(tmp_path / "g"), "cell_size")
    assert grouped.first().condition == "c1_t1" and views.view("mw_cell_size", grouped).first()["mean"] == 16
    folder = tmp_path / "json"
    folder.mkdir()
    (folder / "B5_0000_p0.json").write_text(sinks.result_json(recs.drop("condition")).first().value)
    (folder / "settings.json").write_text('{"dff_window": 20, "decay constant": 0.5}')
    (folder / "C1_0001_p1.json").write_text("{broken")
    got, _, corrupt = readers.read_results(spark, str(folder))
    assert sorted(r.roi for r in got.collect()) == [1, 2, 3] and corrupt.count() == 1
    assert readers.read_settings(spark, str(folder / "settings.json")) == Settings(dff_window=20, decay_constant=0.5)


def test_fields_with_parameters_of_their_own(spark):
    """Views of many fields take each field's parameters from its first region; null leaves the caller's."""
    train = [0.0] * 10 + [1.0] * 4 + [0.0] * 10 + [1.0] * 2 + [0.0] * 14
    schema = "fov string, roi int, active boolean, raw_trace array<double>, inferred_spikes array<double>, inferred_spikes_threshold double, total_recording_time_sec double, spikes_burst_threshold double, spikes_burst_min_duration int, spikes_burst_gaussian_sigma double"
    own = {"a": (50.0, 3, 0.0), "b": (50.0, 1, 0.0), "c": (50.0, 1, 0.0), "d": (None, None, None)}
    rows = [(f, r, True, train, train, 0.5, 4.0, *(v if r == 1 else (99.0, 9, 0.0))) for f, v in own.items() for r in (1, 2)]
    recs, given = spark.createDataFrame(rows, schema), Settings(burst_min_duration=40, burst_gaussian_sigma=0.0)
    assert len(views.by_settings("burst_activity", recs, given)) == 3 and views.by_settings("iei", recs, given) == [(recs, given)]
    (narrowed,) = views.by_settings("burst_activity", recs.where("fov = 'a'"), given)
    assert narrowed[1] == Settings(burst_threshold=50.0, burst_min_duration=3, burst_gaussian_sigma=0.0)
    found = views.view("burst_activity", recs, given)
    each = {f: sorted(map(str, views.view("burst_activity", recs, given, fov=f).collect())) for f in own}
    assert sorted(map(str, found.collect())) == sorted(x for v in each.values() for x in v)
    assert len(each["a"]) == 1 and len(each["b"]) == len(each["c"]) == 2 and not each["d"]
    assert views.view("burst_activity", recs.limit(0), given).count() == 0


def test_neuropil_correction_takes_the_ring_off(spark):
    px, labels, meta, plate = _recording(spark, 20)
    grid = spark.createDataFrame([("d", 0, t, y, x, 1.0) for t in range(20) for y in range(4, 12) for x in range(15)], px.schema)
    s = Settings(neuropil_inner_radius=1, neuropil_min_pixels=3, neuropil_correction_factor=0.5)
    found = analysis.analyse(px.unionByName(grid), labels, meta.withColumn("pixel_size_um", F.lit(0.0)), s, plate, 12, 15).persist()
    recs = found.collect()
    assert {r.part for r in views.view("neuropil_masks", found).collect()} == {"cell", "ring"} and views.view("neuropil_traces", found).count() == 20 * len(recs)
    assert recs and all(r.neuropil_trace == [1.0] * 20 and r.neuropil_correction_factor == 0.5 for r in recs)
    assert all(np.allclose(np.array(r.raw_trace) - 0.5, r.corrected_trace) for r in recs)


def test_plate_map_layouts(spark):
    texts = spark.createDataFrame([('[["B5",[1,4],["c1","coral"]],["B6",1,5,"c2","red"]]',)], "value string")
    assert [tuple(r) for r in readers.parse_plate_map(texts).collect()] == [("B5", 1, 4, "c1", "coral"), ("B6", 1, 5, "c2", "red")]


def test_result_file_names(spark):
    names = ["B5_0000_p0.json", "B5_x.json", "B5_x_p0.json", "plate_plan.json", "settings.json", "genotype_plate_map.json", ".a_b.json", "B5_0000_p0.csv", "B-5_0_p0.json"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.n for r in df.where(readers.is_result_file(F.col("n"))).collect()] == ["B5_0000_p0.json", "B5_x.json"]


def plain_otsu(v, bins=256):
    lo, hi = min(v), max(v)
    step = (hi - lo) / bins
    k = [min(bins - 1, int((x - lo) / step)) for x in v]
    mid = [lo + (i + 0.5) * step for i in range(bins)]
    best, at = -1.0, 0
    for i in range(bins - 1):
        a, b = [mid[j] for j in k if j <= i], [mid[j] for j in k if j > i]
        if a and b and (score := len(a) * len(b) * (sum(a) / len(a) - sum(b) / len(b)) ** 2) > best + 1e-9:
            best, at = score, i
    return mid[at]


def plain_mask(v, sigma=2.0):
    """Stimulated pixels of one square array."""
    from tracesheaf.operators.bursts import gaussian_kernel

    n = len(v)
    if set(v.ravel()) <= {0.0, 1.0} and v.max() == 1:
        return {(y, x) for y in range(n) for x in range(n) if v[y, x] == 1}
    if v.min() == v.max():
        return set()
    for axis in (0, 1):
        v = sum(w * np.take(v, np.clip(np.arange(n) + k, 0, n - 1), axis) for k, w in gaussian_kernel(sigma))
    m = v > plain_otsu(v.ravel().tolist())
    for radius, grow in ((2, True), (2, False), (2, False), (5, True), (5, False)):
        disk = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius]
        near = lambda y, x: [m[y + a, x + b] for a, b in disk if 0 <= y + a < n and 0 <= x + b < n]  # noqa: B023, E731
        m = np.array([[(any if grow else all)(near(y, x)) for x in range(n)] for y in range(n)])
    return {(int(y), int(x)) for y, x in np.argwhere(m)}


def test_stimulation_mask_of_every_position(spark, sf):
    from tracesheaf.plans import registry
    from tracesheaf.sources import adapters

    rng = np.random.default_rng(5)
    y, x = np.mgrid[:24, :24]
    images = {1: rng.normal(5, 1, (24, 24)) + 40 * ((y - 8) ** 2 + (x - 8) ** 2 < 36), 2: rng.normal(90, 3, (24, 24)) + 500 * (x > 14), 3: ((y > 3) & (x < 9)).astype(float), 4: np.ones((24, 24)), 5: np.zeros((24, 24))}
    schema = "dataset string, p long, y int, x int, value double"
    df = spark.createDataFrame([("d", p, i, j, float(v[i, j])) for p, v in images.items() for i in range(24) for j in range(24)], schema)
    got = pixels.stimulation_mask(df, 24, 24, keys=pixels.AT)
    assert got.columns == ["dataset", "p", "y", "x"]
    rows = got.collect()
    for p in images:
        assert {(r.y, r.x) for r in rows if r.p == p} == plain_mask(images[p]), p
    alone = pixels.stimulation_mask(df.where("p = 2").select("y", "x", "value"), 24, 24)
    assert alone.columns == ["y", "x"] and {tuple(r) for r in alone.collect()} == plain_mask(images[2])
    positions = {r.p for r in pixels.max_projection(adapters.pixels(spark, sf)).select("p").distinct().collect()}
    assert {r.p for r in registry.stim_mask(spark, sf).select("p").distinct().collect()} == positions and len(positions) > 1


def test_a_repeated_condition_is_a_fault(spark):
    from tracesheaf.operators import select

    listed = spark.createDataFrame([("c1", "red"), ("c1", "red"), ("c2", "blue"), ("c3", "blue")], "condition string, color string")
    assert sorted((r.what, r.value) for r in select.plate_map_faults(listed).collect()) == [("color", "blue"), ("color", "red"), ("condition", "c1")]


def test_linkage_equals_a_plain_search():
    rng = np.random.default_rng(4)
    for n, levels in ((1, 5), (2, 5), (9, 3), (25, 4), (40, 1000)):
        d = rng.integers(1, levels + 1, (n, n)).astype(float)
        d = np.maximum(d, d.T)
        members, want = {i: [i] for i in range(n)}, []
        while len(members) > 1:
            far = {(a, b): max(d[i, j] for i in members[a] for j in members[b]) for a in members for b in members if a < b}
            a, b = min(far, key=lambda k: (far[k], k))
            both = members.pop(a) + members.pop(b)
            want.append((a, b, far[a, b], len(both)))
            members[n + len(want) - 1] = both
        assert cluster.complete_linkage(d) == want


def test_penalty_of_the_solver_by_halving():
    """The closed form on pools against halving the penalty, and the noise bound that defines it."""
    rng = np.random.default_rng(5)
    for size in (30, 80, 200):
        c = np.zeros(size)
        for t in range(1, size):
            c[t] = 0.9 * c[t - 1] + (rng.random() < 0.08) * 2
        y = c + 0.3 + 0.2 * rng.standard_normal(size)
        got, _, base, g = deconv.deconvolve_trace(y)
        powers = (g ** np.arange(size + 1.0)).tolist()
        goal = deconv.noise_sd(y) ** 2 * size
        start = deconv._settle(y, g, 0.0, max(float(np.percentile(y, 15)), 0.0), powers)
        slow, low = deconv._halved(y, g, goal, *start, powers)
        assert np.abs(got - slow).max() < 1e-6 and abs(base - low) < 1e-6
        assert ((y - base - got) ** 2).sum() <= goal * (1 + 1e-9)


def test_wide_tables_are_lines(spark, tmp_path):
    """Any number of frames, blanks between and after values, quoted keys, a header in each file, and headers of unequal length."""
    rows = [('B5,"x"_0000_p0', 1, [1.5, None, -2e-7]), ("B5_0000_p0", 2, [float(i) for i in range(5000)]), ("B5_0000_p0", 3, None), ("B6_0000_p1", 4, [])]
    df = spark.createDataFrame(rows, "fov string, roi int, v array<double>").repartition(3, "roi")
    path = str(tmp_path / "v")
    sinks.write_traces(df, "v", path)
    files = [f.read_text() for f in (tmp_path / "v").glob("*.txt")]
    assert all(f.startswith("key,t0,t1,") and f.count("key,t0,") == 1 for f in files if f) and files
    got = {(r.fov, r.roi): r.trace for r in readers.read_trace_csv(spark, path).collect()}
    assert got == {(f, k): v for f, k, v in rows if v is not None}
    assert len(sinks.wide_traces(df.where("roi <> 2"), "v").columns) == 4
    sinks.write_traces(df.where("roi > 3"), "v", str(tmp_path / "none"))
    assert readers.read_trace_csv(spark, str(tmp_path / "none")).first().trace == []
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "a.csv").write_text(",t0,t1\r\nB1_0_p0_1,1,2\r\n")
    (tmp_path / "more" / "b.csv").write_text("key,t0,t1,t2\nB1_0_p0_2,3,,4\n")
    assert sorted((r.roi, r.trace) for r in readers.read_trace_csv(spark, str(tmp_path / "more")).collect()) == [(1, [1.0, 2.0]), (2, [3.0, None, 4.0])]


def test_grouped_tables_are_lines(spark, tmp_path):
    names = [f"c{i}" for i in range(300)] + ["a, b"]
    rows = [(f, c, 1.0 + i, None if i % 2 else 0.5, i) for f in ("B1_0", "B2_0") for i, c in enumerate(names) if i % 7 or f == "B1_0"]
    df = spark.createDataFrame(rows, "fov string, condition string, mean double, sem double, n long")
    sinks.write_csv(stats.wide(df).withColumnRenamed("fov", "FOV"), str(tmp_path / "t" / "cell_size"))
    got = {(r.fov, r.condition): (r["mean"], r["sem"], r.n) for r in readers.read_grouped_csv(spark, str(tmp_path / "t"), "cell_size").collect()}
    assert got == {(f, c): (m, s, float(n)) for f, c, m, s, n in rows}
    with pytest.raises(FileNotFoundError):
        readers.read_grouped_csv(spark, str(tmp_path / "t"), "cell")


def test_the_certificate_tells_solutions_apart(spark):
    """What the solver returns passes, and a trace with a spike moved, a baseline off or a lesser penalty does not."""
    rng = np.random.default_rng(6)
    c = np.zeros(200)
    for t in range(1, 200):
        c[t] = 0.9 * c[t - 1] + (rng.random() < 0.06) * 2
    y = c + 0.3 + 0.2 * rng.standard_normal(200)
    dec, spikes, base, g = deconv.deconvolve_trace(y)
    powers = (g ** np.arange(201.0)).tolist()
    loose, low = deconv._settle(y, g, 0.0, base, powers)
    s0 = np.maximum(np.append(0.0, loose[1:] - g * loose[:-1]), 0.0)
    less = dec.copy()
    less[spikes.argmax() :] -= 0.3 * g ** np.arange(200 - spikes.argmax())
    cases = {"right": (dec, spikes, base), "base": (dec, spikes, base + 0.05), "penalty": (loose, s0, low), "negative": (dec, spikes - 1e-3, base), "moved": (less, spikes, base)}
    rows = [(k, y.tolist(), a.tolist(), s.tolist(), float(b), float(g)) for k, (a, s, b) in cases.items()] + [("none", None, None, None, None, None), ("short", [1.0, 2.0], [float("nan")] * 2, [float("nan")] * 2, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "k string, trace array<double>, dec array<double>, spikes array<double>, dec_baseline double, dec_g double")
    got = {r.k: (r.feasible, r.stationary, r.at_noise) for r in deconv.certificate(df).collect()}
    assert got["right"] == (True, True, True) and got["none"] == got["short"] == (None, None, None)
    assert not got["base"][1] and got["penalty"][:2] == (True, True) and not got["penalty"][2] and not got["negative"][0] and not got["moved"][0]


def test_settings_files(spark, tmp_path):
    for name, text in {"a": '{"dff_window": 20, "decay constant": 0.5, "led_power_equation": null}', "b": "{broken", "c": '{"neuropil_inner_radius": 2, "other": [1]}'}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "settings.json").write_text(text)
    got = {r.path.split("/")[-2]: Settings(**{k: v for k, v in r.asDict().items() if k != "path"}) for r in readers.read_all_settings(spark, str(tmp_path)).collect()}
    assert got == {"a": Settings(dff_window=20, decay_constant=0.5), "b": Settings(), "c": Settings(neuropil_inner_radius=2)}


def test_results_by_line(spark, tmp_path):
    """Fields of odd names and many regions there and back, valid JSON in each file, a broken line in one, and files of others beside them."""
    import json

    rows = [(f, r, [r / 7, None], r % 2 == 0, ([1, 2], [r, r + 1], 9, 9) if r % 3 else None) for f in ("B5_0000_p0", "B6 ü%/_x") for r in range(300)]
    df = spark.createDataFrame(rows, "fov string, roi int, dff array<double>, active boolean, mask_coord_and_shape struct<ys:array<int>,xs:array<int>,h:int,w:int>").repartition(7)
    path = tmp_path / "r"
    sinks.write_results(df, str(path))
    files = list(path.glob("fov=*/*.txt"))
    assert len(files) == 2 and all(list(map(int, json.loads(f.read_text()))) == list(range(300)) for f in files)
    (path / "B7_1.json").write_text('{"4": {"dff": [2.5], "other": 1}, "all": {"x": 1}}')
    (path / "B8_1.json").write_text('{"4"')
    (path / "fov=B9_1").mkdir()
    (path / "fov=B9_1" / "part-0.txt").write_text('{\n"1":{"dff":[1.0]}\n,"2":{"dff":[\n}\n')
    records, others, corrupt = readers.read_results(spark, str(path))
    got = {(r.fov, r.roi): (r.dff, r.active, r.mask_coord_and_shape and tuple(r.mask_coord_and_shape)) for r in records.collect()}
    assert {k: got[k] for k in got if k[0] not in ("B7_1", "B9_1")} == {(f, r): (d, a, m) for f, r, d, a, m in rows}
    assert got["B7_1", 4][0] == [2.5] and got["B9_1", 1][0] == [1.0] and [tuple(r) for r in others.collect()] == [("B7_1", "all", '{"x":1}')]
    assert sorted(r.fov for r in corrupt.collect()) == ["B8_1", "B9_1"]
