"""The SQL of registered queries, for DuckDB on the same tables. Common table expressions mirror sources/adapters.py."""

from __future__ import annotations

from tracesheaf.plans import file_sql, view_sql

_CTE = {
    "tr": "SELECT user_id % 10 AS fov, user_id AS roi, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, epoch_us(ts) // 1000 AS t_ms, value, event_type, props FROM events",
    "trb": "SELECT l_suppkey AS roi, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS frame, l_extendedprice AS value FROM lineitem",
    "rois": "SELECT DISTINCT fov, roi FROM tr",
    "ff": "SELECT fov, max(frame) + 1 AS n_frames, (max(t_ms) - min(t_ms)) / 1000 AS seconds FROM tr GROUP BY fov",
    "p75": "SELECT roi, quantile_cont(value, 0.75) AS p75 FROM tr GROUP BY roi",
    "spk": "SELECT fov, roi, frame, value AS amplitude FROM tr JOIN p75 USING (roi) WHERE value > p75",
    "med": "SELECT roi, median(value) AS m FROM tr GROUP BY roi",
    "nz": "SELECT fov, roi, median(abs(value - m)) / 0.6745 AS noise FROM tr JOIN med USING (roi) GROUP BY fov, roi",
    "chg": "SELECT *, CASE WHEN lag(value) OVER w IS DISTINCT FROM value THEN 1 ELSE 0 END AS c FROM tr WINDOW w AS (PARTITION BY roi ORDER BY frame)",
    "isl": "SELECT *, sum(c) OVER (PARTITION BY roi ORDER BY frame) AS g FROM chg",
    "runs": "SELECT fov, roi, g, min(frame) AS s, max(frame) AS e, any_value(value) AS v FROM isl GROUP BY fov, roi, g",
    "nb": "SELECT *, lag(v) OVER w AS pv, lead(v) OVER w AS nv FROM runs WINDOW w AS (PARTITION BY roi ORDER BY g)",
    "cand": "SELECT nb.fov, nb.roi, CAST(floor((s + e) / 2) AS BIGINT) AS frame, v AS amplitude, noise FROM nb JOIN nz ON nb.roi = nz.roi WHERE v > pv AND v > nv AND v >= noise",
    "bounds": "SELECT c.fov, c.roi, c.frame, c.amplitude, c.noise, coalesce(max(CASE WHEN t.frame < c.frame AND t.value > c.amplitude THEN t.frame END), -1) AS lb, coalesce(min(CASE WHEN t.frame > c.frame AND t.value > c.amplitude THEN t.frame END), 1000000000) AS rb FROM cand c JOIN tr t USING (roi) GROUP BY ALL",
    "pk": "SELECT b.fov, b.roi, b.frame, b.amplitude FROM bounds b JOIN tr t USING (roi) GROUP BY b.fov, b.roi, b.frame, b.amplitude, b.noise, b.lb, b.rb HAVING b.amplitude - greatest(min(CASE WHEN t.frame > b.lb AND t.frame <= b.frame THEN t.value END), min(CASE WHEN t.frame >= b.frame AND t.frame < b.rb THEN t.value END)) >= b.noise",
    "np": "SELECT rois.fov, rois.roi, count(pk.frame) AS n_peaks FROM rois LEFT JOIN pk USING (roi) GROUP BY ALL",
    "gm": "SELECT 'c' || (rois.roi % 3) AS condition, rois.fov, avg(amplitude) AS mean, CASE WHEN count(amplitude) = 1 THEN 0 ELSE stddev_samp(amplitude) / sqrt(count(amplitude)) END AS sem, count(amplitude) AS n FROM rois LEFT JOIN pk USING (roi) GROUP BY ALL",
    "pa": "SELECT 'c' || (roi % 3) AS condition, fov, 100 * avg(CASE WHEN n_peaks > 8 THEN 1 ELSE 0 END) AS pct, count(*) AS n FROM np GROUP BY ALL",
    "prs": "SELECT a.fov, a.roi AS roi_i, b.roi AS roi_j FROM rois a JOIN rois b ON a.fov = b.fov AND a.roi < b.roi",
    "cnt": "SELECT roi, count(*) AS n FROM spk GROUP BY roi",
    "pn": "SELECT prs.*, coalesce(a.n, 0) AS n_i, coalesce(b.n, 0) AS n_j FROM prs LEFT JOIN cnt a ON a.roi = roi_i LEFT JOIN cnt b ON b.roi = roi_j",
    "nij": "SELECT a.roi AS roi_i, b.roi AS roi_j, count(*) AS n_ij FROM spk a JOIN spk b ON a.fov = b.fov AND a.frame = b.frame AND a.roi < b.roi GROUP BY ALL",
    "ps": "SELECT pn.fov, roi_i, roi_j, coalesce(abs(n_frames::DOUBLE * coalesce(n_ij, 0) - n_i * n_j) / nullif(sqrt(n_i * (n_frames::DOUBLE - n_i) * n_j * (n_frames::DOUBLE - n_j)), 0), 0) AS value FROM pn LEFT JOIN nij USING (roi_i, roi_j) JOIN ff ON ff.fov = pn.fov",
    "mir": "SELECT fov, roi_i, roi_j, value FROM ps UNION ALL SELECT fov, roi_j, roi_i, value FROM ps",
    "con": "SELECT ps.*, threshold, value >= threshold AS connected FROM ps JOIN (SELECT fov, quantile_cont(value, 0.9) AS threshold FROM mir GROUP BY fov) USING (fov)",
    "act": "SELECT g.fov, g.frame, count(DISTINCT s.roi) / any_value(k.n)::DOUBLE AS activity FROM (SELECT fov, unnest(range(n_frames)) AS frame FROM ff) g JOIN (SELECT fov, count(DISTINCT roi) AS n FROM spk GROUP BY fov HAVING n >= 2) k ON g.fov = k.fov LEFT JOIN spk s ON s.fov = g.fov AND s.frame = g.frame GROUP BY ALL",
    "ker": "SELECT k, exp(-0.5 * (k / 2.0) ** 2) / sum(exp(-0.5 * (k / 2.0) ** 2)) OVER () AS w FROM (SELECT unnest(range(-8, 9)) AS k)",
    "nf": "SELECT fov, max(frame) + 1 AS n FROM act GROUP BY fov",
    "idx": "SELECT a.fov, a.frame, w, ((a.frame + k) % (2 * n) + 2 * n) % (2 * n) AS m, n FROM act a JOIN nf USING (fov), ker",
    "smo": "SELECT i.fov, i.frame, sum(w * a.activity) AS smooth FROM idx i JOIN act a ON a.fov = i.fov AND a.frame = CASE WHEN m < n THEN m ELSE 2 * n - 1 - m END GROUP BY ALL",
    "hi": "SELECT fov, frame, frame - row_number() OVER (PARTITION BY fov ORDER BY frame) AS g FROM smo WHERE smooth > 0.2",
    "bst": "SELECT fov, row_number() OVER (PARTITION BY fov ORDER BY min(frame)) AS burst_id, min(frame) AS start, max(frame) + 1 AS \"end\" FROM hi GROUP BY fov, g HAVING count(*) >= 3",
    "stm": "SELECT fov, frame, max(CAST(props ->> '$.k' AS INTEGER)) AS power, '100' AS pulse FROM tr WHERE event_type = 'click' GROUP BY fov, frame",
    "after5": "SELECT s.fov, pk.roi, s.frame AS stim_frame, s.power, s.pulse, min(pk.frame) AS frame, arg_min(pk.amplitude, pk.frame) AS amplitude FROM stm s JOIN pk ON pk.fov = s.fov AND pk.frame BETWEEN s.frame AND s.frame + 5 GROUP BY ALL",
    "evk": "SELECT fov, roi, roi % 4 = 0 AS stimulated, power || '%_' || pulse AS power_pulse, amplitude FROM after5",
    "pix": "SELECT l_linenumber::BIGINT AS p, year(l_shipdate) * 12 + month(l_shipdate) - 1992 * 12 AS t, l_partkey % 32 AS y, l_suppkey % 32 AS x, avg(l_quantity) AS value FROM lineitem GROUP BY ALL",
    "lab": "SELECT DISTINCT l_linenumber::BIGINT AS p, l_partkey % 32 AS y, l_suppkey % 32 AS x, ((l_partkey % 32) // 8) * 4 + (l_suppkey % 32) // 8 + 1 AS label FROM lineitem WHERE l_partkey % 8 < 7 AND l_suppkey % 8 < 7",
    "geo": "SELECT p, label, count(*) AS n, avg(y) AS cy, avg(x) AS cx, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM lab GROUP BY ALL",
    "arr": "SELECT label::BIGINT AS fov, vec_id AS roi, embedding::DOUBLE[] AS trace FROM embeddings",
    "arl": "SELECT fov, roi, unnest(trace) AS v, generate_subscripts(trace, 1) AS i FROM arr",
    "plt": "SELECT 'W' || s_suppkey AS well, r_name AS condition_1, n_name AS condition_2 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "spx": "SELECT DISTINCT y, x FROM lab WHERE (y - 14) * (y - 14) + (x - 12) * (x - 12) < 90",
    "ovl": "SELECT lab.p AS fov, label AS roi, count(spx.y) / count(*)::DOUBLE AS overlap FROM lab LEFT JOIN spx USING (y, x) GROUP BY ALL",
}


def _uses(sql: str) -> list[str]:
    """The table expressions that ``sql`` needs, in order of definition."""
    import re

    need, todo = set(), [sql]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for k in words & set(_CTE) - need:
            need.add(k)
            todo.append(_CTE[k])
    return [k for k in _CTE if k in need]


def _with(sql: str) -> str:
    used = _uses(sql)
    if sql.lstrip().startswith("WITH RECURSIVE"):
        sql = f"SELECT * FROM ({sql})"
    return ("WITH " + ", ".join(f"{k} AS ({_CTE[k]})" for k in used) + " " if used else "") + sql


def _burst(length: str, gap: str) -> str:
    each = f"SELECT fov, count(*) AS c, avg({length}) AS length, avg(gap) AS gap FROM (SELECT *, {gap} AS gap FROM bst WINDOW w AS (PARTITION BY fov ORDER BY start)) GROUP BY fov"
    dt = "(seconds / (n_frames - 1))"
    return f"SELECT ff.fov, coalesce(c, 0) AS count, round(coalesce(length * {dt}, 0), 6) AS avg_duration_sec, round(coalesce(gap * {dt}, 0), 6) AS avg_interval_sec, round(coalesce(c / (seconds / 60), 0), 6) AS rate_burst_per_min FROM ff LEFT JOIN ({each}) b ON b.fov = ff.fov"


def _pivot(cte: str, row: str, values: dict[str, str]) -> str:
    cols = ", ".join(f"max(CASE WHEN condition = 'c{i}' THEN {v} END) AS c{i}{s}" for i in range(3) for v, s in values.items())
    return f"SELECT {row}, {cols} FROM {cte} GROUP BY {row}"


_XCORR = "SELECT a.fov, a.roi AS roi_i, b.roi AS roi_j, round({best}, 6) AS value FROM ({src}) a JOIN ({src}) b ON a.fov = b.fov AND a.roi < b.roi"
_LAGS = "list_max(list_transform(range(-63, 64), lambda k: {f}(list_sum(list_transform(range(greatest(0, k), least(64, 64 + k)), lambda i: a.x[i + 1] * b.x[i - k + 1])))))"
_RING_GROW = "SELECT p, label, y + dy AS y, x + dx AS x, min(abs(dy) + abs(dx)) AS d FROM lab, (SELECT unnest(range(-{n}, {n} + 1)) AS dy), (SELECT unnest(range(-{n}, {n} + 1)) AS dx) WHERE abs(dy) + abs(dx) <= {n} AND y + dy BETWEEN 0 AND {h} AND x + dx BETWEEN 0 AND {h} GROUP BY ALL"

_BODY = {
    "roi_select": "SELECT fov, roi, frame, round(value, 6) AS value FROM tr WHERE roi BETWEEN 3 AND 20 OR roi = 25",
    "active_filter": "SELECT fov, roi, n_peaks FROM np WHERE n_peaks > 0",
    "condition_key": "SELECT well, coalesce(nullif(concat_ws('_', nullif(CASE WHEN length(condition_2) % 3 = 0 THEN '' ELSE condition_1 END, ''), nullif(CASE WHEN length(condition_1) % 2 = 0 THEN NULL ELSE condition_2 END, '')), ''), 'NoCondition') AS condition FROM plt",
    "fov_name": "SELECT s_suppkey, fov, split_part(fov, '_', 1) AS well FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN 'B' || s_nationkey || '_0000' ELSE 'pos_' || lpad(s_suppkey::VARCHAR, 4, '0') END || '_p' || s_suppkey AS fov FROM supplier)",
    "small_roi_filter": "SELECT p, label, round(CASE WHEN p <= 2 THEN n ELSE n * 0.45::DOUBLE * 0.45::DOUBLE END, 6)::DOUBLE AS area, CASE WHEN p = 1 THEN 'pixel' ELSE 'µm' END AS unit FROM geo WHERE p <= 2 OR n * 0.45::DOUBLE * 0.45::DOUBLE >= 10",
    "missing_labels": "SELECT DISTINCT 'd' AS dataset, p FROM pix WHERE p NOT IN (SELECT p FROM lab WHERE p < 6)",
    "plate_join": "SELECT w AS well, w || '_0000_p0' AS fov, CASE WHEN length(well) <> 3 THEN condition_1 END AS condition_1, CASE WHEN condition_2 <> 'nation_1' THEN condition_2 END AS condition_2 FROM (SELECT 'W' || s_suppkey AS w FROM supplier) LEFT JOIN plt ON w = well",
    "plate_faults": "SELECT 'condition' AS what, condition_1 AS value, count(DISTINCT condition_2) AS count FROM plt GROUP BY ALL HAVING count(DISTINCT condition_2) > 1 UNION ALL SELECT 'color', condition_2, count(DISTINCT condition_1) FROM plt GROUP BY ALL HAVING count(DISTINCT condition_1) > 1",
    "isel": "SELECT y, x, round(value, 6) AS value, 'd' AS dataset FROM pix WHERE p = 2 AND t = (SELECT min(t) + 20 FROM pix)",
    "metadata_at": "SELECT event_id FROM events WHERE CAST(props ->> '$.k' AS INTEGER) = 3",
    "dff": "SELECT fov, roi, frame, round(b, 6) AS baseline, round((value - b) / nullif(b, 0), 6) AS dff FROM (SELECT *, quantile_cont(value, 0.1) OVER (PARTITION BY fov, roi ORDER BY frame ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS b FROM tr)",
    "dff_big": "SELECT roi, frame, round(quantile_cont(value, 0.1) OVER (PARTITION BY roi ORDER BY frame ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING), 6) AS baseline FROM trb",
    "noise_mad": "SELECT fov, roi, round(noise, 6) AS noise FROM nz",
    "zscore": "SELECT fov, roi, frame, round((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0), 6) AS z FROM tr WINDOW w AS (PARTITION BY roi)",
    "normalize_pct": "SELECT fov, roi, frame, round(CASE WHEN hi = lo THEN 0 ELSE least(1, greatest(0, (value - lo) / (hi - lo))) END, 6) AS norm FROM tr JOIN (SELECT fov, quantile_cont(value, 0.05) AS lo, max(value) AS hi FROM tr GROUP BY fov) USING (fov)",
    "recording_time": "SELECT fov, roi, count(*) AS n_frames, round((max(t_ms) - min(t_ms)) / 1000, 6) AS seconds FROM tr GROUP BY ALL",
    "elapsed_times": "SELECT roi, frame, round(CASE WHEN count(r) OVER w = count(*) OVER w THEN r ELSE frame * 50.0 END, 6)::DOUBLE AS t_ms FROM (SELECT roi, frame, CASE WHEN roi % 2 = 0 OR frame % 9 > 0 THEN (t_ms - min(t_ms) OVER (PARTITION BY roi))::DOUBLE END AS r FROM tr) WINDOW w AS (PARTITION BY roi)",
    "neuropil_correct": "SELECT a.fov, a.roi, a.frame, round(a.value - 0.7::DOUBLE * coalesce(b.value, 0), 6) AS corrected FROM tr a LEFT JOIN tr b ON b.fov = a.fov AND b.roi - 10 = a.roi AND b.frame = a.frame",
    "peaks": "SELECT fov, roi, frame, round(amplitude, 6) AS amplitude FROM pk",
    "iei": "SELECT fov, roi, round(avg(d), 9) AS iei, round(avg(d) / sqrt(count(d)), 9) AS iei_err FROM gap GROUP BY ALL",
    "frequency": "SELECT np.fov, np.roi, round(CASE WHEN n_peaks > 0 AND s > 0 THEN n_peaks / s END, 6) AS frequency FROM np JOIN (SELECT roi, (max(t_ms) - min(t_ms)) / 1000 AS s FROM tr GROUP BY roi) USING (roi)",
    "amplitude": "SELECT fov, roi, round(avg(amplitude), 6) AS mean, round(CASE WHEN count(*) > 1 THEN stddev_samp(amplitude) / sqrt(count(*)) END, 6) AS sem, count(*) AS n FROM pk GROUP BY ALL",
    "spike_threshold": "SELECT fov, roi, round(r, 6)::DOUBLE AS reference, round(r, 6)::DOUBLE AS threshold FROM (SELECT fov, roi, CASE WHEN count(v) > 5 THEN quantile_cont(v, 0.05) ELSE 0.01::DOUBLE END AS r FROM (SELECT fov, roi, CASE WHEN value - 60 > 0 THEN value - 60 END AS v FROM tr) GROUP BY ALL)",
    "thresholded_spikes": "SELECT fov, tr.roi, frame, round(CASE WHEN value > m THEN value ELSE 0 END, 6) AS value FROM tr JOIN med ON med.roi = tr.roi",
    "raster_scale": "SELECT fov, roi, frame, round(amplitude, 6) AS amplitude, round(lo, 6) AS vmin, round(CASE WHEN hi * 0.5 > lo THEN hi * 0.5 WHEN hi > lo THEN hi ELSE lo + 0.1 END, 6) AS vmax FROM (SELECT *, min(amplitude) OVER (PARTITION BY fov) AS lo, max(amplitude) OVER (PARTITION BY fov) AS hi FROM pk)",
    "spike_raster": "SELECT fov, roi, frame, round(lo, 6) AS vmin, round(lo + (hi - lo) * 0.5, 6) AS vmax FROM (SELECT *, min(amplitude) OVER (PARTITION BY fov) AS lo, max(amplitude) OVER (PARTITION BY fov) AS hi FROM spk)",
    "grouped_mean_sem": "SELECT condition, fov, round(mean, 6) AS mean, round(sem, 6) AS sem, n FROM gm",
    "percent_active": "SELECT condition, fov, round(pct, 6) AS pct, n FROM pa",
    "weighted_pooled_sem": "SELECT condition, round(CASE WHEN any_value(N_) > 1 THEN any_value(wm) ELSE avg(mean) END, 6) AS mean, round(CASE WHEN any_value(N_) > 1 THEN sqrt(sum((n - 1) * sem * sem + n * (mean - wm) ** 2) / (any_value(N_) - 1)) / sqrt(any_value(N_)) ELSE avg(sem) END, 6) AS sem, any_value(N_)::BIGINT AS n FROM (SELECT *, sum(n) OVER (PARTITION BY condition) AS N_, sum(n * mean) OVER (PARTITION BY condition) / sum(n) OVER (PARTITION BY condition) AS wm FROM gm WHERE mean IS NOT NULL AND sem IS NOT NULL) GROUP BY condition",
    "binomial_sem": "SELECT condition, round(100 * p, 6) AS pct, round(CASE WHEN p <= 0 OR p >= 1 THEN 0 ELSE 100 * sqrt(p * (1 - p) / n_) END, 6) AS sem, n_::BIGINT AS n FROM (SELECT condition, sum(pct / 100 * n) / sum(n) AS p, sum(n) AS n_ FROM pa GROUP BY condition)",
    "single_value_stats": "SELECT condition, round(avg(mean), 6) AS mean, round(CASE WHEN count(mean) = 1 THEN 0 ELSE stddev_samp(mean) / sqrt(count(mean)) END, 6) AS sem, count(mean) AS n FROM gm GROUP BY condition",
    "wide_pivot": _pivot("gm", "fov", {"round(mean, 6)": "_Mean", "round(sem, 6)": "_SEM", "n": "_N"}),
    "ragged_columns": _pivot("(SELECT *, row_number() OVER (PARTITION BY condition ORDER BY fov) AS row FROM pa WHERE NOT (condition = 'c1' AND fov > 6))", "row", {"round(pct, 6)": "_pct", "n": "_n"}),
    "value_table": _pivot("(SELECT condition, round_even(sem, 4) AS value, row_number() OVER (PARTITION BY condition ORDER BY fov) AS row FROM gm WHERE NOT (condition = 'c2' AND fov < 3))", "row", {"value": ""}),
    "trace_table": "SELECT fov || '_' || roi AS key, " + ", ".join(f"round(trace[{i + 1}], 6) AS t{i}" for i in range(64)) + " FROM arr",
    "first_settings": "SELECT fov, round(arg_min(noise, roi), 6) AS noise FROM nz GROUP BY fov",
    "jitter_sync": "SELECT pn.fov, roi_i, roi_j, round(CASE WHEN n_i > 0 AND n_j > 0 THEN coalesce(h, 0) / (n_i + n_j)::DOUBLE ELSE 0 END, 6) AS value FROM pn LEFT JOIN (SELECT least(r, o) AS roi_i, greatest(r, o) AS roi_j, count(*) AS h FROM (SELECT DISTINCT a.roi AS r, b.roi AS o, a.frame FROM spk a JOIN spk b ON a.fov = b.fov AND a.roi <> b.roi AND abs(a.frame - b.frame) <= 2) GROUP BY ALL) USING (roi_i, roi_j)",
    "xcorr_sync": "SELECT pn.fov, roi_i, roi_j, round(CASE WHEN n_i > 0 AND n_j > 0 THEN least(1, coalesce(c, 0) / sqrt(n_i * n_j)) ELSE 0 END, 6) AS value FROM pn LEFT JOIN (SELECT roi_i, roi_j, max(c) AS c FROM (SELECT a.roi AS roi_i, b.roi AS roi_j, b.frame - a.frame AS lag, count(*) AS c FROM spk a JOIN spk b ON a.fov = b.fov AND a.roi < b.roi AND abs(a.frame - b.frame) <= 5 GROUP BY ALL) GROUP BY ALL) USING (roi_i, roi_j)",
    "pearson_sync": "SELECT fov, roi_i, roi_j, round(value, 6) AS value FROM ps",
    "global_sync": "SELECT fov, round(median(m), 6) AS value FROM (SELECT fov, roi_i, avg(value) AS m FROM mir GROUP BY ALL) GROUP BY fov",
    "phase_locking": "SELECT fov, roi_i, roi_j, round(sqrt(avg(cos(d)) ** 2 + avg(sin(d)) ** 2), 6) AS value FROM (SELECT a.fov, a.roi AS roi_i, b.roi AS roi_j, a.ph - b.ph AS d FROM ph a JOIN ph b ON a.fov = b.fov AND a.frame = b.frame AND a.roi < b.roi) GROUP BY ALL",
    "trace_xcorr": _XCORR.format(best=_LAGS.format(f="") + " / (a.nrm * b.nrm)", src="SELECT fov, roi, list_transform(trace, lambda v: v - list_avg(trace)) AS x, sqrt(list_sum(list_transform(trace, lambda v: (v - list_avg(trace)) ** 2))) AS nrm FROM arr"),
    "spike_xcorr": _XCORR.format(best="CASE WHEN a.nrm = 0 OR b.nrm = 0 THEN 0 ELSE " + _LAGS.format(f="abs") + " / (a.nrm * b.nrm) END", src="SELECT fov, roi, list_transform(trace, lambda v: (v > 0.15::DOUBLE)::INT::DOUBLE) AS x, sqrt(list_sum(list_transform(trace, lambda v: (v > 0.15::DOUBLE)::INT::DOUBLE))) AS nrm FROM arr"),
    "connectivity": "SELECT fov, roi_i, roi_j, round(value, 6) AS value, round(threshold, 6) AS threshold, connected FROM con",
    "network_density": "SELECT fov, n AS nodes, e AS edges, round(100.0::DOUBLE * e * 2 / (n * (n - 1)), 6) AS density_pct FROM (SELECT fov, count(DISTINCT roi_i) AS n FROM mir GROUP BY fov) JOIN (SELECT fov, count(*) FILTER (connected) AS e FROM con GROUP BY fov) USING (fov)",
    "network_edges": "SELECT fov, roi_i, roi_j, round(abs(value), 6) AS weight, sign(value)::BIGINT AS sign, roi_i % 32 AS cy_i, roi_i % 29 AS cx_i, roi_j % 32 AS cy_j, roi_j % 29 AS cx_j FROM con WHERE connected",
    "population_activity": "SELECT fov, frame, round(activity, 6) AS activity FROM act",
    "smoothed": "SELECT fov, frame, round(smooth, 6) AS smooth FROM smo",
    "burst_runs": 'SELECT fov, burst_id, start, "end" FROM bst',
    "burst_stats": _burst('"end" - start', 'lead(start) OVER w - "end"'),
    "burst_stats_panel": _burst('"end" - start - 1', 'start - (lag("end") OVER w - 1)'),
    "burst_overlay": 'SELECT fov, row_number() OVER (PARTITION BY fov ORDER BY min(frame)) AS burst_id, min(frame) AS start, max(frame) + 1 AS "end" FROM (SELECT fov, frame, frame - row_number() OVER (PARTITION BY fov ORDER BY frame) AS g FROM osm WHERE smooth > 0.25::DOUBLE) GROUP BY fov, g HAVING count(*) >= 3',
    "forward_asof": "SELECT fov, roi, stim_frame, power::BIGINT AS power, pulse, frame, round(amplitude, 6) AS amplitude FROM after5",
    "evoked_amplitudes": "SELECT c.condition || CASE WHEN stimulated THEN '_evk_stim_' ELSE '_evk_non_stim_' END || power_pulse AS condition, fov, round(avg(amplitude), 9) AS mean, round(CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(amplitude) / sqrt(count(*)) END, 9) AS sem, count(*) AS n FROM evk JOIN (SELECT substr(well, 2)::BIGINT % 10 AS fov, min(condition_1) AS condition FROM plt GROUP BY 1) c USING (fov) GROUP BY ALL",
    "evoked_panel": "SELECT fov, stimulated, power_pulse, round(avg(amplitude), 6) AS mean, round(stddev_pop(amplitude) / sqrt(count(*)), 6) AS err, count(*) AS n FROM evk GROUP BY ALL",
    "led_power": "SELECT event_id, k, round(11.0::DOUBLE * k - 6, 6) AS lin, round(0.5::DOUBLE * k * k + 2 * k - 1, 6) AS quad, round(2 * exp(0.1::DOUBLE * k) + 1, 6) AS exp, round(3 * k ** 1.5::DOUBLE + 2, 6) AS pow, round(4 * ln(k) + 1, 6) AS log, k::DOUBLE AS none, l || 'mW/cm²_100' AS label, 'c1_evk_stim' AS tag, (11 * k - 6)::DOUBLE AS intensity, l AS tick, 'mW/cm²' AS unit FROM (SELECT event_id, CAST(props ->> '$.k' AS BIGINT) + 1 AS k, printf('%.3f', 11.0 * (CAST(props ->> '$.k' AS BIGINT) + 1) - 6) AS l FROM events)",
    "display_condition": "SELECT DISTINCT 'c1_t1' || CASE WHEN stimulated THEN '_evk_stim_' ELSE '_evk_non_stim_' END || power_pulse AS key, 'c1_t1_' || split_part(power_pulse, '_', 1) AS label FROM evk",
    "stim_overlap": "SELECT fov, roi, round(overlap, 6) AS overlap, overlap > 0.1::DOUBLE AS stimulated FROM ovl",
    "label_class": "SELECT p AS fov, label AS roi, y, x, CASE WHEN label % 5 = 0 THEN 'other' WHEN overlap > 0.1::DOUBLE THEN 'stimulated' ELSE 'non_stimulated' END AS class FROM lab JOIN ovl ON ovl.fov = p AND ovl.roi = label",
    "roi_traces": "SELECT p, label, t AS frame, round(avg(value), 6) AS value FROM pix JOIN lab USING (p, y, x) GROUP BY ALL",
    "max_projection": "SELECT p, y, x, round(max(value), 6) AS value FROM pix JOIN (SELECT p, (max(t) + 1) // 2 AS h FROM pix GROUP BY p) USING (p) WHERE t >= h GROUP BY ALL",
    "roi_geometry": "SELECT p, label, n, round(cy, 6) AS cy, round(cx, 6) AS cx, y0, y1, x0, x1 FROM geo",
    "erode": "SELECT a.p, a.label, a.y, a.x FROM lab a JOIN lab b ON b.p = a.p AND b.label = a.label AND abs(b.y - a.y) + abs(b.x - a.x) = 1 GROUP BY ALL HAVING count(*) = 4",
    "grow": "SELECT p, label, y, x, d FROM (" + _RING_GROW.format(n=2, h=31) + ")",
    "neuropil_ring": "SELECT p, label, y, x FROM rng JOIN (SELECT p, label, min(k) AS need FROM (SELECT p, label, k, sum(count(*)) OVER (PARTITION BY p, label ORDER BY k) AS c FROM rng GROUP BY p, label, k) WHERE c >= 20 GROUP BY ALL) USING (p, label) WHERE k <= need",
    "composite": "SELECT p, y, x, max(label) AS label FROM (" + _RING_GROW.format(n=2, h=31) + ") GROUP BY ALL",
    "masks": "SELECT p, label, y, x FROM lab",
    "highlight": "SELECT a.p, a.y, a.x, a.label, b.label AS under FROM lab a LEFT JOIN lab b ON b.p = a.p AND b.y = 9 AND b.x = 4 WHERE a.label IN (2, 5, 7)",
    "batch_inference": "SELECT p, y, x, 1::BIGINT AS label FROM (SELECT *, avg(value) OVER (PARTITION BY p) AS m FROM mpj) WHERE value > m",
    "json_roundtrip": "SELECT np.fov, np.roi, n_peaks, round(coalesce(t, 0), 6)::DOUBLE AS total, n_peaks > 0 AS active FROM np LEFT JOIN (SELECT roi, sum(amplitude) AS t FROM pk GROUP BY roi) USING (roi)",
    "plate_map_json": "SELECT 'W' || s_suppkey AS well, s_suppkey % 8 AS row, s_suppkey % 12 AS col, s_name AS condition, 'coral' AS color FROM supplier",
}

#: The correlations without rounding.
_EXACT = {k: _BODY[k].replace("round(", "(", 1).replace(", 6) AS value", ") AS value", 1) for k in ("trace_xcorr", "spike_xcorr")}
_CTE["mpj"] = "SELECT p, y, x, max(value) AS value FROM pix JOIN (SELECT p, (max(t) + 1) // 2 AS h FROM pix GROUP BY p) USING (p) WHERE t >= h GROUP BY ALL"
_CTE["rng"] = "SELECT p, label, y, x, ceil((d - 1) / 5)::BIGINT AS k FROM (" + _RING_GROW.format(n=21, h=31) + ") WHERE d > 1 AND (p, y, x) NOT IN (SELECT (p, y, x) FROM lab)"
_CTE["nxt"] = "SELECT fov, roi, frame, lead(frame) OVER (PARTITION BY roi ORDER BY frame) AS nx FROM pk"
_CTE["ph"] = "SELECT fov, roi, unnest(range(frame, nx)) AS frame, 2 * pi() * (unnest(range(frame, nx)) - frame) / (nx - frame) AS ph FROM nxt WHERE nx IS NOT NULL"
_CTE["ov"] = "SELECT fov, frame, sum((value > p75)::INT) / any_value(n)::DOUBLE AS activity FROM tr JOIN p75 USING (roi) JOIN (SELECT fov, count(DISTINCT roi) AS n FROM tr GROUP BY fov HAVING n > 1) USING (fov) GROUP BY fov, frame"
_CTE["onf"] = "SELECT fov, max(frame) + 1 AS n FROM ov GROUP BY fov"
_CTE["oix"] = "SELECT a.fov, a.frame, w, ((a.frame + k) % (2 * n) + 2 * n) % (2 * n) AS m, n FROM ov a JOIN onf USING (fov), ker"
_CTE["osm"] = "SELECT i.fov, i.frame, sum(w * a.activity) AS smooth FROM oix i JOIN ov a ON a.fov = i.fov AND a.frame = CASE WHEN m < n THEN m ELSE 2 * n - 1 - m END GROUP BY ALL"
_CTE["gap"] = "SELECT * FROM (SELECT pk.fov, pk.roi, (t_ms - lag(t_ms) OVER (PARTITION BY pk.roi ORDER BY pk.frame)) / 1000 AS d FROM pk JOIN tr ON pk.roi = tr.roi AND pk.frame = tr.frame) WHERE d IS NOT NULL"
_CTE |= {k: v.format(xcorr=_EXACT["trace_xcorr"], sxcorr=_EXACT["spike_xcorr"]) if k in ("xc", "xs") else v for k, v in (view_sql.CTE | file_sql.CTE).items()}
_BODY["stim_mask"] = view_sql._AREA
_BODY["clustering"] = view_sql._tree("xc")
SQL = {k: _with(v) for k, v in (_BODY | file_sql.BODY).items()} | {f"view_{k}": _with(v) for k, v in view_sql.BODY.items()}
