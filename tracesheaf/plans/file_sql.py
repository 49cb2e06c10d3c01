"""The SQL of the queries in plans/file_queries.py, for DuckDB on the same tables."""

from __future__ import annotations

from tracesheaf.plans.view_sql import _correlation

_K = "CAST(props ->> '$.k' AS BIGINT)"


def _wide(source: str, conditions: list[str], values: dict[str, str], key: str = "") -> str:
    cols = ", ".join(f"max(CASE WHEN condition = '{c}' THEN {v} END) AS \"{c}{s}\"" for c in conditions for v, s in values.items())
    return f"SELECT {key}{cols} FROM {source}"


_BURSTS = {"count": "_count", "round_even(avg_duration_sec, 4)": "_avg_duration_sec", "round_even(avg_interval_sec, 4)": "_avg_interval_sec", "round_even(rate_burst_per_min, 4)": "_rate_burst_per_min"}
_STEPS = "SELECT pk.fov, pk.roi, s.power, s.pulse, arg_min(pk.amplitude, pk.frame) AS amplitude FROM (SELECT fov, frame, max(power // 40) AS power, pulse FROM stm GROUP BY ALL) s JOIN pk ON pk.fov = s.fov AND pk.frame BETWEEN s.frame AND s.frame + 5 GROUP BY pk.fov, pk.roi, s.frame, s.power, s.pulse"
_EVOKED = f"(SELECT fov, power || '%_100' AS pp, 'c1' || CASE WHEN roi % 4 = 0 THEN '_evk_stim_' ELSE '_evk_non_stim_' END || power || '%_100' AS condition, avg(amplitude) AS mean, CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(amplitude) / sqrt(count(*)) END AS sem, count(*) AS n FROM ({_STEPS}) GROUP BY ALL)"
_POWERS = [f"c1_evk_{t}stim_{p}%_100" for t in ("non_", "") for p in (0, 1, 2)]
_SYNC = {
    "jitter_window": "CASE WHEN n_i > 0 AND n_j > 0 THEN coalesce(h, 0) / (n_i + n_j)::DOUBLE ELSE 0 END AS value FROM pn LEFT JOIN (SELECT least(r, o) AS roi_i, greatest(r, o) AS roi_j, count(*) AS h FROM (SELECT DISTINCT a.roi AS r, b.roi AS o, a.frame FROM spk a JOIN spk b ON a.fov = b.fov AND a.roi <> b.roi AND abs(a.frame - b.frame) <= 2) GROUP BY ALL) USING (roi_i, roi_j)",
    "cross_correlation": "CASE WHEN n_i > 0 AND n_j > 0 THEN least(1, coalesce(c, 0) / sqrt(n_i * n_j)) ELSE 0 END AS value FROM pn LEFT JOIN (SELECT roi_i, roi_j, max(c) AS c FROM (SELECT a.roi AS roi_i, b.roi AS roi_j, b.frame - a.frame AS lag, count(*) AS c FROM spk a JOIN spk b ON a.fov = b.fov AND a.roi < b.roi AND abs(a.frame - b.frame) <= 5 GROUP BY ALL) GROUP BY ALL) USING (roi_i, roi_j)",
}
_TRACES = {"raw_data": "value * 2", "neuropil_corrected_data": "value - 0.5::DOUBLE * (value * 0.25::DOUBLE)", "dff_data": "value * 5", "dec_dff_data": "value", "inferred_spikes_raw_data": "value * 3", "inferred_spikes_thresholded_data": "spike"}
_NAMES = ["B{k}_0000_p{k}.json", "B{k}_x.json", "B{k}_00x0_p1.json", "B{k}_0000_p.json", "B-{k}_0000_p1.json", ".B{k}_0000_p1.json", "genotype_plate_map.json", "plate_plan.json", "settings.json", "B{k}.json", "B{k}_0000_p{k}.csv", "a_b_c_{k}.json"]

_SETTINGS = {
    "dff_window": "n::INTEGER", "decay_constant": "n / 8", "peaks_height_value": "CASE WHEN s_nationkey % 2 = 1 THEN n * 2.5::DOUBLE ELSE 3.0::DOUBLE END", "peaks_height_mode": "CASE WHEN s_nationkey % 2 = 1 THEN 'global_height' ELSE 'multiplier' END",
    "peaks_distance": "2", "peaks_prominence_multiplier": "1.0::DOUBLE", "calcium_sync_jitter_window": "2", "calcium_network_threshold": "90.0::DOUBLE", "spike_threshold_value": "1.0::DOUBLE", "spike_threshold_mode": "'multiplier'",
    "burst_threshold": "30.0::DOUBLE", "burst_min_duration": "3", "burst_gaussian_sigma": "2.0::DOUBLE", "spikes_sync_cross_corr_lag": "5", "neuropil_inner_radius": "0", "neuropil_min_pixels": "0", "neuropil_correction_factor": "0.0::DOUBLE",
    "led_power_equation": "CASE WHEN s_nationkey % 2 = 0 THEN name ELSE '' END",
}

CTE = {
    # The analysis: eroded cells, rings, their traces, correction and baseline.
    "zc": "SELECT a.p, a.label, a.y, a.x FROM lab a JOIN lab b ON b.p = a.p AND b.label = a.label AND abs(b.y - a.y) + abs(b.x - a.x) = 1 GROUP BY ALL HAVING count(*) = 4",
    "zr": "SELECT p, label, y, x FROM rng JOIN (SELECT p, label, min(k) AS need FROM (SELECT p, label, k, sum(count(*)) OVER (PARTITION BY p, label ORDER BY k) AS c FROM rng GROUP BY p, label, k) WHERE c >= 20 GROUP BY ALL) USING (p, label) WHERE k <= need",
    "zt": "SELECT p, label, t, avg(value) AS raw FROM pix JOIN zc USING (p, y, x) GROUP BY ALL",
    "zn": "SELECT p, label, t, avg(value) AS around FROM pix JOIN zr USING (p, y, x) GROUP BY ALL",
    "zk": "SELECT zt.p, zt.label, zt.t, raw, around, raw - 0.5::DOUBLE * coalesce(around, 0) AS corrected FROM zt LEFT JOIN zn ON zn.p = zt.p AND zn.label = zt.label AND zn.t = zt.t",
    "zb": "SELECT *, quantile_cont(corrected, 0.1) OVER (PARTITION BY p, label ORDER BY t ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS b FROM zk",
    "zs": "SELECT zc.p, zc.label, count(s.y) / count(*)::DOUBLE AS overlap FROM zc LEFT JOIN spx s ON s.y = zc.y AND s.x = zc.x GROUP BY ALL",
    "hnb": "SELECT fov, roi, CAST(floor((s + e) / 2) AS BIGINT) AS frame, v AS amplitude FROM nb WHERE v > pv AND v > nv AND v >= 60",
    "hbo": "SELECT c.fov, c.roi, c.frame, c.amplitude, coalesce(max(CASE WHEN t.frame < c.frame AND t.value > c.amplitude THEN t.frame END), -1) AS lb, coalesce(min(CASE WHEN t.frame > c.frame AND t.value > c.amplitude THEN t.frame END), 1000000000) AS rb FROM hnb c JOIN tr t USING (roi) GROUP BY ALL",
}

BODY = {
    "settings_files": "SELECT s_nationkey, " + ", ".join(f"{v} AS {k}" for k, v in _SETTINGS.items()) + " FROM (SELECT s_nationkey, count(*) AS n, min(s_name) AS name FROM supplier GROUP BY s_nationkey)",
    "analysed_records": """
SELECT 'B' || z.p || '_0000_p' || z.p AS fov, z.label AS roi, CASE WHEN z.p % 2 = 0 THEN 'c' || (z.p % 3) || '_t1' ELSE 'c' || (z.p % 3) END AS condition, count(*) AS frames, count(*) AS deconvolved, round(sum(raw), 6) AS raw,
  round(sum(around), 6) AS neuropil, round(sum(corrected), 6) AS corrected, round(coalesce(sum((corrected - b) / nullif(b, 0)), 0), 6) AS dff, round(any_value(n) * 4.0::DOUBLE, 6) AS cell_size, 'µm' AS cell_size_units,
  any_value(seconds) AS total_recording_time_sec, any_value(overlap) > 0.1 AS stimulated, any_value(n) AS pixels, any_value(m) AS ring_pixels, 0.5::DOUBLE AS neuropil_correction_factor, 90.0::DOUBLE AS calcium_network_threshold
FROM zb z JOIN (SELECT p, label, count(*) AS n FROM zc GROUP BY ALL) c ON c.p = z.p AND c.label = z.label LEFT JOIN (SELECT p, label, count(*) AS m FROM zr GROUP BY ALL) r ON r.p = z.p AND r.label = z.label
JOIN (SELECT p, (max(t) - min(t)) / 10 AS seconds FROM pix GROUP BY p) f ON f.p = z.p JOIN zs ON zs.p = z.p AND zs.label = z.label
WHERE n * 4 >= 10 GROUP BY z.p, z.label""",
    "deconvolve_certificate": "SELECT fov, roi, count(*) AS n, true AS feasible, true AS stationary, true AS at_noise FROM tr GROUP BY fov, roi HAVING count(*) >= 4 UNION ALL SELECT fov, roi, count(*), NULL, NULL, NULL FROM tr GROUP BY fov, roi HAVING count(*) < 4",
    "frame_metadata": f"SELECT 'p' || (user_id % 10) AS key, event_id, {_K} AS k, user_id % 10 AS p FROM events",
    "raw_metadata": f"SELECT event_id, {_K} AS k FROM events",
    "stage_positions": "SELECT row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS p, s_name AS name, (s_suppkey % 7)::DOUBLE AS x, (s_suppkey % 5)::DOUBLE AS y, 1.5::DOUBLE AS z FROM supplier",
    "datasets": "SELECT CASE WHEN p < 3 THEN 'a.ome.zarr' ELSE 'b.tensorstore.zarr' END AS dataset, count(*) AS n, round(sum(value), 6) AS total FROM pix WHERE p <= 3 GROUP BY 1",
    "label_file": "SELECT DISTINCT p, y, x FROM lab",
    "trace_files": " UNION ALL ".join(f"SELECT '{k}' AS kind, fov, roi, frame, round({v}, 6) AS value FROM va" for k, v in _TRACES.items()),
    "grouped_file": "SELECT fov, condition, round_even(mean, 5) AS mean, round_even(sem, 5) AS sem, n FROM gm WHERE mean IS NOT NULL",
    "burst_file": _wide("(SELECT *, row_number() OVER (PARTITION BY condition ORDER BY fk) AS row FROM vgt)", ["c0", "c1", "c2"], _BURSTS, "row, ") + " GROUP BY row",
    "evoked_file": _wide(_EVOKED, _POWERS, {"round(mean, 6)": "_Mean", "round(sem, 6)": "_SEM", "n": "_N"}, "fov || '_' || pp AS \"FOV\", ") + " GROUP BY fov, pp",
    "plate_records": "SELECT s_name AS well, s_suppkey % 8 AS row, s_suppkey % 12 AS col, 'c' || (s_suppkey % 3) AS condition, 'coral' AS color FROM supplier",
    "legacy_names": "SELECT s_name AS pos_name, s_suppkey AS p, CASE WHEN kind = 'full' THEN s_name || '_p' || s_suppkey ELSE s_name END AS fov, kind, short_first FROM (SELECT *, CASE WHEN s_suppkey % 3 <> 0 AND (NOT short_first OR s_suppkey % 2 <> 0) THEN 'full' WHEN s_suppkey % 2 = 0 THEN 'short' END AS kind FROM supplier, (VALUES (true), (false)) t(short_first)) WHERE kind IS NOT NULL",
    "result_file_names": "SELECT replace(CASE s_suppkey % 12 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES)) + " END, '{k}', s_suppkey::VARCHAR) AS name, s_suppkey % 12 IN (0, 1) AS is_result FROM supplier",
    "chosen_positions": "SELECT DISTINCT 'd' AS dataset, p, how FROM pix, (VALUES ('labels'), ('listed')) t(how) WHERE CASE WHEN how = 'labels' THEN p < 6 ELSE p IN (2, 7) END",
    "fields_of_well": "SELECT fov, plan FROM (SELECT 'B' || s_nationkey || '_0000_p' || s_suppkey AS fov FROM supplier), (VALUES (true), (false)) t(plan) WHERE NOT plan OR contains(fov, 'B1')",
    "stimulation_groups": "SELECT fov, roi, CASE WHEN roi % 3 > 0 THEN roi % 4 = 0 END AS stimulated, roi % 3 > 0 AND roi % 4 = 0 AS shown_as FROM rois",
    "chosen_conditions": "SELECT fov, roi, 'c' || (roi % 3) AS condition FROM rois WHERE roi % 3 IN (0, 2)",
    "spikes_above": "SELECT fov, tr.roi, frame, round(value, 6) AS amplitude FROM tr JOIN (SELECT roi, CASE WHEN count(*) > 5 THEN quantile_cont(value, 0.05) ELSE 0.01::DOUBLE END AS t FROM tr WHERE value > 0 GROUP BY roi) s ON s.roi = tr.roi WHERE value > t",
    "interval_rows": "SELECT fov, roi, frame, t_ms - lag(t_ms) OVER (PARTITION BY roi ORDER BY t_ms, frame) AS gap_ms FROM tr",
    "first_peak_after": "SELECT rois.fov, rois.roi, min(pk.frame) AS frame FROM rois LEFT JOIN pk ON pk.roi = rois.roi AND pk.frame BETWEEN 10 AND 15 GROUP BY ALL",
    "time_axis": "SELECT fov, roi, frame, round(frame * floor(seconds) / n_frames, 6) AS s FROM tr JOIN vsec USING (fov)",
    "power_names": f"SELECT event_id, {_K}::DOUBLE AS power, '100' AS pulse FROM events",
    "synchrony_methods": " UNION ALL ".join(f"SELECT pn.fov, roi_i, roi_j, round({v.replace(' AS value', ', 6)::DOUBLE AS value', 1)}".replace(" FROM pn", f", '{k}' AS method FROM pn", 1) for k, v in _SYNC.items()) + " UNION ALL SELECT fov, roi_i, roi_j, round(value, 6), 'correlation' FROM ps",
    "grouped_peak_synchrony": _correlation("vpg", "SELECT DISTINCT fk, roi FROM vpg", True),
    "grouped_spike_synchrony": _correlation("vhit", "SELECT fk, roi FROM vkey", True),
    "grouped_evoked": "SELECT 'c' || c || CASE WHEN stimulated THEN '_evk_stim_' ELSE '_evk_non_stim_' END || power_pulse AS condition, fov, round(avg(amplitude), 9) AS mean, round(CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(amplitude) / sqrt(count(*)) END, 9) AS sem, count(*) AS n FROM evk JOIN (SELECT fov, min(roi % 3) AS c FROM rois GROUP BY fov) USING (fov) GROUP BY ALL",
    "random_choice": "SELECT fov, least(3, count(*)) AS n, least(3, count(*)) AS rois, true AS active FROM rois WHERE roi % 5 > 0 GROUP BY fov",
    "global_heights": "SELECT b.fov, b.roi, b.frame, round(b.amplitude, 6) AS amplitude FROM hbo b JOIN tr t USING (roi) JOIN nz ON nz.roi = b.roi GROUP BY b.fov, b.roi, b.frame, b.amplitude, nz.noise, b.lb, b.rb HAVING b.amplitude - greatest(min(CASE WHEN t.frame > b.lb AND t.frame <= b.frame THEN t.value END), min(CASE WHEN t.frame >= b.frame AND t.frame < b.rb THEN t.value END)) >= nz.noise",
}
