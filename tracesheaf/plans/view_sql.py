"""The SQL of the views' queries (see plans/view_queries.py), for DuckDB on the same tables."""

from __future__ import annotations

#: Table expressions beside those of plans/oracle.py.
CTE = {
    "va": "SELECT tr.fov, tr.roi, tr.frame, tr.value, n_peaks > 0 AS active, tr.roi % 4 = 0 AS stimulated, p75, CASE WHEN value * 3 > p75 * 3 THEN value * 3 ELSE 0 END AS spike FROM tr JOIN np ON np.roi = tr.roi JOIN p75 ON p75.roi = tr.roi",
    "vcor": "SELECT fov, roi, frame, value - 0.5::DOUBLE * (value * 0.25::DOUBLE) AS value FROM tr",
    "vdff": "SELECT fov, roi, frame, (value - b) / nullif(b, 0) AS value FROM (SELECT *, quantile_cont(value, 0.1) OVER (PARTITION BY fov, roi ORDER BY frame ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS b FROM tr)",
    "vact": "SELECT * FROM va WHERE active",
    "vsp": "SELECT fov, roi, frame, spike AS value, active, stimulated FROM va",
    "vsa": "SELECT * FROM vsp WHERE active",
    "vev": "SELECT fov, roi, frame, value AS amplitude FROM vsa WHERE value > 0",
    "vsec": "SELECT fov, max(n) AS n_frames, avg(s) AS seconds FROM (SELECT fov, roi, count(*) AS n, (max(t_ms) - min(t_ms)) / 1000 AS s FROM tr GROUP BY ALL) GROUP BY fov",
    # Bursts of the records, and those of each condition's part of a field.
    "vkey": "SELECT *, fov || '_c' || (roi % 3) AS fk, 'c' || (roi % 3) AS condition FROM rois",
    "vff": "SELECT fk, any_value(condition) AS condition, max(n) AS n_frames, avg(s) AS seconds FROM (SELECT fk, condition, roi, count(*) AS n, (max(t_ms) - min(t_ms)) / 1000 AS s FROM tr JOIN vkey USING (fov, roi) GROUP BY ALL) GROUP BY fk",
    "vhit": "SELECT fk, frame, roi FROM vev JOIN vkey USING (fov, roi)",
    "vga": "SELECT g.fk, g.frame, count(DISTINCT s.roi) / any_value(k.n)::DOUBLE AS activity FROM (SELECT fk, unnest(range(n_frames)) AS frame FROM vff) g JOIN (SELECT fk, count(DISTINCT roi) AS n FROM vhit GROUP BY fk HAVING n >= 2) k ON g.fk = k.fk LEFT JOIN vhit s ON s.fk = g.fk AND s.frame = g.frame GROUP BY ALL",
    "vgn": "SELECT fk, max(frame) + 1 AS n FROM vga GROUP BY fk",
    "vgi": "SELECT a.fk, a.frame, w, ((a.frame + k) % (2 * n) + 2 * n) % (2 * n) AS m, n FROM vga a JOIN vgn USING (fk), ker",
    "vgs": "SELECT i.fk, i.frame, sum(w * a.activity) AS smooth FROM vgi i JOIN vga a ON a.fk = i.fk AND a.frame = CASE WHEN m < n THEN m ELSE 2 * n - 1 - m END GROUP BY ALL",
    "vgb": "SELECT fk, min(frame) AS s, max(frame) + 1 AS e FROM (SELECT fk, frame, frame - row_number() OVER (PARTITION BY fk ORDER BY frame) AS g FROM vgs WHERE smooth > 0.2) GROUP BY fk, g HAVING count(*) >= 3",
    "vgt": "SELECT vff.fk, condition, coalesce(c, 0) AS count, coalesce(len * dt, 0) AS avg_duration_sec, coalesce(gap * dt, 0) AS avg_interval_sec, coalesce(c / (seconds / 60), 0) AS rate_burst_per_min FROM (SELECT *, seconds / (n_frames - 1) AS dt FROM vff) vff LEFT JOIN (SELECT fk, count(*) AS c, avg(e - s) AS len, avg(gap) AS gap FROM (SELECT *, lead(s) OVER (PARTITION BY fk ORDER BY s) - e AS gap FROM vgb) GROUP BY fk) b ON b.fk = vff.fk",
    "vba": "SELECT g.fov, g.frame, count(DISTINCT s.roi) / any_value(k.n)::DOUBLE AS activity FROM (SELECT fov, unnest(range(n_frames)) AS frame FROM vsec) g JOIN (SELECT fov, count(DISTINCT roi) AS n FROM vev GROUP BY fov HAVING n >= 2) k ON g.fov = k.fov LEFT JOIN vev s ON s.fov = g.fov AND s.frame = g.frame GROUP BY ALL",
    "vbn": "SELECT fov, max(frame) + 1 AS n FROM vba GROUP BY fov",
    "vbi": "SELECT a.fov, a.frame, w, ((a.frame + k) % (2 * n) + 2 * n) % (2 * n) AS m, n FROM vba a JOIN vbn USING (fov), ker",
    "vbs": "SELECT i.fov, i.frame, sum(w * a.activity) AS smooth FROM vbi i JOIN vba a ON a.fov = i.fov AND a.frame = CASE WHEN m < n THEN m ELSE 2 * n - 1 - m END GROUP BY ALL",
    "vbb": "SELECT fov, row_number() OVER (PARTITION BY fov ORDER BY min(frame)) AS burst_id, min(frame) AS start, max(frame) + 1 AS \"end\" FROM (SELECT fov, frame, frame - row_number() OVER (PARTITION BY fov ORDER BY frame) AS g FROM vbs WHERE smooth > 0.2) GROUP BY fov, g HAVING count(*) >= 3",
    "vbt": "SELECT fov, count(*) AS c, avg(\"end\" - start - 1) AS len, avg(gap) AS gap FROM (SELECT *, start - (lag(\"end\") OVER (PARTITION BY fov ORDER BY start) - 1) AS gap FROM vbb) GROUP BY fov",
    "vop": "SELECT fov, roi, quantile_cont(value, 0.75) AS p75 FROM vsa GROUP BY ALL",
    "voa": "SELECT fov, frame, sum((value > p75)::INT) / any_value(n)::DOUBLE AS activity FROM vsa JOIN vop USING (fov, roi) JOIN (SELECT fov, count(DISTINCT roi) AS n FROM vsa GROUP BY fov HAVING n > 1) USING (fov) GROUP BY fov, frame",
    "von": "SELECT fov, max(frame) + 1 AS n FROM voa GROUP BY fov",
    "voi": "SELECT a.fov, a.frame, w, ((a.frame + k) % (2 * n) + 2 * n) % (2 * n) AS m, n FROM voa a JOIN von USING (fov), ker",
    "vos": "SELECT i.fov, i.frame, sum(w * a.activity) AS smooth FROM voi i JOIN voa a ON a.fov = i.fov AND a.frame = CASE WHEN m < n THEN m ELSE 2 * n - 1 - m END GROUP BY ALL",
    # Synchrony of peak trains and of spike trains.
    "vpr": "SELECT a.fov, a.roi AS roi_i, b.roi AS roi_j, a.n AS n_i, b.n AS n_j FROM (SELECT fov, roi, count(*) AS n FROM pk GROUP BY ALL) a JOIN (SELECT fov, roi, count(*) AS n FROM pk GROUP BY ALL) b ON a.fov = b.fov AND a.roi < b.roi",
    "vps": "SELECT vpr.fov, vpr.roi_i, vpr.roi_j, coalesce(h, 0) / (n_i + n_j)::DOUBLE AS value FROM vpr LEFT JOIN (SELECT least(r, o) AS roi_i, greatest(r, o) AS roi_j, count(*) AS h FROM (SELECT DISTINCT a.roi AS r, b.roi AS o, a.frame FROM pk a JOIN pk b ON a.fov = b.fov AND a.roi <> b.roi AND abs(a.frame - b.frame) <= 2) GROUP BY ALL) h ON h.roi_i = vpr.roi_i AND h.roi_j = vpr.roi_j",
    "vsn": "SELECT fov, roi, count(*) AS n FROM vev GROUP BY ALL",
    "vss": "SELECT a.fov, a.roi AS roi_i, b.roi AS roi_j, least(1, coalesce(c, 0) / sqrt(a.n * b.n)) AS value FROM vsn a JOIN vsn b ON a.fov = b.fov AND a.roi < b.roi LEFT JOIN (SELECT roi_i, roi_j, max(c) AS c FROM (SELECT a.roi AS roi_i, b.roi AS roi_j, b.frame - a.frame AS lag, count(*) AS c FROM vev a JOIN vev b ON a.fov = b.fov AND a.roi < b.roi AND abs(a.frame - b.frame) <= 5 GROUP BY ALL) GROUP BY ALL) c ON c.roi_i = a.roi AND c.roi_j = b.roi",
    "vpk": "SELECT fk, pk.roi, frame FROM pk JOIN vkey USING (fov, roi)",
    "vpg": "SELECT * FROM vpk WHERE fk IN (SELECT fk FROM vpk GROUP BY fk HAVING count(DISTINCT roi) > 1)",
    # Correlations of vectors.
    "xc": "{xcorr}",
    "xm": "SELECT fov, roi_i, roi_j, value FROM xc UNION ALL SELECT fov, roi_j, roi_i, value FROM xc",
    "xt": "SELECT xc.*, threshold, value >= threshold AS connected FROM xc JOIN (SELECT fov, quantile_cont(value, 0.9) AS threshold FROM xm GROUP BY fov) USING (fov)",
    "xn": "SELECT fov, n AS nodes, e AS edges, 100.0::DOUBLE * e * 2 / (n * (n - 1)) AS density_pct FROM (SELECT fov, count(DISTINCT roi_i) AS n FROM xm GROUP BY fov) JOIN (SELECT fov, count(*) FILTER (connected) AS e FROM xt GROUP BY fov) USING (fov)",
    "xs": "{sxcorr}",
    "xsm": "SELECT fov, roi_i, roi_j, value FROM xs UNION ALL SELECT fov, roi_j, roi_i, value FROM xs",
    # The stimulated area of each position's projection.
    "gy": "SELECT a.p, a.y, a.x, sum(w * b.value) AS value FROM mpj a, ker JOIN mpj b ON b.p = a.p AND b.x = a.x AND b.y = greatest(0, least(31, a.y + k)) GROUP BY ALL",
    "gx": "SELECT a.p, a.y, a.x, sum(w * b.value) AS value FROM gy a, ker JOIN gy b ON b.p = a.p AND b.y = a.y AND b.x = greatest(0, least(31, a.x + k)) GROUP BY ALL",
    "ot": "SELECT p, lo, (hi - lo) / 256 AS step, least(255, floor((value - lo) / ((hi - lo) / 256))) AS k, count(*) AS n FROM gx JOIN (SELECT p, min(value) AS lo, max(value) AS hi FROM gx GROUP BY p) USING (p) GROUP BY ALL",
    "ov2": "SELECT p, k, lo + (k + 0.5) * step AS mid, sum(n) OVER w AS w, sum(n * (lo + (k + 0.5) * step)) OVER w AS s, sum(n) OVER (PARTITION BY p) AS total, sum(n * (lo + (k + 0.5) * step)) OVER (PARTITION BY p) AS mass FROM ot WINDOW w AS (PARTITION BY p ORDER BY k)",
    "oth": "SELECT p, arg_max(mid, struct_pack(v := w * (total - w) * (s / w - (mass - s) / (total - w)) ** 2, k := -k)) AS cut FROM ov2 WHERE total > w GROUP BY p",
    "dk": "SELECT dy, dx, dy * dy + dx * dx AS r2 FROM (SELECT unnest(range(-5, 6)) AS dy), (SELECT unnest(range(-5, 6)) AS dx)",
    "mo0": "SELECT p, y, x, (value > cut)::INT AS value FROM gx JOIN oth USING (p)",
    **{f"mo{i + 1}": f"SELECT p, y + dy AS y, x + dx AS x, {'max' if grow else 'min'}(value) AS value FROM mo{i}, dk WHERE r2 <= {r * r} AND y + dy BETWEEN 0 AND 31 AND x + dx BETWEEN 0 AND 31 GROUP BY ALL" for i, (r, grow) in enumerate(((2, True), (2, False), (2, False), (5, True), (5, False)))},
    "vfq": "SELECT np.fov, np.roi, CASE WHEN n_peaks > 0 AND s > 0 THEN n_peaks / s END AS f FROM np JOIN (SELECT roi, (max(t_ms) - min(t_ms)) / 1000 AS s FROM tr GROUP BY roi) USING (roi)",
    "vkc": "SELECT fk, fov, condition FROM vkey GROUP BY ALL",
    "vek": "SELECT fk, condition || CASE WHEN roi % 4 = 0 THEN '_evk_stim_' ELSE '_evk_non_stim_' END || power || '%_' || pulse AS condition, roi % 4 = 0 AS stim, amplitude FROM after5 JOIN vkey USING (fov, roi)",
}


def _norm(source: str, extra: str = "") -> str:
    """A normalised trace of ``source`` (fov, roi, frame, value and ``extra`` columns)."""
    return f"SELECT fov, roi, frame, round(value, 6) AS value{extra}, round(CASE WHEN hi = lo THEN 0 ELSE least(1, greatest(0, (value - lo) / (hi - lo))) END, 6) AS norm FROM {source} JOIN (SELECT fov, quantile_cont(value, 0.05) AS lo, max(value) AS hi FROM {source} GROUP BY fov) USING (fov)"


def _peaked(sql: str) -> str:
    return f"SELECT t.*, pk.frame IS NOT NULL AS is_peak FROM ({sql}) t LEFT JOIN pk ON pk.roi = t.roi AND pk.frame = t.frame"


def _scale(source: str, spikes: bool) -> str:
    high = "lo + (hi - lo) * 0.5" if spikes else "CASE WHEN hi * 0.5 > lo THEN hi * 0.5 WHEN hi > lo THEN hi ELSE lo + 0.1 END"
    return f"SELECT fov, roi, frame, round(amplitude, 6) AS amplitude, round(lo, 6) AS vmin, round({high}, 6) AS vmax FROM (SELECT *, min(amplitude) OVER (PARTITION BY fov) AS lo, max(amplitude) OVER (PARTITION BY fov) AS hi FROM {source})"


def _shade(scale: str = "") -> str:
    """Peaks with their region's mean amplitude, its place on the scale, and ``scale`` columns."""
    ends = "SELECT *, min(amplitude) OVER (PARTITION BY fov) AS lo, max(amplitude) OVER (PARTITION BY fov) AS hi, avg(amplitude) OVER (PARTITION BY fov, roi) AS m FROM pk"
    top = f"SELECT *, CASE WHEN hi * 0.5 > lo THEN hi * 0.5 WHEN hi > lo THEN hi ELSE lo + 0.1 END AS top FROM ({ends})"
    return f"SELECT fov, roi, frame, round(amplitude, 6) AS amplitude, round(m, 6) AS mean_amplitude, round(least(1, greatest(0, (m - lo) / (top - lo))), 6) AS shade{scale} FROM ({top})"


def _struck(sql: str) -> str:
    """Rows with the power of the stimulus on their frame."""
    return f"SELECT s.*, stm.power::BIGINT AS stim_power FROM ({sql}) s LEFT JOIN stm ON stm.fov = s.fov AND stm.frame = s.frame"


def _map(edges: str, square: str) -> str:
    """The square matrix with each region's place among the leaves."""
    leaf = f"SELECT * FROM ({_tree(edges)}) WHERE kind = 'leaf'"
    return f"SELECT m.fov, a.step AS row, b.step AS col, roi_i, roi_j, value FROM ({_square(square)}) m JOIN ({leaf}) a ON a.fov = m.fov AND a.roi = roi_i JOIN ({leaf}) b ON b.fov = m.fov AND b.roi = roi_j"


def _global(edges: str) -> str:
    both = f"SELECT fov, roi_i AS r, value FROM {edges} UNION ALL SELECT fov, roi_j, value FROM {edges}"
    return f"SELECT e.fov, roi_i, roi_j, round(value, 6)::DOUBLE AS value, round(g, 6) AS global FROM {edges} e JOIN (SELECT fov, median(m) AS g FROM (SELECT fov, r, avg(value) AS m FROM ({both}) GROUP BY ALL) GROUP BY fov) USING (fov)"


def _square(edges: str) -> str:
    return f"SELECT fov, roi_i, roi_j, round(value, 6) AS value FROM {edges} UNION ALL SELECT DISTINCT fov, roi_i, roi_i, 1.0 FROM {edges}"


def _single_values(rows: str) -> str:
    return f"SELECT condition, round(avg(value), 6) AS mean, round(CASE WHEN count(value) = 1 THEN 0 ELSE stddev_samp(value) / sqrt(count(value)) END, 6) AS sem, count(value) AS n FROM ({rows}) GROUP BY condition"


def _pooled(rows: str, digits: int = 6) -> str:
    """A7 over ``rows`` (condition, mean, sem, n)."""
    whole = f"SELECT *, sum(n) OVER (PARTITION BY condition) AS N_, sum(n * mean) OVER (PARTITION BY condition) / sum(n) OVER (PARTITION BY condition) AS wm FROM ({rows}) WHERE mean IS NOT NULL AND sem IS NOT NULL"
    return f"SELECT condition, round(CASE WHEN any_value(N_) > 1 THEN any_value(wm) ELSE avg(mean) END, {digits}) AS mean, round(CASE WHEN any_value(N_) > 1 THEN sqrt(sum((n - 1) * sem * sem + n * (mean - wm) ** 2) / (any_value(N_) - 1)) / sqrt(any_value(N_)) ELSE avg(sem) END, {digits}) AS sem, any_value(N_)::BIGINT AS n FROM ({whole}) GROUP BY condition"


def _grouped(source: str, value: str, keys: str = "condition, fov") -> str:
    return f"SELECT {keys}, avg({value}) AS mean, CASE WHEN count({value}) = 1 THEN 0 ELSE stddev_samp({value}) / sqrt(count({value})) END AS sem, count({value}) AS n FROM ({source}) GROUP BY ALL"


def _correlation(events: str, rois: str, named: bool = False) -> str:
    """(condition, value, and fov where ``named``) of M3 and A10 on ``events`` (fk, roi, frame) over the pairs of ``rois`` (fk, roi)."""
    pairs = f"SELECT a.fk, a.roi AS roi_i, b.roi AS roi_j, coalesce(x.n, 0) AS n_i, coalesce(y.n, 0) AS n_j, coalesce(c.n, 0) AS n_ij, n_frames::DOUBLE AS t FROM ({rois}) a JOIN ({rois}) b ON a.fk = b.fk AND a.roi < b.roi JOIN vff ON vff.fk = a.fk"
    counts = f"(SELECT roi, count(*) AS n FROM {events} GROUP BY roi)"
    both = f"(SELECT a.roi AS i, b.roi AS j, count(*) AS n FROM {events} a JOIN {events} b ON a.fk = b.fk AND a.frame = b.frame AND a.roi < b.roi GROUP BY ALL)"
    edges = f"SELECT fk, roi_i, roi_j, coalesce(abs(t * n_ij - n_i * n_j) / nullif(sqrt(n_i * (t - n_i) * n_j * (t - n_j)), 0), 0) AS value FROM ({pairs} LEFT JOIN {counts} x ON x.roi = a.roi LEFT JOIN {counts} y ON y.roi = b.roi LEFT JOIN {both} c ON c.i = a.roi AND c.j = b.roi)"
    mirrored = f"SELECT fk, roi_i AS r, value FROM ({edges}) UNION ALL SELECT fk, roi_j, value FROM ({edges})"
    head = "fk AS fov, any_value(condition) AS condition, round(median(m), 6) AS value" if named else "any_value(condition) AS condition, median(m) AS value"
    return f"SELECT {head} FROM (SELECT fk, r, avg(value) AS m FROM ({mirrored}) GROUP BY ALL) JOIN vkc USING (fk) GROUP BY fk"


def _tree(edges: str) -> str:
    """M13 on ``edges`` (fov, roi_i, roi_j, value): merges by complete linkage, then the leaves from left to right."""
    return f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT fov, roi_i, roi_j, round(1 - abs(value), 8) AS d FROM {edges}),
leaf AS (SELECT fov, roi, row_number() OVER (PARTITION BY fov ORDER BY roi) - 1 AS id, count(*) OVER (PARTITION BY fov) AS n FROM (SELECT fov, roi_i AS roi FROM e UNION SELECT fov, roi_j FROM e)),
c AS (
  SELECT e.fov, 0::BIGINT AS step, a.id AS i, b.id AS j, d, a.n, 1::BIGINT AS si, 1::BIGINT AS sj FROM e JOIN leaf a ON a.fov = e.fov AND a.roi = roi_i JOIN leaf b ON b.fov = e.fov AND b.roi = roi_j
  UNION ALL
  SELECT fov, step + 1, least(x, y), greatest(x, y), max(d), n, any_value(CASE WHEN x < y THEN sx ELSE sy END), any_value(CASE WHEN x < y THEN sy ELSE sx END) FROM (
    SELECT fov, step, n, d, CASE WHEN i IN (li, lj) THEN n + step ELSE i END AS x, CASE WHEN j IN (li, lj) THEN n + step ELSE j END AS y,
      CASE WHEN i IN (li, lj) THEN ls ELSE si END AS sx, CASE WHEN j IN (li, lj) THEN ls ELSE sj END AS sy
    FROM (SELECT *, first_value(i) OVER w AS li, first_value(j) OVER w AS lj, first_value(si + sj) OVER w AS ls FROM c WINDOW w AS (PARTITION BY fov ORDER BY d, i, j)) WHERE NOT (i = li AND j = lj))
  GROUP BY fov, step, n, least(x, y), greatest(x, y)),
merged AS MATERIALIZED (SELECT fov, step, n, i AS left_id, j AS right_id, d AS distance, si + sj AS size FROM c QUALIFY row_number() OVER (PARTITION BY fov, step ORDER BY d, i, j) = 1),
path AS (
  SELECT fov, n + step AS id, '' AS way, n FROM merged WHERE step = n - 2
  UNION ALL
  SELECT p.fov, unnest([left_id, right_id]), way || unnest(['0', '1']), p.n FROM path p JOIN merged m ON m.fov = p.fov AND m.n + m.step = p.id)
SELECT p.fov, 'leaf' AS kind, row_number() OVER (PARTITION BY p.fov ORDER BY way) - 1 AS step, roi, NULL::BIGINT AS left_id, NULL::BIGINT AS right_id, NULL::DOUBLE AS distance, NULL::BIGINT AS size
FROM path p JOIN leaf ON leaf.fov = p.fov AND leaf.id = p.id
UNION ALL SELECT fov, 'merge', step, NULL, left_id, right_id, round(distance, 6), size FROM merged"""


_OVERLAY = 'SELECT fov, row_number() OVER (PARTITION BY fov ORDER BY min(frame)) AS burst_id, min(frame) AS start, max(frame) + 1 AS "end" FROM (SELECT fov, frame, frame - row_number() OVER (PARTITION BY fov ORDER BY frame) AS g FROM vos WHERE smooth > 0.2::DOUBLE) GROUP BY fov, g HAVING count(*) >= 3'
_AREA = "SELECT p, y, x FROM mo5 WHERE value = 1"
_TRACE = "SELECT fov, roi, frame, round(value, 6) AS value FROM {}"
_AMPLITUDE = "SELECT fov, roi, round(avg(amplitude), 6) AS mean, round(CASE WHEN count(*) > 1 THEN stddev_samp(amplitude) / sqrt(count(*)) END, 6) AS sem, count(*) AS n FROM pk GROUP BY ALL"
_CLASS = "SELECT p AS fov, label AS roi, lab.y, lab.x, CASE WHEN overlap > 0.1::DOUBLE THEN 'stimulated' ELSE 'non_stimulated' END AS class{} FROM lab JOIN ovl ON ovl.fov = p AND ovl.roi = label{}"
_PANEL = "SELECT fov, stimulated, power_pulse, round(avg(amplitude), 6) AS mean, round(stddev_pop(amplitude) / sqrt(count(*)), 6) AS err, count(*) AS n FROM evk WHERE {} GROUP BY ALL"

BODY = {
    "traces_raw": "SELECT fov, roi, frame, round(value * 2, 6) AS value FROM tr",
    "traces_corrected": _TRACE.format("vcor"),
    "traces_normalized": _norm("vcor"),
    "dff": _TRACE.format("vdff"),
    "dff_normalized": _norm("vdff"),
    "dec_dff": _TRACE.format("tr"),
    "dec_dff_peaks": _peaked(_TRACE.format("vact")),
    "dec_dff_peaks_thresholds": _peaked("SELECT vact.fov, vact.roi, frame, round(noise, 6) AS peaks_height_dec_dff, round(noise, 6) AS peaks_prominence_dec_dff, round(value, 6) AS value FROM vact JOIN nz ON nz.roi = vact.roi"),
    "dec_dff_normalized": _norm("tr"),
    "dec_dff_normalized_active": _norm("vact"),
    "dec_dff_normalized_peaks": _peaked(_norm("vact")),
    "neuropil_masks": "SELECT *, roi = max(roi) OVER (PARTITION BY fov, part, y, x) AS shown FROM (SELECT p AS fov, label AS roi, y, x, 'cell' AS part FROM lab UNION ALL SELECT p, label, y, x, 'ring' FROM rng JOIN (SELECT p, label, min(k) AS need FROM (SELECT p, label, k, sum(count(*)) OVER (PARTITION BY p, label ORDER BY k) AS c FROM rng GROUP BY p, label, k) WHERE c >= 20 GROUP BY ALL) USING (p, label) WHERE k <= need)",
    "neuropil_traces": "SELECT fov, roi, frame, round(value * 2, 6) AS raw_trace, round(value * 0.25::DOUBLE, 6) AS neuropil_trace, round(value - 0.5::DOUBLE * (value * 0.25::DOUBLE), 6) AS corrected_trace FROM tr",
    "spikes_raw": "SELECT fov, roi, frame, round(value * 3, 6) AS value FROM tr",
    "spikes_thresholded": _TRACE.format("vsp"),
    "spikes_raw_threshold": "SELECT fov, roi, frame, round(p75 * 3, 6) AS inferred_spikes_threshold, round(value * 3, 6) AS value FROM va",
    "spikes_normalized": _norm("vsp"),
    "spikes_normalized_active": _norm("vsa"),
    "spikes_normalized_bursts": f"SELECT t.*, burst_id FROM ({_norm('vsa')}) t LEFT JOIN ({_OVERLAY}) b ON b.fov = t.fov AND t.frame >= b.start AND t.frame < b.\"end\"",
    "spikes_with_dec_dff": "SELECT fov, roi, frame, round(spike, 6) AS value, round(value, 6) AS dec_dff FROM va",
    "amplitude": _AMPLITUDE,
    "frequency": "SELECT fov, roi, round(f, 6) AS dec_dff_frequency FROM vfq",
    "amplitude_vs_frequency": f"SELECT a.*, round(f, 6) AS dec_dff_frequency FROM ({_AMPLITUDE}) a JOIN vfq USING (fov, roi)",
    "raster_peaks": "SELECT fov, roi, frame, round(amplitude, 6) AS amplitude FROM pk",
    "raster_peaks_amp": _shade(),
    "raster_peaks_amp_scale": _shade(", round(lo, 6) AS vmin, round(top, 6) AS vmax"),
    "raster_spikes": "SELECT fov, roi, frame, round(amplitude, 6) AS amplitude FROM vev",
    "raster_spikes_amp": _scale("vev", True),
    "raster_spikes_amp_scale": _scale("vev", True),
    "iei": "SELECT fov, roi, round(avg(d), 9) AS iei, round(avg(d) / sqrt(count(d)), 9) AS iei_err FROM gap GROUP BY ALL",
    "cell_size": "SELECT fov, roi, (40 + roi % 7)::DOUBLE AS cell_size, 'µm' AS cell_size_units FROM rois",
    "peak_synchrony": _global("vps"),
    "network": "SELECT xt.fov, roi_i, roi_j, round(abs(value), 6) AS weight, sign(value)::BIGINT AS sign, (roi_i % 32)::DOUBLE AS cy_i, (roi_i % 29)::DOUBLE AS cx_i, (roi_j % 32)::DOUBLE AS cy_j, (roi_j % 29)::DOUBLE AS cx_j, nodes, edges, round(density_pct, 6) AS density_pct FROM xt JOIN xn ON xn.fov = xt.fov WHERE connected",
    "connectivity_matrix": "SELECT c.fov, roi_i, roi_j, round(value, 6) AS value, round(threshold, 6) AS threshold, connected, nodes, edges, round(density_pct, 6) AS density_pct FROM (SELECT * FROM xt UNION ALL SELECT fov, roi_j, roi_i, value, threshold, connected FROM xt) c JOIN xn ON xn.fov = c.fov",
    "trace_xcorr": _square("xm"),
    **{f"{k}_dendrogram": f"SELECT * FROM ({_tree(e)}) WHERE kind = 'merge'" for k, e in (("trace", "xc"), ("spike", "xs"))},
    **{f"{k}_clustering": _map(e, f"{e[0]}{m}") for k, e, m in (("trace", "xc", "m"), ("spike", "xs", "sm"))},
    "stim_area": _AREA,
    "spike_xcorr": _square("xsm"),
    "spike_synchrony": _global("vss"),
    "burst_activity": 'SELECT vbb.fov, burst_id, start, "end", c AS count, round(len * dt, 6) AS avg_duration_sec, round(coalesce(gap * dt, 0), 6) AS avg_interval_sec, round(c / (seconds / 60), 6) AS rate_burst_per_min FROM vbb JOIN vbt USING (fov) JOIN (SELECT *, seconds / (n_frames - 1) AS dt FROM vsec) USING (fov)',
    "stim_rois": _CLASS.format("", ""),
    "stim_rois_area": _CLASS.format(", CASE WHEN spx.y IS NOT NULL THEN true END AS in_area", " LEFT JOIN spx ON spx.y = lab.y AND spx.x = lab.x"),
    "stim_peaks_amp": _PANEL.format("stimulated"),
    "non_stim_peaks_amp": _PANEL.format("NOT stimulated"),
    "stim_vs_non_traces": _struck(_norm("vact", ", stimulated")),
    "stim_vs_non_traces_peaks": _struck(_peaked(_norm("vact", ", stimulated"))),
    "stim_vs_non_spikes": _struck(_norm("vsa", ", stimulated")),
    "mw_cell_size": _pooled(_grouped("SELECT 'c' || (roi % 3) AS condition, fov, (40 + roi % 7)::DOUBLE AS v FROM rois", "v")),
    "mw_amplitude": _pooled("SELECT condition, mean, sem, n FROM gm"),
    "mw_frequency": _pooled(_grouped("SELECT 'c' || (roi % 3) AS condition, fov, f FROM vfq", "f")),
    "mw_iei": _pooled(_grouped("SELECT 'c' || (rois.roi % 3) AS condition, rois.fov, d FROM rois LEFT JOIN gap ON gap.roi = rois.roi", "d"), 9),
    "mw_percentage_active": "SELECT condition, round(100 * p, 6) AS pct, round(CASE WHEN p <= 0 OR p >= 1 THEN 0 ELSE 100 * sqrt(p * (1 - p) / n_) END, 6) AS sem, n_::BIGINT AS n FROM (SELECT condition, sum(pct / 100 * n) / sum(n) AS p, sum(n) AS n_ FROM pa GROUP BY condition)",
    "mw_peak_synchrony": _single_values(_correlation("vpg", "SELECT DISTINCT fk, roi FROM vpg")),
    "mw_spike_synchrony": _single_values(_correlation("vhit", "SELECT fk, roi FROM vkey")),
    **{f"mw_burst_{k}": _single_values(f"SELECT condition, {c} AS value FROM vgt") for k, c in {"count": "count", "duration": "avg_duration_sec", "interval": "avg_interval_sec", "rate": "rate_burst_per_min"}.items()},
    "mw_stim_amplitude": "SELECT regexp_replace(regexp_replace(condition, '_evk_stim', ''), '_[^_]*$', '') AS condition, mean, sem, n FROM (" + _pooled(_grouped("SELECT condition, fk, amplitude FROM vek WHERE stim", "amplitude", "condition, fk")) + ")",
    "mw_non_stim_amplitude": "SELECT regexp_replace(regexp_replace(condition, '_evk_non_stim', ''), '_[^_]*$', '') AS condition, mean, sem, n FROM (" + _pooled(_grouped("SELECT condition, fk, amplitude FROM vek WHERE NOT stim", "amplitude", "condition, fk")) + ")",
}
