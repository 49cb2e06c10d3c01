"""Named result sets. A single-field view is a function of records (see plans/analysis.py), a grouped one of rows (condition, fov, ...)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import partial, reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesheaf.config import Settings
from tracesheaf.functions.exprs import display_condition, threshold_spikes
from tracesheaf.operators import bursts, cluster, events, evoked, grouped, pairs, pixels, select, stats, traces
from tracesheaf.sources.scratch import saved

View = Callable[..., DataFrame]
PEAKS, AMPS, SPIKES = "peaks_dec_dff", "peaks_amplitudes_dec_dff", "inferred_spikes"


def _trace(r: DataFrame, s: Settings, column: str, norm: bool = False, active: bool = False, peaks: bool = False, extra: tuple[str, ...] = (), power: str | None = None) -> DataFrame:
    """Traces as rows; ``power``: a column of powers by frame, of which a row keeps its own frame's as ``stim_power``."""
    r = r.where(F.col(column).isNotNull())
    if active:
        r = r.where("active")
    out = r.select("fov", "roi", *extra, *([power] if power else []), F.posexplode(column).alias("frame", "value"))
    if power:
        out = out.withColumn("stim_power", F.try_element_at(power, F.col("frame").cast("string"))).drop(power)
    if norm:
        out = traces.normalise(out)
    if peaks:
        p = r.select("fov", "roi", F.explode(PEAKS).alias("frame"), F.lit(True).alias("is_peak"))
        out = out.join(p, ["fov", "roi", "frame"], "left").fillna(False, ["is_peak"])
    return out


def _spike_trace(r: DataFrame, s: Settings, raw: bool = False, **how) -> DataFrame:
    return _trace(r.withColumn(SPIKES, threshold_spikes(F.col(SPIKES), F.col("inferred_spikes_threshold"), raw)), s, SPIKES, **how)


def _raster(r: DataFrame, s: Settings, spikes: bool = False, scale: bool = False) -> DataFrame:
    e = grouped.spike_events(r) if spikes else grouped.peak_events(r)
    return events.color_scale(e, spikes=spikes) if scale else e


def _shaded(r: DataFrame, s: Settings, scale: bool = False) -> DataFrame:
    """Peaks with the mean amplitude of their region and its shade, and the ends of the scale where it is shown."""
    rows = events.region_shade(_raster(r, s, scale=True))
    return rows if scale else rows.drop("vmin", "vmax")


def _with_spikes(r: DataFrame, s: Settings) -> DataFrame:
    both = F.arrays_zip(threshold_spikes(F.col(SPIKES), F.col("inferred_spikes_threshold")).alias("value"), F.col("dec_dff").alias("dec_dff"))
    return r.where(F.col(SPIKES).isNotNull()).select("fov", "roi", F.posexplode(both).alias("frame", "v")).select("fov", "roi", "frame", "v.*")


def _sync(r: DataFrame, s: Settings, spikes: bool) -> DataFrame:
    e = grouped.spike_events(r) if spikes else grouped.peak_trains(r)
    method = "cross_correlation" if spikes else "jitter_window"
    trains = saved(pairs._trains(e, e), "trains")
    how = (method, e, e, grouped.frame_counts(r), s.calcium_sync_jitter_window, s.spikes_sync_cross_corr_lag)
    whole = pairs.global_synchrony(pairs.synchrony(*how, give="regions", trains=trains)).withColumnRenamed("value", "global")
    return pairs.synchrony(*how, trains=trains).join(F.broadcast(whole), "fov")


def _trains(r: DataFrame, spikes: bool = False) -> DataFrame:
    """(fov, roi, trace) of the active regions that are correlated."""
    thr = threshold_spikes(F.col(SPIKES), F.col("inferred_spikes_threshold"))
    return r.where("active").select("fov", "roi", (F.transform(thr, lambda v: (v > 0).cast("double")) if spikes else F.col("dec_dff")).alias("trace"))


def _square(r: DataFrame, s: Settings, spikes: bool = False) -> DataFrame:
    return pairs.trace_square(_trains(r, spikes), absolute=spikes)


def _tree(r: DataFrame, s: Settings, spikes: bool = False) -> DataFrame:
    return cluster.tree(_trains(r, spikes), absolute=spikes)


def _merges(r: DataFrame, s: Settings, spikes: bool = False) -> DataFrame:
    return _tree(r, s, spikes).where("kind = 'merge'")


def _map(r: DataFrame, s: Settings, spikes: bool = False) -> DataFrame:
    """The square of correlations in the order of the tree's leaves."""
    places = saved(_tree(r, s, spikes).where("kind = 'leaf'").select("fov", "roi", F.col("step").alias("place")), "places")
    return pairs.trace_square(_trains(r, spikes), absolute=spikes, places=places)


def _links(r: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """Each field's threshold (fov, threshold), and its statistics."""
    found = pairs.links(_trains(r), s.calcium_network_threshold)
    counts = found.select("fov", F.lit(True).alias("connected"), F.col("edges").alias("pairs"))
    return F.broadcast(found.select("fov", "threshold")), F.broadcast(pairs.network_statistics(counts, pairs.correlated_regions(_trains(r))))


def _connectivity(r: DataFrame, s: Settings) -> DataFrame:
    thr, stat = _links(r, s)
    square = _square(r, s).where("roi_i <> roi_j").join(thr, "fov")
    return square.withColumn("connected", F.col("value") >= F.col("threshold")).join(stat, "fov")


def _network(r: DataFrame, s: Settings) -> DataFrame:
    """Linked pairs with weight, sign, the centroids of both regions (null without masks) and the field's statistics."""
    middle = lambda c: F.try_divide(F.aggregate(f"mask_coord_and_shape.{c}", F.lit(0.0), lambda a, v: a + v), F.size(f"mask_coord_and_shape.{c}"))
    places = [middle(c) if "mask_coord_and_shape" in r.columns else F.lit(None).cast("double") for c in ("ys", "xs")]
    thr, stat = _links(r, s)
    linked = pairs.trace_correlation(_trains(r), least=thr).withColumn("connected", F.lit(True))
    return pairs.network_edges(linked, r.select("fov", "roi", places[0].alias("cy"), places[1].alias("cx"))).join(stat, "fov")


def _bursts(r: DataFrame, s: Settings) -> DataFrame:
    frames = grouped.frame_counts(r)
    b = bursts.bursts(grouped.spike_events(r), frames, s.burst_threshold, s.burst_min_duration, s.burst_gaussian_sigma)
    return b.join(bursts.burst_statistics(b, frames, panel=True), "fov")


def _overlay(r: DataFrame, s: Settings) -> DataFrame:
    """Normalised spikes of active regions, each frame with the burst that it lies in."""
    active = r.where("active")
    found = bursts.burst_overlay(_spike_trace(active, s), s.burst_threshold, s.burst_min_duration, s.burst_gaussian_sigma)
    frames = found.select("fov", "burst_id", F.explode(F.sequence("start", F.col("end") - 1)).alias("frame"))
    return _spike_trace(active, s, norm=True).join(frames, ["fov", "frame"], "left")


def _amplitude(r: DataFrame, s: Settings) -> DataFrame:
    return stats.amplitude_rows(grouped.peak_events(r))


def _columns(r: DataFrame, s: Settings, *names: str) -> DataFrame:
    return r.select("fov", "roi", *names)


def _iei(r: DataFrame, s: Settings) -> DataFrame:
    return stats.interval_summary(r.select("fov", "roi", F.explode("iei").alias("iei")))


def _stim_trace(r: DataFrame, s: Settings, spikes: bool = False, peaks: bool = False) -> DataFrame:
    """Normalised traces, stimulated regions last, and on the frames of stimuli their power."""
    stimuli = "stimulations_frames_and_powers"
    how = {"norm": True, "active": True, "extra": ("stimulated",), "power": stimuli if stimuli in r.columns else None}
    rows = _spike_trace(r, s, **how) if spikes else _trace(r, s, "dec_dff", peaks=peaks, **how)
    power = F.col("stim_power") if how["power"] else F.lit(None).cast("int")
    return select.stimulated_last(rows.select(*[c for c in rows.columns if c != "stim_power"], power.alias("stim_power")))


def _evoked(r: DataFrame, s: Settings, stim: bool) -> DataFrame:
    e = evoked.evoked_amplitudes(grouped.stimuli(r), grouped.peak_events(r), r, s.led_power_equation)
    return evoked.by_power(evoked.panel(select.by_stimulation(e, stim)))


def _masks(r: DataFrame, s: Settings) -> DataFrame:
    """Pixels of cells and rings; of several regions on a pixel of one kind the one with the largest number is shown."""
    r = select.with_neuropil(r, masks=True)
    parts = {"cell": "mask_coord_and_shape", "ring": "neuropil_mask_coord_and_shape"}
    each = [pixels.from_masks(r.select("fov", "roi", F.col(c).alias("mask"))).withColumn("part", F.lit(k)) for k, c in parts.items()]
    rows = each[0].unionByName(each[1])
    top = pixels.composite(rows.withColumn("label", F.col("roi")), keys=["fov", "part"]).withColumnRenamed("label", "top")
    return rows.join(top, ["fov", "part", "y", "x"]).withColumn("shown", F.col("roi") == F.col("top")).drop("top")


def _neuropil(r: DataFrame, s: Settings) -> DataFrame:
    r = select.with_neuropil(r)
    z = F.posexplode(F.arrays_zip("raw_trace", "neuropil_trace", "corrected_trace")).alias("frame", "v")
    return r.select("fov", "roi", z).select("fov", "roi", "frame", "v.*")


def _classes(labels: DataFrame, s: Settings, flags: DataFrame, area: DataFrame | None = None) -> DataFrame:
    out = evoked.label_class(labels, flags)
    return out if area is None else out.join(area.withColumn("in_area", F.lit(True)), ["y", "x"], "left")


def _area(image: DataFrame, s: Settings, height: int, width: int, keys: list[str] = []) -> DataFrame:
    return pixels.stimulation_mask(image, height, width, keys=keys)


t = partial
#: Views of one or more fields; those of images take labels or an image in place of records.
SINGLE: dict[str, View] = {
    "traces_raw": t(_trace, column=select.trace_of(raw=True)),
    "traces_corrected": t(_trace, column=select.trace_of()),
    "traces_normalized": t(_trace, column="corrected_trace", norm=True),
    "dff": t(_trace, column=select.trace_of(dff=True)),
    "dff_normalized": t(_trace, column="dff", norm=True),
    "dec_dff": t(_trace, column=select.trace_of(dec=True)),
    "dec_dff_peaks": t(_trace, column="dec_dff", active=True, peaks=True),
    "dec_dff_peaks_thresholds": t(_trace, column="dec_dff", active=True, peaks=True, extra=("peaks_height_dec_dff", "peaks_prominence_dec_dff")),
    "dec_dff_normalized": t(_trace, column="dec_dff", norm=True),
    "dec_dff_normalized_active": t(_trace, column="dec_dff", norm=True, active=True),
    "dec_dff_normalized_peaks": t(_trace, column="dec_dff", norm=True, active=True, peaks=True),
    "neuropil_masks": _masks,
    "neuropil_traces": _neuropil,
    "spikes_raw": t(_spike_trace, raw=True),
    "spikes_thresholded": _spike_trace,
    "spikes_raw_threshold": t(_spike_trace, raw=True, extra=("inferred_spikes_threshold",)),
    "spikes_normalized": t(_spike_trace, norm=True),
    "spikes_normalized_active": t(_spike_trace, norm=True, active=True),
    "spikes_normalized_bursts": _overlay,
    "spikes_with_dec_dff": _with_spikes,
    "amplitude": _amplitude,
    "frequency": lambda r, s: _columns(r, s, "dec_dff_frequency"),
    "amplitude_vs_frequency": lambda r, s: _amplitude(r, s).join(_columns(r, s, "dec_dff_frequency"), ["fov", "roi"]),
    "raster_peaks": _raster,
    "raster_peaks_amp": _shaded,
    "raster_peaks_amp_scale": t(_shaded, scale=True),
    "raster_spikes": t(_raster, spikes=True),
    "raster_spikes_amp": t(_raster, spikes=True, scale=True),
    "raster_spikes_amp_scale": t(_raster, spikes=True, scale=True),
    "iei": _iei,
    "cell_size": lambda r, s: _columns(r, s, "cell_size", "cell_size_units"),
    "peak_synchrony": t(_sync, spikes=False),
    "network": _network,
    "connectivity_matrix": _connectivity,
    "trace_xcorr": _square,
    "trace_clustering": _map,
    "trace_dendrogram": _merges,
    "spike_synchrony": t(_sync, spikes=True),
    "spike_xcorr": t(_square, spikes=True),
    "spike_clustering": t(_map, spikes=True),
    "spike_dendrogram": t(_merges, spikes=True),
    "burst_activity": _bursts,
    "stim_area": _area,
    "stim_rois": _classes,
    "stim_rois_area": _classes,
    "stim_peaks_amp": t(_evoked, stim=True),
    "non_stim_peaks_amp": t(_evoked, stim=False),
    "stim_vs_non_traces": _stim_trace,
    "stim_vs_non_traces_peaks": t(_stim_trace, peaks=True),
    "stim_vs_non_spikes": t(_stim_trace, spikes=True),
}


def _grouped(rows: DataFrame, how: Callable, conditions: list[str] | None = None, column: str | None = None) -> DataFrame:
    rows = select.with_conditions(rows.withColumn("condition", display_condition(F.col("condition"))), conditions)
    return how(rows.withColumn("value", F.col(column)) if column else rows)


_POOLED = ["cell_size", "amplitude", "frequency", "iei", "stim_amplitude", "non_stim_amplitude"]
_BURST = {"burst_count": "count", "burst_duration": "avg_duration_sec", "burst_interval": "avg_interval_sec", "burst_rate": "rate_burst_per_min"}
#: Views over conditions, of grouped rows.
GROUPED: dict[str, View] = (
    {f"mw_{k}": t(_grouped, how=stats.pooled) for k in _POOLED}
    | {"mw_percentage_active": t(_grouped, how=stats.binomial)}
    | {f"mw_{k}": t(_grouped, how=stats.single_values) for k in ("peak_synchrony", "spike_synchrony")}
    | {f"mw_{k}": t(_grouped, how=stats.single_values, column=c) for k, c in _BURST.items()}
)


_BURST_FIELDS = {f"spikes_burst_{k}": f"burst_{k}" for k in ("threshold", "min_duration", "gaussian_sigma")}
_NETWORK, _EQUATION = ({k: k} for k in ("calcium_network_threshold", "led_power_equation"))
#: Views that read settings, with the records' fields that hold these and the settings' names.
_OWN: dict[str, dict[str, str]] = {
    "peak_synchrony": {"calcium_sync_jitter_window": "calcium_sync_jitter_window"},
    "spike_synchrony": {"spikes_sync_cross_corr_lag": "spikes_sync_cross_corr_lag"},
    "network": _NETWORK, "connectivity_matrix": _NETWORK,
    "burst_activity": _BURST_FIELDS, "spikes_normalized_bursts": _BURST_FIELDS,
    "stim_peaks_amp": _EQUATION, "non_stim_peaks_amp": _EQUATION,
}


def by_settings(name: str, records: DataFrame, settings: Settings) -> list[tuple[DataFrame, Settings]]:
    """``records`` parted by what their fields' first regions hold for the settings that view ``name`` reads; null leaves the caller's.

    What reaches the driver is each different set of parameters once, however many fields share it.
    """
    names = {c: k for c, k in _OWN.get(name, {}).items() if c in records.columns}
    if not names:
        return [(records, settings)]
    first = select.first_setting(records, list(names)).withColumnRenamed("fov", "__own_fov")
    parts = first.select(*names).distinct().orderBy(*names).collect()
    out = []
    for held in parts:
        own = replace(settings, **{k: held[c] for c, k in names.items() if held[c] is not None})
        if len(parts) == 1:
            return [(records, own)]
        same = reduce(and_, [F.col(c).eqNullSafe(F.lit(held[c])) for c in names])
        out.append((records.join(first.where(same).select("__own_fov"), F.col("fov").eqNullSafe(F.col("__own_fov")), "left_semi"), own))
    return out or [(records, settings)]


def view(name: str, data: DataFrame, settings: Settings = Settings(), fov: str | None = None, rois: list[int] | str | None = None, **more) -> DataFrame:
    """A view by name. ``fov`` and ``rois`` narrow the records first; each field's parameters are its own where its records hold them."""
    if name in GROUPED:
        return GROUPED[name](data, **more)
    if name not in SINGLE:
        raise ValueError(f"no view {name}")
    if fov is not None:
        data = data.where(F.col("fov") == fov)
    parts = [SINGLE[name](select.select_rois(d, rois) if rois is not None else d, s, **more) for d, s in by_settings(name, data, settings)]
    out = reduce(DataFrame.unionByName, parts)
    return evoked.by_power(out) if len(parts) > 1 and _OWN[name] is _EQUATION else out
