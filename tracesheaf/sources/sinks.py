"""Sinks: result JSON, wide CSV tables, plate maps, pixel tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracesheaf.config import Settings
from tracesheaf.functions.exprs import condition_tag, numeric_intensity, threshold_spikes
from tracesheaf.operators import grouped, stats


def _mask_parts(mask: str) -> Column:
    """A mask struct (ys, xs, h, w) as its two JSON parts."""
    yx, hw = F.array(F.col(f"{mask}.ys"), F.col(f"{mask}.xs")), F.array(F.col(f"{mask}.h"), F.col(f"{mask}.w"))
    return F.when(F.col(mask).isNotNull(), F.array(F.to_json(yx), F.to_json(hw)))


def region_json(records: DataFrame) -> DataFrame:
    """K1: (fov, roi, value), each region as ``"<roi>":{...}``; masks as ``[[ys], [xs]], [h, w]``."""
    structs = [f.name for f in records.schema if f.name.endswith("mask_coord_and_shape") and f.dataType.typeName() == "struct"]
    fields = [_mask_parts(c).alias(c) if c in structs else F.col(c) for c in records.columns if c not in ("fov", "roi")]
    value = F.concat(F.lit('"'), F.col("roi").cast("string"), F.lit('":'), F.to_json(F.struct(*fields)))
    bare = F.regexp_replace(value, r'"(\[[\[\]0-9,]*\])"', "$1")  # mask parts as arrays, not as texts
    return records.select("fov", "roi", (bare if structs else value).alias("value"))


def result_json(records: DataFrame) -> DataFrame:
    """K1: (fov, value), the field's regions as one JSON object keyed by region; for fields whose text fits a row, others are for ``write_results``."""
    text = F.array_join(F.array_sort(F.collect_list(F.struct("roi", "value")))["value"], ",")
    return region_json(records).groupBy("fov").agg(F.concat(F.lit("{"), text, F.lit("}")).alias("value"))


def write_results(records: DataFrame, path: str) -> None:
    """K1: one text file of JSON in a folder for each field, which ``read_results`` reads back.

    A file is written line by line, a region a line, so a field may be of any length; a region's record is one row.
    """
    each = region_json(records)
    comma = F.when(F.row_number().over(Window.partitionBy("fov").orderBy("roi")) > 1, F.lit(",")).otherwise(F.lit(""))
    rows = each.select("fov", F.lit(1).alias("at"), F.col("roi").cast("long").alias("roi"), F.concat(comma, "value").alias("value"))
    ends = each.select("fov").distinct().select("fov", F.explode(F.array(*[F.struct(F.lit(k).alias("at"), F.lit(0).cast("long").alias("roi"), F.lit(v).alias("value")) for k, v in ((0, "{"), (2, "}"))])).alias("e")).select("fov", "e.*")
    lines = rows.unionByName(ends).repartition("fov").sortWithinPartitions("fov", "at", "roi")
    lines.select("fov", "value").write.partitionBy("fov").option("maxRecordsPerFile", 0).text(path)


def wide_traces(records: DataFrame, trace: str) -> DataFrame:
    """K2 to K6 as a table: rows ``<fov>_<roi>`` with columns t0.., blanks after shorter traces; null traces are left out. For files see ``write_traces``."""
    rows = records.where(F.col(trace).isNotNull())
    n = rows.agg(F.max(F.size(trace))).first()[0] or 0
    return rows.select(F.concat_ws("_", "fov", "roi").alias("key"), *[F.get(trace, F.lit(i)).alias(f"t{i}") for i in range(n)])


def csv_cell(value: Column) -> Column:
    """A text as a CSV cell: in quotes, its own doubled, where it holds a comma, a quote or a line break."""
    return F.when(F.rlike(value, F.lit(r'[",\r\n]')), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def trace_lines(records: DataFrame, trace: str) -> DataFrame:
    """K2 to K6 as lines of text (``value``): ``<fov>_<roi>,<frame 0>,...``, blank cells for nulls and after shorter traces; null traces are left out.

    Every partition begins with the header ``key,t0,...``. A line is one text made of one array, so the number of frames costs no columns.
    """
    rows = records.where(F.col(trace).isNotNull())
    n = rows.agg(F.max(F.size(trace))).first()[0] or 0
    at = F.sequence(F.lit(0), F.lit(n - 1)) if n else F.array().cast("array<int>")
    cells = F.transform(at, lambda i: F.coalesce(F.get(F.col(trace), i).cast("string"), F.lit("")))
    line = F.concat_ws(",", csv_cell(F.concat_ws("_", "fov", "roi")), F.when(F.size(at) > 0, F.array_join(cells, ",")))
    header = F.concat_ws(",", F.lit("key"), F.when(F.size(at) > 0, F.array_join(F.transform(at, lambda i: F.concat(F.lit("t"), i)), ",")))
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # the lower bits number a partition's rows
    return rows.select(line.alias("value"), first.alias("first")).select(F.explode(F.when(F.col("first"), F.array(header, "value")).otherwise(F.array("value"))).alias("value"))


def write_traces(records: DataFrame, trace: str, path: str) -> None:
    """K2 to K6: a folder of CSV files of ``trace_lines``, each with its header, which ``read_trace_csv`` reads back."""
    trace_lines(records, trace).write.mode("overwrite").option("maxRecordsPerFile", 0).text(path)


def thresholded(records: DataFrame, spikes: str = "inferred_spikes", threshold: str = "inferred_spikes_threshold") -> DataFrame:
    """K6: records with spikes at or under the threshold set to 0; rows without spikes or threshold get null and are left out by K2."""
    return records.withColumn(spikes, threshold_spikes(F.col(spikes), F.col(threshold)))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def evoked_table(rows: DataFrame) -> DataFrame:
    """A row ``<fov>_<power>_<pulse>`` for each field and intensity, columns by condition tag and intensity, from rows (condition, fov, power_pulse, mean, sem, n)."""
    keyed = rows.withColumn("key", F.concat_ws("_", "fov", "power_pulse"))
    names = keyed.select("condition", condition_tag(F.col("condition")).alias("tag"), numeric_intensity(F.col("condition"), -2).alias("i")).distinct()
    stats.column_keys(rows, "condition")
    order = [r["condition"] for r in names.orderBy("tag", "i", "condition").collect()]
    columns = [F.max(F.when(F.col("condition") == c, F.col(v))).alias(f"{c}{s}") for c in order for v, s in (("mean", "_Mean"), ("sem", "_SEM"), ("n", "_N"))]
    out = keyed.groupBy("key", F.col("fov").alias("__f"), F.col("power_pulse").alias("__p")).agg(*columns)
    return out.orderBy("__f", numeric_intensity(F.col("__p"), 0)).drop("__f", "__p").withColumnRenamed("key", "FOV")


def percentage_table(rows: DataFrame) -> DataFrame:
    """K8: ``<condition>_%`` and ``<condition>_n`` columns, padded."""
    return stats.ragged(rows, {"pct": "_%", "n": "_n"})


def value_table(rows: DataFrame) -> DataFrame:
    """K9: a column of values for each condition, padded, 4 decimals."""
    return stats.ragged(rows.withColumn("value", F.bround("value", 4)), {"value": ""})


def burst_table(rows: DataFrame) -> DataFrame:
    """Four columns for each condition, padded."""
    names = ["count", "avg_duration_sec", "avg_interval_sec", "rate_burst_per_min"]
    return stats.ragged(rows.withColumns({c: F.bround(c, 4) for c in names[1:]}), {c: f"_{c}" for c in names})


def plate_map_json(plate_map: DataFrame, keys: list[str] = []) -> DataFrame:
    """For each plate (``keys``) one JSON text ``[[well, [row, col], [condition, color]], ...]``; element types differ, so parts are written as JSON each."""
    pair = lambda a, b: F.to_json(F.array(a, b))
    entry = F.concat(F.regexp_replace(F.to_json(F.array("well")), r"\]$", ","), pair(F.col("row"), F.col("col")), F.lit(","), pair(F.col("condition"), F.col("color")), F.lit("]"))
    return plate_map.groupBy(*keys).agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(entry)), ","), F.lit("]")).alias("value"))


def export_positions(pixels: DataFrame, frame_meta: DataFrame, positions: list[int], path: str) -> None:
    """Chosen positions as Parquet by position, and their metadata as JSON beside them."""
    pixels.where(F.col("p").isin(positions)).write.mode("overwrite").partitionBy("p").parquet(f"{path}/pixels")
    frame_meta.where(F.col("p").isin(positions)).write.mode("overwrite").json(f"{path}/meta")


def write_labels(labels: DataFrame, path: str) -> None:
    """A label or mask table."""
    labels.write.mode("overwrite").parquet(path)


def export_each(steps: dict[str, Callable[[str], None]], path: str) -> dict[str, str]:
    """Runs every step on its own folder; one that fails does not stop the others and is reported by name."""
    failed = {}
    for name, write in steps.items():
        try:
            write(f"{path}/{name}")
        except Exception as e:  # noqa: BLE001  isolation of steps is the feature
            failed[name] = str(e).splitlines()[0] if str(e) else type(e).__name__
    return failed


#: Folder and parameter names of exported tables.
TRACES = {"raw_data": "raw_trace", "neuropil_corrected_data": "corrected_trace", "dff_data": "dff", "dec_dff_data": "dec_dff", "inferred_spikes_raw_data": "inferred_spikes"}
GROUPED = {"calcium_peaks_amplitude": "peaks_amplitudes_dec_dff", "calcium_peaks_frequency": "dec_dff_frequency", "calcium_peaks_iei": "iei", "cell_size": "cell_size"}
# End of fixed values.


def export_traces(records: DataFrame, path: str) -> dict[str, str]:
    """All trace tables of K2 to K6."""
    steps = {name: (lambda to, c=column: write_traces(records, c, to)) for name, column in TRACES.items() if column in records.columns}
    if "inferred_spikes_threshold" in records.columns:
        steps["inferred_spikes_thresholded_data"] = lambda to: write_traces(thresholded(records), "inferred_spikes", to)
    return export_each(steps, path)


def export_grouped(records: DataFrame, path: str, settings: Settings = Settings()) -> dict[str, str]:
    """Every grouped table of records that carry ``condition``; the evoked ones where records carry stimuli."""
    steps = {name: (lambda c=column: stats.wide(stats.grouped_mean(records, c)).orderBy("fov").withColumnRenamed("fov", "FOV")) for name, column in GROUPED.items() if column in records.columns}
    columns = {
        "percentage_active": lambda: percentage_table(stats.percentage_active(records)),
        "calcium_peaks_synchrony": lambda: value_table(grouped.peak_synchrony(records)),
        "spike_synchrony": lambda: value_table(grouped.spike_synchrony(records)),
        "calcium_network_density": lambda: value_table(grouped.network_density(records, settings)),
        "burst_activity": lambda: burst_table(grouped.burst_activity(records, settings)),
    }
    steps |= {name: (lambda m=make: m().orderBy("row").drop("row")) for name, make in columns.items()}
    stimuli = "stimulations_frames_and_powers"
    if stimuli in records.columns and records.where(F.col(stimuli).isNotNull()).head(1):
        for name, stim in (("calcium_peaks_amplitudes_stimulated", True), ("calcium_peaks_amplitudes_non_stimulated", False)):
            steps[name] = lambda s=stim: evoked_table(grouped.evoked(records, s))
    return export_each({name: (lambda to, m=make: write_csv(m(), to)) for name, make in steps.items()}, path)
