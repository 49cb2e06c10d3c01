"""Row selection: regions, positions, conditions, trace kinds, data-quality assertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracesheaf.config import MIN_AREA
from tracesheaf.functions.exprs import parse_selection

KEYS = ["fov", "roi"]


def select_rois(df: DataFrame, rois: list[int] | str | None, roi: str = "roi") -> DataFrame:
    """rows of the chosen regions; a text such as ``1-3, 8`` is parsed, None keeps all."""
    if rois is None:
        return df
    if isinstance(rois, str):
        one = df.sparkSession.range(1).select(F.explode(parse_selection(F.lit(rois))).alias(roi))
        return df.join(F.broadcast(one), roi, "left_semi")
    return df.where(F.col(roi).isin(rois))


def random_rois(df: DataFrame, n: int, seed: int = 0, fov: str = "fov", roi: str = "roi", active: str | None = None) -> DataFrame:
    """``n`` regions of each field without replacement, active ones only where a flag column is given; a hash orders them, so reruns agree."""
    ids = df.where(F.coalesce(F.col(active), F.lit(False))) if active else df
    w = Window.partitionBy(fov).orderBy(F.xxhash64(F.col(fov), F.col(roi), F.lit(seed)), roi)
    chosen = ids.select(fov, roi).distinct().withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")
    return df.join(chosen, [fov, roi], "left_semi")


def positions_to_analyse(frame_meta: DataFrame, labels: DataFrame, positions: list[int] | None = None) -> DataFrame:
    """the listed positions (each must exist) or else those that have labels."""
    have = frame_meta.select("dataset", "p").distinct()
    if positions is None:
        return have.join(labels.select("dataset", "p").distinct(), ["dataset", "p"], "left_semi")
    top = have.agg(F.max("p")).first()[0]
    if any(p < 0 or top is None or p > top for p in positions):
        raise ValueError(f"position out of range 0..{top}")
    return have.where(F.col("p").isin(positions))


def missing_labels(frame_meta: DataFrame, labels: DataFrame) -> DataFrame:
    """Positions without a label image."""
    return frame_meta.select("dataset", "p").distinct().join(labels.select("dataset", "p").distinct(), ["dataset", "p"], "left_anti")


def fovs_of_well(df: DataFrame, well: str, has_plate: bool = True, fov: str = "fov") -> DataFrame:
    """fields whose name contains the well's; all of them without a plate plan."""
    return df.where(F.contains(F.col(fov), F.lit(well))) if has_plate else df


def drop_small(df: DataFrame, area: str = "area", pixel_size: str = "pixel_size_um", least: float = MIN_AREA) -> DataFrame:
    """regions below the least area go, only where the pixel size is known."""
    return df.where((F.coalesce(F.col(pixel_size), F.lit(0.0)) == 0) | (F.col(area) >= least))


def active(peaks: str = "peaks") -> Column:
    """at least one peak."""
    return F.coalesce(F.size(peaks), F.lit(0)) > 0


#: The order in which a trace view picks its trace.
TRACE_ORDER = ["dff", "dec_dff", "raw_trace", "corrected_trace"]


def trace_of(dff: bool = False, dec: bool = False, raw: bool = False) -> str:
    """the column of a trace view; the first flag that is set decides, none means the corrected trace."""
    return TRACE_ORDER[next((i for i, on in enumerate((dff, dec, raw)) if on), 3)]


def by_stimulation(df: DataFrame, stimulated: bool) -> DataFrame:
    """stimulated or other regions; null counts as not stimulated."""
    return df.where(F.coalesce(F.col("stimulated"), F.lit(False)) == stimulated)


def stimulated_last(df: DataFrame) -> DataFrame:
    """O3: regions that are not stimulated first, then by region."""
    return df.orderBy("fov", F.coalesce(F.col("stimulated"), F.lit(False)), "roi")


def with_conditions(df: DataFrame, conditions: list[str] | None, condition: str = "condition") -> DataFrame:
    """conditions that are switched on."""
    return df if conditions is None else df.where(F.col(condition).isin(conditions))


def with_neuropil(df: DataFrame, masks: bool = False) -> DataFrame:
    """regions with raw, neuropil and corrected traces, or with both masks."""
    names = ["mask_coord_and_shape", "neuropil_mask_coord_and_shape"] if masks else ["raw_trace", "neuropil_trace", "corrected_trace"]
    return df.dropna(subset=names)


def plate_map_faults(conditions: DataFrame) -> DataFrame:
    """names and colours that a list of conditions (condition, color) holds more than once; a repeated entry is a fault as well."""
    names = conditions.groupBy(F.lit("condition").alias("what"), F.col("condition").alias("value")).count()
    colors = conditions.groupBy(F.lit("color").alias("what"), F.col("color").alias("value")).count()
    return names.union(colors).where(F.col("count") > 1)


def first_setting(df: DataFrame, columns: list[str], fov: str = "fov", roi: str = "roi") -> DataFrame:
    """Each field's parameters, taken from its first region."""
    return df.groupBy(fov).agg(*[F.min_by(c, roi).alias(c) for c in columns])
