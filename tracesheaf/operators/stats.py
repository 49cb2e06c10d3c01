"""Grouped statistics. Four kinds of standard error occur; each has its own function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sem(c: str | Column) -> Column:
    """Sample deviation over the root of n; 0 for one value."""
    return F.when(F.count(c) == 1, 0.0).otherwise(F.stddev_samp(c) / F.sqrt(F.count(c)))


def sem_sample(c: str) -> Column:
    """Null for one value."""
    return F.when(F.count(c) > 1, F.stddev_samp(c) / F.sqrt(F.count(c)))


def sem_population(c: str) -> Column:
    """Population deviation over the root of n."""
    return F.stddev_pop(c) / F.sqrt(F.count(c))


def grouped_mean(df: DataFrame, value: str, keys: list[str] = ["condition", "fov"], digits: int | None = 5) -> DataFrame:
    """A1: mean, sem, n of values (arrays are flattened, nulls skipped); groups of empty lists stay, with n = 0."""
    if dict(df.dtypes)[value].startswith("array"):
        df = df.select(*keys, F.explode_outer(value).alias(value))
    out = df.groupBy(*keys).agg(F.avg(value).alias("mean"), sem(value).alias("sem"), F.count(value).alias("n"))
    return out if digits is None else out.withColumns({c: F.bround(c, digits) for c in ("mean", "sem")})


def percentage_active(df: DataFrame, flag: str = "active", keys: list[str] = ["condition", "fov"], digits: int | None = 4) -> DataFrame:
    """A3: pct of active regions and n regions."""
    pct = 100 * F.avg(F.coalesce(F.col(flag), F.lit(False)).cast("int"))
    return df.groupBy(*keys).agg((F.bround(pct, digits) if digits is not None else pct).alias("pct"), F.count("*").alias("n"))


def pooled(df: DataFrame, key: str = "condition") -> DataFrame:
    """Weighted mean and pooled SEM over rows (mean, sem, n); plain means where all n together are at most 1; rows with any null go."""
    d = df.select(key, "mean", "sem", "n").dropna()
    m = d.groupBy(key).agg(F.sum("n").alias("total"), F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("wm"), F.avg("mean").alias("pm"), F.avg("sem").alias("ps"))
    d = d.join(m, key)
    spread = F.sum((F.col("n") - 1) * F.col("sem") * F.col("sem") + F.col("n") * F.pow(F.col("mean") - F.col("wm"), 2))
    out = d.groupBy(key).agg(spread.alias("q"), *[F.first(c).alias(c) for c in ("total", "wm", "pm", "ps")])
    many = F.col("total") > 1
    err = F.sqrt(F.try_divide("q", F.col("total") - 1)) / F.sqrt("total")
    return out.select(key, F.when(many, F.col("wm")).otherwise(F.col("pm")).alias("mean"), F.when(many, err).otherwise(F.col("ps")).alias("sem"), F.col("total").alias("n"))


def binomial(df: DataFrame, key: str = "condition") -> DataFrame:
    """Weighted percentage and its binomial standard error over rows (pct, n); groups without n go."""
    g = df.groupBy(key).agg(F.sum(F.col("pct") / 100 * F.col("n")).alias("k"), F.sum("n").alias("total")).where("total > 0")
    p = F.col("k") / F.col("total")
    return g.select(key, (100 * p).alias("pct"), F.when((p <= 0) | (p >= 1), 0.0).otherwise(100 * F.sqrt(p * (1 - p) / F.col("total"))).alias("sem"), F.col("total").alias("n"))


def single_values(df: DataFrame, value: str = "value", key: str = "condition") -> DataFrame:
    """Mean and sem of single values, 0 for one."""
    return df.groupBy(key).agg(F.avg(value).alias("mean"), sem(value).alias("sem"), F.count(value).alias("n"))


def amplitude_rows(events: DataFrame, keys: list[str] = ["fov", "roi"]) -> DataFrame:
    """Each region's amplitude mean and sem (null for one peak)."""
    return events.groupBy(*keys).agg(F.avg("amplitude").alias("mean"), sem_sample("amplitude").alias("sem"), F.count("amplitude").alias("n"))


def interval_summary(intervals: DataFrame, keys: list[str] = ["fov", "roi"]) -> DataFrame:
    """Each region's mean interval and ``iei_err`` = mean over the root of n, as recorded results have it."""
    return intervals.where("iei is not null").groupBy(*keys).agg(F.avg("iei").alias("iei"), (F.avg("iei") / F.sqrt(F.count("iei"))).alias("iei_err"))


#: Distinct keys that may become columns of one table.
MAX_COLUMN_KEYS = 5000


def column_keys(df: DataFrame, key: str) -> list[str]:
    """The sorted keys that become columns; more than MAX_COLUMN_KEYS are an error."""
    names = [r[0] for r in df.select(key).where(F.col(key).isNotNull()).distinct().limit(MAX_COLUMN_KEYS + 1).collect()]
    if len(names) > MAX_COLUMN_KEYS:
        raise ValueError(f"more than {MAX_COLUMN_KEYS} values of {key}: too many for columns")
    return sorted(names)


def ragged(df: DataFrame, columns: dict[str, str], key: str = "condition", order: list[str] = ["fov"]) -> DataFrame:
    """One set of columns for each key, the k-th row holding each key's k-th values; shorter ones end in nulls.

    ``columns``: value column to name suffix; the keys become column names (see ``column_keys``).
    """
    names = column_keys(df, key)
    rows = df.withColumn("row", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return rows.groupBy("row").agg(*[F.max(F.when(F.col(key) == k, F.col(c))).alias(f"{k}{s}") for k in names for c, s in columns.items()])


def wide(df: DataFrame, key: str = "condition", row: str | list[str] = "fov", values: tuple[str, ...] = ("mean", "sem", "n"), suffixes: tuple[str, ...] = ("_Mean", "_SEM", "_N")) -> DataFrame:
    """K7: a row for each field, three columns for each sorted condition."""
    names = column_keys(df, key)
    return df.groupBy(*([row] if isinstance(row, str) else row)).agg(*[F.max(F.when(F.col(key) == k, F.col(v))).alias(f"{k}{s}") for k in names for v, s in zip(values, suffixes)])
