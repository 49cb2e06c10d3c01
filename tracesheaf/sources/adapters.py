"""The star-schema tables seen as recordings. The same definitions stand as SQL in plans/oracle.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _framed(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Numbers the rows of each key. They are dealt to all partitions: few bytes of traces make much work, so their tasks must not be put together by size."""
    df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    return df.withColumn("frame", (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tr``: long traces from events: a user is a region, users modulo 10 are fields."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")
    e = _framed(e, "user_id", ["ts", "event_id"])
    return e.select((F.col("user_id") % 10).alias("fov"), F.col("user_id").alias("roi"), "frame", F.unix_millis("ts").alias("t_ms"), "value", "event_type", "props")


def big_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tr_big``: long traces from line items: a supplier is a region, suppliers modulo 20 are fields."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice")
    li = _framed(li, "l_suppkey", ["l_shipdate", "l_orderkey", "l_linenumber"])
    return li.select((F.col("l_suppkey") % 20).alias("fov"), F.col("l_suppkey").alias("roi"), "frame", F.col("l_extendedprice").alias("value"))


def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``arr``: array traces from embeddings: a vector is a region, labels are fields."""
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("fov"), F.col("vec_id").alias("roi"), F.col("embedding").cast("array<double>").alias("trace"))


def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``spk``: frames of ``tr`` above their region's 75th percentile."""
    tr = traces(spark, sf_dir).select("fov", "roi", "frame", "value")
    p = tr.groupBy("roi").agg(F.percentile("value", 0.75).alias("p75"))
    return tr.join(p, "roi").where("value > p75").select("fov", "roi", "frame", F.col("value").alias("amplitude"))


def field_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fov, n_frames, seconds) of ``tr``."""
    return traces(spark, sf_dir).groupBy("fov").agg((F.max("frame") + 1).alias("n_frames"), ((F.max("t_ms") - F.min("t_ms")) / 1000).alias("seconds"))


def conditions(df: DataFrame) -> DataFrame:
    """Adds ``condition``, c0 to c2 by region."""
    return df.withColumn("condition", F.concat(F.lit("c"), (F.col("roi") % 3).cast("string")))


def plate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(well, condition_1, condition_2): suppliers with region and nation names."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    j = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.select(F.concat(F.lit("W"), F.col("s_suppkey").cast("string")).alias("well"), F.col("r_name").alias("condition_1"), F.col("n_name").alias("condition_2"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pix``: mean quantity of line items on a 32 x 32 grid by line number (position) and ship month (frame)."""
    li = table(spark, sf_dir, "lineitem")
    month = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long")
    g = li.groupBy(F.col("l_linenumber").cast("long").alias("p"), (month - 1992 * 12).alias("t"), (F.col("l_partkey") % 32).alias("y"), (F.col("l_suppkey") % 32).alias("x"))
    return g.agg(F.avg("l_quantity").alias("value")).withColumn("dataset", F.lit("d"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lab``: blocks of 7 x 7 pixels with a gap of one on the grid points of ``pix``."""
    li = table(spark, sf_dir, "lineitem").where("l_partkey % 8 < 7 and l_suppkey % 8 < 7")
    grid = li.select(F.col("l_linenumber").cast("long").alias("p"), (F.col("l_partkey") % 32).alias("y"), (F.col("l_suppkey") % 32).alias("x")).distinct()
    return grid.select(F.lit("d").alias("dataset"), "p", "y", "x", F.expr("(y div 8) * 4 + x div 8 + 1").alias("label"))


def stimuli(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``stim``: frames of ``tr`` with event type ``click``; power from the JSON, the greatest of a field's frame, pulse 100."""
    tr = traces(spark, sf_dir).where("event_type = 'click'")
    return tr.select("fov", "frame", F.get_json_object("props", "$.k").cast("int").alias("power")).groupBy("fov", "frame").agg(F.max("power").alias("power")).withColumn("pulse", F.lit("100"))
