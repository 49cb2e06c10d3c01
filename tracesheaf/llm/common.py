"""Shared helpers: durable intermediate tables, the train/held-out split, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracesheaf.sources.scratch import scratch_path

WORD = r"[^\x20\x09-\x0D]+"


def written(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    ``instead_of``: a table written before that nothing reads any more, such as the last round's; its folder is deleted.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    if instead_of is not None:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for old in {f.rsplit("/", 1)[0] for f in instead_of.inputFiles()}:
            folder = jvm.org.apache.hadoop.fs.Path(old)
            folder.getFileSystem(conf).delete(folder, True)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spare_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it none of ``df``'s columns in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Lower the session's Arrow batch limits for good: rows hold whole texts, and a worker holds a few batches at once.

    Plans read the limits when they run, so they cannot be set back where a plan is made. Limits below these stay.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def held_out(id_col: str) -> Column:
    """True for the rows no model may learn from: crc32 of the id as text, modulo 3, is 1. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: bigint), root being the smallest node that it reaches.

    Alternates large-star and small-star contraction; each round is two aggregations and two
    equi-joins whose result is written, so neither the driver nor one task holds a component.
    Nodes without edges are not returned. An empty table gives an empty table. The rounds grow with the logarithm of a component's
    size; a table that is not settled after ``max_rounds`` is an error.
    """
    at = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )

    def state(df: DataFrame) -> tuple:
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    before = state(at)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = at.union(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        at = written(low.select("a", F.col("m").alias("b")).union(small).distinct(), "edges", instead_of=at)
        now = state(at)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    roots = at.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return at.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
