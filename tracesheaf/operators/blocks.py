"""Block tables: images as square blocks, each one row (dataset, p, t, by, bx, values).

A block holds SIDE x SIDE pixels row by row, null where the image has none. The pixels of a region are rows of places in a block, so
traces come from a join of blocks, not of pixels, and sums are taken where a block lies. Tables saved by ``save_blocks`` join without a
shuffle of either side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AT = ["dataset", "p"]
BLOCK = [*AT, "by", "bx"]
SIDE = 32


def _block(axis: str) -> Column:
    return F.floor(F.col(axis) / SIDE).cast("long").alias(f"b{axis}")


def _place() -> Column:
    """A pixel's place in its block."""
    return (F.pmod("y", F.lit(SIDE)) * SIDE + F.pmod("x", F.lit(SIDE))).cast("int").alias("at")


def _full(pairs: str) -> Column:
    """Pairs (at, value) as one array of all places."""

    @F.arrow_udf("array<double>")
    def spread(lists: pa.Array) -> pa.Array:
        flat, n = lists.flatten(), len(lists)
        row = np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False))
        out, held = np.zeros(n * SIDE * SIDE), np.zeros(n * SIDE * SIDE, bool)
        value = flat.field(1)
        at = row * SIDE * SIDE + flat.field(0).to_numpy(zero_copy_only=False)
        out[at] = value.fill_null(0.0).to_numpy(zero_copy_only=False)
        held[at] = value.is_valid().to_numpy(zero_copy_only=False)
        ends = pa.array(np.arange(n + 1, dtype=np.int32) * SIDE * SIDE)
        return pa.ListArray.from_arrays(ends, pa.array(out, mask=~held))

    return spread(pairs)


def to_blocks(pixels: DataFrame) -> DataFrame:
    """The block table of a pixel table (dataset, p, t, y, x, value): one shuffle, of the pixels by block. Of a pixel that occurs twice one value stays."""
    cells = pixels.select(*AT, "t", _block("y"), _block("x"), F.struct(_place(), F.col("value").cast("double").alias("v")).alias("c"))
    held = cells.groupBy(*AT, "t", "by", "bx").agg(F.collect_list("c").alias("c"))
    return held.select(*AT, "t", "by", "bx", _full("c").alias("values"))


def to_pixels(blocks: DataFrame) -> DataFrame:
    """The pixel table of a block table."""
    each = blocks.select(*AT, "t", "by", "bx", F.posexplode("values").alias("at", "value")).where("value is not null")
    return each.select(*AT, "t", (F.col("by") * SIDE + F.floor(F.col("at") / SIDE)).alias("y"), (F.col("bx") * SIDE + F.col("at") % SIDE).alias("x"), "value")


def region_blocks(labels: DataFrame) -> DataFrame:
    """(dataset, p, by, bx, cells): the places and labels of all region pixels of a block; regions may overlap."""
    cells = labels.where("label <> 0").select(*AT, _block("y"), _block("x"), F.struct(_place(), F.col("label")).alias("c"))
    return cells.groupBy(*BLOCK).agg(F.collect_list("c").alias("cells"))


def save_blocks(blocks: DataFrame, table: str, buckets: int = 200, path: str | None = None) -> None:
    """Saves a table of blocks, or of ``region_blocks``, in ``buckets`` by block: two such tables of equal buckets are joined where they lie."""
    writer = blocks.write.mode("overwrite").format("parquet").bucketBy(buckets, *BLOCK).sortBy(*BLOCK)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def roi_traces(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """(dataset, p, label, frame, value), the mean over each region's pixels on each frame, of a block table.

    ``labels``: a label table, or its ``region_blocks``. A block's sums are taken in the task that reads it; only they, a row for each region and
    frame of a task, are shuffled.
    """
    regions = labels if "cells" in labels.columns else region_blocks(labels)
    hit = blocks.join(regions, BLOCK).select(*AT, "t", "values", F.explode("cells").alias("c"))
    value = hit.select(*AT, F.col("c.label").alias("label"), F.col("t").alias("frame"), F.get("values", F.col("c.at")).alias("v")).where("v is not null")
    return value.groupBy(*AT, "label", "frame").agg(F.avg("v").alias("value"))


def max_projection(blocks: DataFrame) -> DataFrame:
    """(dataset, p, y, x, value), the maximum over the second half of the frames of a block table; a task sends each pixel once, whatever its frames."""
    half = blocks.groupBy(*AT).agg(F.floor((F.max("t") + 1) / 2).alias("half"))
    late = blocks.join(half, AT).where("t >= half").select(*BLOCK, F.posexplode("values").alias("at", "v")).where("v is not null")
    top = late.groupBy(*BLOCK, "at").agg(F.max("v").alias("value"))
    return top.select(*AT, (F.col("by") * SIDE + F.floor(F.col("at") / SIDE)).alias("y"), (F.col("bx") * SIDE + F.col("at") % SIDE).alias("x"), "value")
