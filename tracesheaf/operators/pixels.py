"""Pixel-table operators. ``labels``: (dataset, p, y, x, label); ``pixels``: also t and value."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracesheaf.operators import blocks
from tracesheaf.operators.bursts import gaussian_kernel
from tracesheaf.operators.shapes import REACH, closed, growth, ring, smooth

AT = ["dataset", "p"]
STEPS = [(0, 1), (0, -1), (1, 0), (-1, 0)]


def roi_traces(pixels: DataFrame, labels: DataFrame) -> DataFrame:
    """(dataset, p, label, frame, value), the mean over each region's pixels on each frame, of a pixel or a block table."""
    return blocks.roi_traces(pixels if "values" in pixels.columns else blocks.to_blocks(pixels), labels)


def max_projection(pixels: DataFrame) -> DataFrame:
    """The maximum over the second half of the frames, of a pixel or a block table."""
    if "values" in pixels.columns:
        return blocks.max_projection(pixels)
    half = pixels.groupBy(*AT).agg(F.floor((F.max("t") + 1) / 2).alias("__half"))
    return pixels.join(half, AT).where("t >= __half").groupBy(*AT, "y", "x").agg(F.max("value").alias("value"))


def geometry(labels: DataFrame) -> DataFrame:
    """Pixel count, centroid and bounding box of each region; background is left out."""
    return labels.where("label <> 0").groupBy(*AT, "label").agg(F.count("*").alias("n"), F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))


def erode(labels: DataFrame) -> DataFrame:
    """Pixels whose four neighbours are of the same region; outside the image is background."""
    mine = labels.where("label <> 0").select(*AT, "label", "y", "x")
    moves = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in [(0, 0), *STEPS]]))
    votes = mine.withColumn("m", moves).select(*AT, "label", (F.col("y") + F.col("m.dy")).alias("y"), (F.col("x") + F.col("m.dx")).alias("x"))
    return votes.groupBy(*AT, "label", "y", "x").count().where("count = 5").drop("count")


def _arrays(list_of_structs: pa.Array) -> list[np.ndarray]:
    """The fields of a list of structs as integer arrays."""
    return [f.to_numpy(zero_copy_only=False).astype(np.int64) for f in list_of_structs.flatten()]


def _out(kind: T.DataType) -> pa.DataType:
    return pa.int64() if isinstance(kind, T.LongType) else pa.int32()


def grown(labels: DataFrame, steps: int, height: int, width: int) -> DataFrame:
    """(.., label, y, x, d) of pixels within ``steps`` 4-neighbour steps of each region and inside the image; d is the distance.

    A region's distances are taken in its window, so the work is the window's pixels; one shuffle, of the label pixels by region.
    """
    rows = labels.where("label <> 0").groupBy(*AT, "label").agg(F.collect_list(F.struct(F.col("y").cast("long"), F.col("x").cast("long"))).alias("c"))
    kinds = [*[labels.schema[c] for c in (*AT, "label", "y", "x")], T.StructField("d", T.IntegerType())]
    names, (ky, kx) = [k.name for k in kinds], (_out(labels.schema[c].dataType) for c in "yx")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, cells in enumerate(batch.column(3)):
                y, x, d = growth(*_arrays(cells.values), steps, height, width)
                of = pa.array(np.full(len(y), i))
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(of) for k in range(3)], pa.array(y, ky), pa.array(x, kx), pa.array(d, pa.int32())], names)

    return rows.mapInArrow(spread, T.StructType(kinds))


def neuropil_ring(labels: DataFrame, inner: int, min_pixels: int, height: int, width: int, step: int = 5, rounds: int = 100) -> DataFrame:
    """Each region's ring: the smallest growth by ``step`` that holds enough pixels outside all regions and the margin.

    A position's label pixels meet in one task, which holds its image as bits; each region's distances are taken in a window that is widened
    fourfold until the ring is found, so the work is the window's pixels.
    """
    kinds = T.StructType([labels.schema[c] for c in (*AT, "label", "y", "x")])
    arrow = pa.schema([(k.name, pa.string() if isinstance(k.dataType, T.StringType) else _out(k.dataType)) for k in kinds])

    def rings(table: pa.Table) -> pa.Table:
        label, y, x = (table.column(c).to_numpy().astype(np.int64) for c in ("label", "y", "x"))
        free = np.ones((height, width), bool)
        seen = (y >= 0) & (y < height) & (x >= 0) & (x < width)
        free[y[seen], x[seen]] = False
        order = np.argsort(label, kind="stable")
        parts = []
        for own in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
            ys, xs = ring(y[own], x[own], free, inner, min_pixels, step, rounds)
            parts.append((np.full(len(ys), label[own[0]]), ys, xs))
        found = [np.concatenate(p) for p in zip(*parts)]
        where = pa.array(np.zeros(len(found[0]), np.int64))
        keys = [table.column(c).combine_chunks().take(where) for c in AT]
        return pa.table([*keys, *[pa.array(v) for v in found]], names=arrow.names).cast(arrow)

    return labels.where("label <> 0").select(*kinds.names).groupBy(*AT).applyInArrow(rings, kinds)


def to_masks(labels: DataFrame, height: int, width: int) -> DataFrame:
    """Coordinates of each region as one struct (ys, xs, h, w)."""
    yx = F.array_sort(F.collect_list(F.struct("y", "x")))
    g = labels.where("label <> 0").groupBy(*AT, "label").agg(yx.alias("c"))
    return g.select(*AT, "label", F.struct(F.col("c.y").alias("ys"), F.col("c.x").alias("xs"), F.lit(height).alias("h"), F.lit(width).alias("w")).alias("mask"))


def from_masks(masks: DataFrame, mask: str = "mask") -> DataFrame:
    """A row for each pixel of a mask struct."""
    z = F.explode(F.arrays_zip(F.col(f"{mask}.ys").alias("y"), F.col(f"{mask}.xs").alias("x")))
    return masks.select(*[c for c in masks.columns if c != mask], z.alias("z")).select("*", "z.y", "z.x").drop("z")


def composite(rows: DataFrame, height: int | None = None, width: int | None = None, order: str = "label", keys: list[str] = AT) -> DataFrame:
    """One label for each pixel, the last in order winning; pixels outside the image go, where its size is given."""
    if height is not None and width is not None:
        rows = rows.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))
    return rows.groupBy(*keys, "y", "x").agg(F.max_by("label", order).alias("label"))


def roi_at(labels: DataFrame, y: int, x: int) -> DataFrame:
    """The region at a pixel of each position."""
    return labels.where((F.col("y") == y) & (F.col("x") == x) & (F.col("label") != 0)).select(*AT, "label")


def highlight(labels: DataFrame, rois: list[int]) -> DataFrame:
    """Pixels of the chosen regions."""
    return labels.where(F.col("label").isin(rois))


def union_mask(labels: DataFrame) -> DataFrame:
    """All pixels of any region."""
    return labels.where("label <> 0").select(*AT, "y", "x").distinct()


def otsu(df: DataFrame, keys: list[str], bins: int = 256) -> DataFrame:
    """(keys, at): the histogram bin centre of greatest between-class variance of each image; of equal ones the lowest."""
    ends = df.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    step = (F.col("hi") - F.col("lo")) / bins
    k = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("lo")) / step))).otherwise(0)
    n = df.join(ends, keys).groupBy(*keys, "lo", "hi", k.alias("k")).agg(F.count("*").alias("n"))
    n = n.withColumn("mid", F.col("lo") + (F.col("k") + 0.5) * step)
    upto = Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = {"w": F.sum("n").over(upto), "s": F.sum(F.col("n") * F.col("mid")).over(upto), "total": F.sum("n").over(whole), "mass": F.sum(F.col("n") * F.col("mid")).over(whole)}
    rest = F.col("total") - F.col("w")
    v = F.when(rest > 0, F.col("w") * rest * F.pow(F.col("s") / F.col("w") - (F.col("mass") - F.col("s")) / rest, F.lit(2.0)))
    best = n.withColumns(sums).withColumn("v", v).groupBy(*keys).agg(F.max(F.struct("v", -F.col("k"), "mid", "lo", "hi")).alias("b"))
    return best.select(*keys, F.when(F.col("b.hi") > F.col("b.lo"), F.col("b.mid")).otherwise(F.col("b.lo")).alias("at"))


def stimulation_mask(image: DataFrame, height: int, width: int, sigma: float = 2.0, keys: list[str] = [], side: int = 256) -> DataFrame:
    """I4: (keys, y, x) of the stimulated area of each image (keys, y, x, value); without keys the rows are one image.

    An image of ones, or of zeros and ones, is the mask. Otherwise: Gaussian (edges repeated), Otsu threshold, closing by a disk of
    2, erosion by 2, closing by 5. Pixels go once, to tiles of ``side`` that carry a margin as wide as the whole chain reaches; only an image's
    histogram is taken over its tiles.
    """
    at = keys or ["__image"]
    image = (image if keys else image.withColumn("__image", F.lit(0))).select(*at, "y", "x", "value").where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))
    kernel = gaussian_kernel(sigma)
    halo = max(k for k, _ in kernel) + REACH
    over = lambda axis, size: F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col(axis) - halo) / side)), F.least(F.lit((size - 1) // side), F.floor((F.col(axis) + halo) / side))))
    pixel = F.struct(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("value").cast("double").alias("value"))
    tiles = image.withColumn("__ty", over("y", height)).withColumn("__tx", over("x", width)).groupBy(*at, "__ty", "__tx").agg(F.collect_list(pixel).alias("c"))

    def window(ty, tx, cells):
        """Values and presence of the tile with its margin, its first row and column, and which pixels are its own."""
        y0, x0 = max(0, ty * side - halo), max(0, tx * side - halo)
        shape = min(height, (ty + 1) * side + halo) - y0, min(width, (tx + 1) * side + halo) - x0
        y, x, v = (f.to_numpy(zero_copy_only=False) for f in cells.values.flatten())
        value, held = np.zeros(shape), np.zeros(shape, bool)
        value[y - y0, x - x0], held[y - y0, x - x0] = v, True
        rows, cols = np.arange(y0, y0 + shape[0]) // side == ty, np.arange(x0, x0 + shape[1]) // side == tx
        return value, held, y0, x0, rows[:, None] & cols

    @F.arrow_udf("array<double>")
    def smoothed(ty: pa.Array, tx: pa.Array, cells: pa.Array) -> pa.Array:
        out = []
        for i, j, c in zip(ty.to_pylist(), tx.to_pylist(), cells):
            value, held, _, _, own = window(i, j, c)
            out.append(smooth(value, held, kernel)[held & own])
        return pa.array(out, pa.list_(pa.float64()))

    @F.arrow_udf("array<struct<y:bigint,x:bigint>>")
    def area(ty: pa.Array, tx: pa.Array, cells: pa.Array, plain: pa.Array, threshold: pa.Array) -> pa.Array:
        out = []
        for i, j, c, p, t in zip(ty.to_pylist(), tx.to_pylist(), cells, plain.to_pylist(), threshold.to_pylist()):
            value, held, y0, x0, own = window(i, j, c)
            y, x = np.nonzero(own & (held & (value == 1) if p else closed(smooth(value, held, kernel) > t, held)))
            out.append(pa.StructArray.from_arrays([pa.array(y + y0), pa.array(x + x0)], ["y", "x"]))
        ends = pa.array(np.cumsum([0, *map(len, out)]), pa.int32())
        flat = pa.concat_arrays(out) if out else pa.array([], pa.struct([("y", pa.int64()), ("x", pa.int64())]))
        return pa.ListArray.from_arrays(ends, flat)

    values = tiles.select(*at, smoothed("__ty", "__tx", "c").alias("s")).select(*at, F.explode("s").alias("value"))
    threshold = otsu(values, at).withColumnRenamed("at", "__at")
    ones = F.bool_and(F.forall("c", lambda v: v["value"].isin(0.0, 1.0))) & (F.max(F.array_max(F.transform("c", lambda v: v["value"]))) == 1)
    per = tiles.groupBy(*at).agg(ones.alias("__plain")).join(threshold, at)
    found = tiles.join(per, at).select(*keys, area("__ty", "__tx", "c", "__plain", "__at").alias("a")).select(*keys, F.explode("a").alias("m"))
    return found.select(*keys, F.col("m.y").cast(image.schema["y"].dataType).alias("y"), F.col("m.x").cast(image.schema["x"].dataType).alias("x"))


def batch_inference(projection: DataFrame, model: Callable, schema: str = "dataset string, p int, y int, x int, label int") -> DataFrame:
    """Runs the caller's ``model(pandas.DataFrame) -> pandas.DataFrame`` on each position's image."""
    return projection.groupBy(*AT).applyInPandas(model, schema)
