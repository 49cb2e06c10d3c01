"""Exact top-k inner-product search: tiled matrix products, partial selection for each tile, tree merging of lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a shard and of a query block (hash tiles: sizes vary around these), and lists merged at once.
SHARD_BYTES, BLOCK_BYTES, FAN_IN = 4 << 20, 16 << 20, 8
_EXACT = 2.0**53


def integer_vector(embedding: str) -> Column:
    """floor(64 x) of each component as doubles; null for vectors that are null or hold null or non-finite components.

    From 2^52 on a double is whole as it stands, and from 2^63 on no bigint could hold it.
    """
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = lambda y: F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)
    return F.when(~bad, F.transform(embedding, lambda x: whole(x.cast("double") * 64.0)))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of q and c (whole doubles), as int64; beyond its range they are held at its ends.

    Rows of common size go through one float product, which 53 bits hold exactly. Only outliers take the slower ways:
    64-bit integers, and Python's where those could overflow. One outlier costs its own row or column, not the tile.
    """
    out, width = np.zeros((len(q), len(c)), np.int64), max(1, q.shape[1])
    if not len(q) or not len(c) or not q.shape[1]:
        return out
    top_q, top_c = np.abs(q).max(axis=1), np.abs(c).max(axis=1)
    low_q, low_c = (t * t * width < _EXACT for t in (top_q, top_c))
    out[np.ix_(low_q, low_c)] = (q[low_q] @ c[low_c].T).astype(np.int64)
    for rows, cols in ((np.flatnonzero(~low_q), np.arange(len(c))), (np.flatnonzero(low_q), np.flatnonzero(~low_c))):
        for r in rows if len(cols) else ():
            fits = top_q[r] * top_c[cols] * width < 2.0**62
            near, far = cols[fits], cols[~fits]
            if len(near) and top_q[r] < 2.0**62:
                out[r, near] = np.where(np.abs(c[near]) < 2.0**62, c[near], 0).astype(np.int64) @ q[r].astype(np.int64)
            if len(far):
                total = np.array([[int(x) for x in v] for v in c[far]], object) @ np.array([int(x) for x in q[r]], object)
                out[r, far] = np.clip(total, -(2**63), 2**63 - 1).astype(np.int64)
    return out


def tile_topk(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (score high, then id low) candidates of each query within one tile, the query's own id left out."""
    by_id = np.argsort(cid, kind="stable")
    cid, c = cid[by_id], c[by_id]
    out = [], [], []
    for s in range(0, len(qid), 256):
        for row, one in zip(scores(q[s : s + 256], c), qid[s : s + 256]):
            ok = np.flatnonzero(cid != one)
            if len(ok) > k:
                # Ties at the cut all stay in; the stable sort then prefers small ids.
                at = np.partition(row[ok], len(ok) - k)[len(ok) - k]
                ok = ok[row[ok] >= at]
            best = ok[np.argsort(-row[ok].astype(object) if row[ok].size and row[ok].min() == -(2**63) else -row[ok], kind="stable")[:k]]
            out[0].append(np.full(len(best), one))
            out[1].append(cid[best])
            out[2].append(row[best])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def topk(df: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", shard_rows: int | None = None, block_rows: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries whose id is divisible by ``every``, against all other rows.

    Rows with null id or without a usable vector take no part. Rows that share an id are all candidates of the other ids; as a query
    such an id counts once, with the smallest vector. Scores beyond a bigint are held at the ends of its range.
    Only vectors of the query's length are its candidates. Ties go to the smaller id. An empty table gives no rows.

    Every query block meets every shard once, as a pair of tiles of bounded size. A tile yields at most k rows for each
    query; lists are merged FAN_IN at a time. What is shuffled is (blocks * rows + shards * queries) vectors, so a block takes as many queries
    as BLOCK_BYTES hold of the longest vector, and a shard as many candidates as SHARD_BYTES do.
    """
    rows = df.select(F.col(vec_id).alias("vec_id"), integer_vector(embedding).alias("x")).where("vec_id is not null and x is not null")
    rows = rows.withColumn("dim", F.size("x"))
    asking = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("x").alias("x")).withColumn("dim", F.size("x"))
    n, m, width = df.agg(F.count("*"), F.count(F.when(F.col(vec_id) % every == 0, 1)), F.max(F.size(embedding))).first()
    row = 8 * max(1, width or 1)
    shard_rows, block_rows = shard_rows or max(1, SHARD_BYTES // row), block_rows or max(1, BLOCK_BYTES // row)
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // block_rows))
    h = F.xxhash64("vec_id")
    every_block, every_shard = F.sequence(F.lit(0), F.lit(blocks - 1)), F.sequence(F.lit(0), F.lit(shards - 1))
    cands = rows.select("vec_id", "x", "dim", F.pmod(F.xxhash64("vec_id", "x"), F.lit(shards)).cast("int").alias("shard"), F.explode(every_block).alias("block"))
    queries = asking.select("vec_id", "x", "dim", F.pmod(F.shiftrightunsigned(h, 8), F.lit(blocks)).cast("int").alias("block"), F.explode(every_shard).alias("shard"))

    def tile(key: tuple, rows: pa.Table) -> pa.Table:
        asks = rows["asks"].to_numpy()
        ids, x = rows["vec_id"].to_numpy(), _matrix(rows["x"])
        got = tile_topk(ids[asks], x[asks], ids[~asks], x[~asks], k)
        part = pa.array(np.full(len(got[0]), key[1].as_py(), np.int32))
        return pa.table([pa.array(got[0], pa.int64()), part, pa.array(got[1], pa.int64()), pa.array(got[2], pa.int64())], names=["query_id", "part", "vec_id", "score"])

    both = queries.withColumn("asks", F.lit(True)).unionByName(cands.withColumn("asks", F.lit(False)))
    lists = both.groupBy("block", "shard", "dim").applyInArrow(tile, "query_id long, part int, vec_id long, score long")
    best = [F.desc("score"), F.asc("vec_id")]
    while shards > FAN_IN:
        shards = -(-shards // FAN_IN)
        lists = lists.withColumn("part", (F.col("part") / FAN_IN).cast("int"))
        w = Window.partitionBy("query_id", "part").orderBy(*best)
        lists = lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")
    w = Window.partitionBy("query_id").orderBy(*best)
    ranked = lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
