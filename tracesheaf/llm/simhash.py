"""SimHash fingerprints and near-duplicate classes by BK-trees over shards.

Two fingerprints within ``radius`` bits agree on at least two of ``radius + 2`` blocks, so every pair
of blocks names a table of shards and each link lies within one shard. A shard's fingerprints
go into a BK-tree (children keyed by the distance to their parent; a search follows only edges within the
radius). The trees are built where their shard lies: fingerprints grow with the input, so no tree is
sent to all executors. Only a spanning forest of each shard's links leaves it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesheaf.llm.common import connected_components, spare_name, text_batches, written

WORDS, RADIUS, SEED = 3, 2, 42
#: Shards above this are split by the bits that they do not share before trees are built, with the same links.
TREE_NODES = 4096


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """XXH64 of every word shingle of the whole text (uint64), repeats included; none where there is no word."""
    parts = (text or "").encode("utf-8", "replace").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not parts:
        return np.zeros(0, np.uint64)
    whole = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    n = max(1, len(parts) - words + 1)
    begin = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    until = ends[-n:].tolist()
    h = xxhash.xxh64_intdigest
    return np.array([h(whole[s:e], SEED) for s, e in zip(begin, until)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of ``hashes``, as an unsigned integer; 0 of none."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(n, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def simhash(text: str | None, words: int = WORDS) -> int:
    """64-bit SimHash over word shingles, as an unsigned integer; 0 where there is no word."""
    return majority(shingle_hashes(text, words))


def simhash_column(text: str = "text", words: int = WORDS) -> Column:
    """The fingerprint as a signed bigint with the same 64 bits."""

    @F.arrow_udf("long")
    def fingerprints(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([simhash(t.as_py(), words) for t in texts], np.uint64).astype(np.int64))

    return fingerprints(F.col(text))


def hex64(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(c)), 16, "0")


class BKTree:
    """Fingerprints by Hamming distance to their parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, v: int) -> None:
        self.values.append(v)
        self.children.append({})
        at, new = 0, len(self.values) - 1
        while at != new:
            at = self.children[at].setdefault((v ^ self.values[at]).bit_count(), new)

    def within(self, v: int, radius: int) -> Iterator[int]:
        todo = [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (v ^ self.values[at]).bit_count()
            if d <= radius:
                yield at
            todo += [c for k, c in self.children[at].items() if d - radius <= k <= d + radius]


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = i = parent[parent[i]]
    return i


def _forest(values: list[int], radius: int, parent: list[int], which: list[int]) -> None:
    tree = BKTree()
    for i in which:
        for k in tree.within(values[i], radius):
            a, b = _find(parent, i), _find(parent, which[k])
            parent[max(a, b)] = min(a, b)
        tree.add(values[i])


def shard_links(values: list[int], shared: int, radius: int) -> list[tuple[int, int]]:
    """A spanning forest, as (index, index), of the links among distinct ``values`` that agree on the bits ``shared``."""
    parent = list(range(len(values)))
    if len(values) <= TREE_NODES:
        _forest(values, radius, parent, list(range(len(values))))
    else:
        free = [b for b in range(64) if not shared >> b & 1]
        for part in range(radius + 1):  # within the free bits one of radius + 1 blocks agrees
            mask, groups = sum(1 << b for b in free[part :: radius + 1]), {}
            for i, v in enumerate(values):
                groups.setdefault(v & mask, []).append(i)
            for which in groups.values():
                if len(which) > 1:
                    _forest(values, radius, parent, which)
    return [(i, r) for i in range(len(values)) if (r := _find(parent, i)) != i]


def block_masks(radius: int) -> list[int]:
    n = radius + 2
    bounds = [64 * i // n for i in range(n + 1)]
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(bounds, bounds[1:])]
    return [a | b for a, b in combinations(blocks, 2)]


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) links among the distinct fingerprints ``fp``; together they connect what is within ``radius``."""
    masks = block_masks(radius)
    tables = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for t, m in enumerate(masks)]))
    keyed = distinct.select("fp", tables.alias("s")).select(F.col("s.t").alias("t"), F.col("s.k").alias("k"), "fp")
    keyed = keyed.repartition("t", "k").sortWithinPartitions("t", "k", "fp")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        rest = (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))

        def flush(t, k, fp) -> Iterator[pa.RecordBatch]:
            edge = np.flatnonzero((np.diff(t) != 0) | (np.diff(k) != 0)) + 1
            begin, end = np.concatenate([[0], edge]), np.concatenate([edge, [len(fp)]])
            a, b = [], []
            for s, e in zip(begin[end - begin > 1].tolist(), end[end - begin > 1].tolist()):
                own = fp[s:e]
                for i, r in shard_links(own.astype(np.uint64).tolist(), masks[t[s]], radius):
                    a.append(own[i])
                    b.append(own[r])
            if a:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

        for batch in batches:
            t, k, fp = (np.concatenate([r, batch.column(i).to_numpy()]) for i, r in enumerate(rest))
            if not len(fp):
                continue
            # The last shard may go on in the next batch.
            last = int(np.flatnonzero((t != t[-1]) | (k != k[-1]))[-1]) + 1 if ((t != t[-1]) | (k != k[-1])).any() else 0
            if last:
                yield from flush(t[:last], k[:last], fp[:last])
            rest = (t[last:], k[last:], fp[last:])
        if len(rest[2]):
            yield from flush(*rest)

    return keyed.mapInArrow(search, "a long, b long").distinct()


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, row_key, component_id) for every row of ``df``; component_id is the smallest doc_id reachable.

    Null and word-free texts have fingerprint 0 and link like any other. Equal texts share a fingerprint, so only
    distinct fingerprints are searched. Null ids stay as rows but never name a component that has another id.
    row_key is a 64-bit hash of id and text.
    """
    text_batches(df.sparkSession)
    rows = written(df.select(F.col(doc_id).alias("doc_id"), simhash_column(text, words).alias("fp"), F.xxhash64(doc_id, text).alias("row_key")), "simhash")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = connected_components(fingerprint_links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    named = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows.join(named.select("fp", "root").join(lows, "root").drop("root"), "fp")


def keep_one(df: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """``df`` with one row of each component: that with the smallest (doc_id, row_key); repeats of that row go too."""
    classes = near_duplicates(df, text, doc_id, words, radius)
    mine = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row_key")
    # Components without any id are told apart by fingerprint alone; they are rare and each keeps one row for each fingerprint.
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp"), F.col("fp").cast("string")))
    own, kept_id, kept_key = (spare_name(df, n) for n in ("row_key", "kept_id", "kept_key"))
    kept = classes.groupBy(group.alias("g")).agg(F.min(mine).alias("m")).select(F.col("m.doc_id").alias(kept_id), F.col("m.row_key").alias(kept_key))
    rows = df.withColumn(own, F.xxhash64(doc_id, text))
    out = rows.join(kept, F.col(f"`{doc_id}`").eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(kept_key)), "left_semi")
    return out.dropDuplicates([doc_id, own]).drop(own)
