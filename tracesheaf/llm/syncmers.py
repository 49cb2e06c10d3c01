"""Document fingerprints from closed syncmers.

A k-mer of code points is kept if the smallest hash among its s-mers lies at its first or last place. The choice
depends on the k-mer alone, so equal passages choose equal anchors wherever they stand. Every passage of 2k - s code points
holds an anchor. Texts whose half may be shorter than that take the next finer k and s of ``LEVELS``, where one anchor of the
whole text goes before the others. The fingerprint lists all anchors of the text in order as 32-bit hashes in hex, after the number of their level,
and for texts of which half may belong to the next level those of that level too. Two fingerprints are compared at the coarsest level that both hold: their
likeness is the share of anchors in the longest chain that stands in the same order in both, and 0 without a common level, where one text is over twice as long.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesheaf.llm.common import text_batches

K, S = 40, 8
#: k and s from coarse to fine; a text takes the first of which each of its halves is sure to hold an anchor.
LEVELS = [(K, S), (16, 8), (4, 2), (2, 1), (1, 1)]
_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MUL
    return h ^ (h >> np.uint64(29))


def _least(i: int) -> int:
    """The code points from which on texts take level ``i``."""
    k, s = LEVELS[i]
    return 2 * (2 * k - s) if i < len(LEVELS) - 1 else 0


def level(n: int) -> tuple[int, int]:
    """k and s for texts of ``n`` code points."""
    return LEVELS[levels(n)[0]]


def levels(n: int) -> list[int]:
    """The levels that a fingerprint of ``n`` code points holds: its own, and the next one where half a text may need it."""
    own = next(i for i in range(len(LEVELS)) if n >= _least(i))
    return [own, own + 1] if n < 2 * _least(own) else [own]


def anchors(text: str, k: int | None = None, s: int | None = None) -> np.ndarray:
    """Anchor hashes (uint32) in order of position, at the text's own level or at k and s; k must be a multiple of s. Only an empty text has none."""
    if k is None or s is None:
        k, s = level(len(text))
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    first = np.zeros(0, np.uint32)
    if len(c) and (k < K or len(c) < k):
        first = np.frombuffer(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=4).digest(), np.uint32)
    if len(c) < k:
        return first
    n, width = len(c) - s + 1, k - s + 1
    h = np.zeros(n, np.uint64)
    for i in range(s):
        h = h * _BASE + c[i : i + n]
    h = _mix(h)
    low, span = h, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    m = n - width + 1
    low = np.minimum(low[:m], low[width - span : width - span + m])
    at = np.flatnonzero((h[:m] == low) | (h[width - 1 :] == low))
    if not len(at) and not len(first):
        at = np.array([low.argmin()])  # a text between k and 2k - s code points without a syncmer
    g = np.zeros(len(at), np.uint64)
    for i in range(0, k, s):
        g = _mix(g * _BASE + h[at + i])
    return np.concatenate([first, (g >> np.uint64(32)).astype(np.uint32)])


def fingerprint(text: str) -> str:
    """``<level>:<anchors in hex>`` for each level of the text, joined by ``|``."""
    return "|".join(f"{i}:{anchors(text, *LEVELS[i]).astype('>u4').tobytes().hex()}" for i in levels(len(text)))


def _turn(a: np.ndarray) -> np.ndarray:
    """For each anchor how many equal ones stand before it."""
    by = np.argsort(a, kind="stable")
    v = a[by]
    begin = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    out = np.empty(len(a), np.int64)
    out[by] = np.arange(len(a)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(a)]])))
    return out


def matched_in_order(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest chain of equal anchors that stand in the same order in both lists.

    Where an anchor repeats, its i-th place from the front meets the i-th of the other list, and so from the back; that keeps the pairs linear.
    Without repeats the chain is the longest common subsequence.
    """
    pairs = []
    for side in (1, -1):
        u, v = a[::side], b[::side]
        key = lambda x: x.astype(np.uint64) << np.uint64(32) | _turn(x).astype(np.uint64)
        _, i, j = np.intersect1d(key(u), key(v), assume_unique=True, return_indices=True)
        pairs.append((i, j) if side == 1 else (len(a) - 1 - i, len(b) - 1 - j))
    i, j = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    ends: list[int] = []  # ends[n]: the earliest place in b at which a chain of n + 1 pairs can end
    for x in j[np.lexsort((-j, i))].tolist():
        at = bisect_left(ends, x)
        ends[at : at + 1] = [x]
    return len(ends)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of anchors that match in order (0 to 1); two empty lists are alike."""
    if not len(a) and not len(b):
        return 1.0
    if len(a) == len(b) and (a == b).all():
        return 1.0
    return 2 * matched_in_order(a, b) / (len(a) + len(b))


def fingerprint_likeness(f: str, g: str) -> float:
    """``likeness`` of two fingerprints at the coarsest level that both hold; 0 without one, 1 for equal ones."""
    if f == g:
        return 1.0
    a, b = ({x[: x.index(":")]: x[x.index(":") + 1 :] for x in v.split("|")} for v in (f, g))
    for i in sorted(a.keys() & b.keys()):
        return likeness(*(np.frombuffer(bytes.fromhex(v[i]), ">u4").astype(np.uint32) for v in (a, b)))
    return 0.0


def edit(text: str, nxt: str) -> str:
    """``text`` with its last half replaced by as many code points from the start of ``nxt``, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + nxt[:half]


def compare_with_next(df: DataFrame, text: str = "text", doc_id: str = "doc_id", partitions: int | None = None) -> DataFrame:
    """Fingerprint every text and compare it with an edited form and with the next document, by descending id.

    Null texts count as empty. Null ids come last; equal ids are ordered by text, descending, and repeated rows follow each
    other. After the last row comes the first; a table of one row is its own next. An empty table gives no rows.

    Rows go once through the network, dealt by ranges of ids; the first row of each range goes to the range before it as
    well, so neighbours always meet within a task. Only one boundary for each range reaches the driver.
    """
    spark = df.sparkSession
    text_batches(spark)
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = partitions or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = df.select(F.percentile_approx(F.col(doc_id).cast("long"), [i / parts for i in range(1, parts)], 100 * parts).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts), reverse=True)
    # Range 0 holds the largest ids; null ids are in the last range.
    bounds = F.lit(cuts).cast("array<bigint>") if cuts else F.array().cast("array<bigint>")
    part = F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(F.size(F.filter(bounds, lambda c: F.col("doc_id") < c)))
    rows = rows.withColumn("part", part)
    ids = df.select(F.col(doc_id).cast("long").alias("doc_id")).withColumn("part", part)
    tops = {r["part"]: r["top"] for r in ids.groupBy("part").agg(F.max("doc_id").alias("top")).collect()}
    filled = sorted(tops)
    if not filled:
        rows = rows.limit(0)
    before = {p: filled[i - 1] for i, p in enumerate(filled)}  # the first range's guest goes to the last
    lookup = F.create_map(*[F.lit(x) for p, b in before.items() for x in (p, b)]) if filled else F.lit(None).cast("map<int,int>")
    top = F.create_map(*[F.lit(x) for p in filled for x in (p, tops[p])]).cast("map<int,bigint>") if filled else F.lit(None).cast("map<int,bigint>")
    is_top = F.col("doc_id").eqNullSafe(F.element_at(top, F.col("part")))
    home = F.struct(F.col("part").alias("to"), F.lit(False).alias("guest"))
    away = F.struct(F.element_at(lookup, F.col("part")).alias("to"), F.lit(True).alias("guest"))
    dealt = rows.withColumn("g", F.explode(F.when(is_top, F.array(home, away)).otherwise(F.array(home))))
    dealt = dealt.select("doc_id", "text", F.col("g.to").alias("to"), F.col("g.guest").alias("guest"))
    dealt = dealt.repartitionById(max(1, len(cuts) + 1), F.col("to")).sortWithinPartitions("to", "guest", F.desc_nulls_last("doc_id"), F.desc("text"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, None  # the row that waits for its next one; the range whose guest has been seen
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                to, guest = batch["to"][i].as_py(), batch["guest"][i].as_py()
                if guest and done == to:
                    continue
                t = batch["text"][i].as_py()
                new = (batch["doc_id"][i].as_py(), t, fingerprint(t))
                if held is not None:
                    e = edit(held[1], t)
                    f = fingerprint(e)
                    out.append((held[0], len(held[1]), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), held[2], f, fingerprint_likeness(held[2], f), fingerprint_likeness(held[2], new[2])))
                held, done = (None, to) if guest else (new, done)
            if out:
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), types)], names=[x.split()[0] for x in schema.split(", ")])

    return dealt.mapInArrow(work, schema)
