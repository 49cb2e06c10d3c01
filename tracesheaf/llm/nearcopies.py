"""Near copies by SimHash where links lie beyond a small radius: BK-trees in shards, then an exact check.

Documents whose sets of five-word shingles have a similarity of 0.8 differ in about ten of 64 bits and in up to twenty, and a search
of that radius over all fingerprints prunes nothing. So shards hold what shares content: a document goes to one shard
for each of BANDS keys, a key being made of ROWS minima of its shingle hashes. Within a shard a BK-tree of SimHash fingerprints finds the
candidates within RADIUS, and only a spanning forest of them leaves the shard: it joins documents to families. A pair at 0.8 shares
no shard with a probability of 2e-4 and lies beyond the radius with about 5e-5; sets of up to SMALL shingles are held against all of their shard.

The exact check runs once for each family, on whole shingle sets, where the family lies. A family above BLOCK is cut into blocks by hash: a block
finds its groups, and then the sets of several blocks meet where they share a rare shingle, which loses no pair. Texts of one template that are no near copies
share none, and meet nowhere. Of the check only group names or a spanning forest leave a task. Equal sets are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesheaf.llm.common import connected_components, spare_name, text_batches, written
from tracesheaf.llm.simhash import BKTree, _find, majority, shingle_hashes

WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 16, 4
#: Search radius in bits; sets of so few shingles are compared without it; nodes of one tree: a larger shard is one family without a search.
RADIUS, SMALL, TREE_NODES = 22, 16, 2048
#: Weight of a block of the exact check: shingles, and NODE for each set.
BLOCK, NODE = 1 << 18, 64
#: Members of families whose ids (24 bytes each) may be broadcast to pick their texts; beyond it the texts are shuffled.
BROADCAST_ROWS = 500_000
_FACTORS = np.array([xxhash.xxh64_intdigest(str(i)) | 1 for i in range(BANDS * ROWS)], np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys (int64) of a set of hashes; none of an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    low = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 4096):
        low = np.minimum(low, (hashes[None, i : i + 4096] * _FACTORS[:, None]).min(axis=1))
    key = np.zeros(BANDS, np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        key = (key ^ column) * _BASE
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def set_id(hashes: np.ndarray) -> int:
    """64-bit id of a set: equal sets have equal ids. Among ten thousand million sets about three pairs share one by chance."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).astype(np.int64))


def _sketch(words: int):
    @F.arrow_udf("struct<sid:bigint,fp:bigint,n:int,keys:array<bigint>>")
    def sketch(texts: pa.Array) -> pa.Array:
        sets = [shingle_set(t.as_py(), words) for t in texts]
        keys = pa.array([band_keys(h) for h in sets], pa.list_(pa.int64()))
        fps = pa.array(np.array([majority(h) for h in sets], np.uint64).astype(np.int64))
        ids, sizes = pa.array([set_id(h) for h in sets], pa.int64()), pa.array([len(h) for h in sets], pa.int32())
        return pa.StructArray.from_arrays([ids, fps, sizes, keys], ["sid", "fp", "n", "keys"])

    return sketch


def _sets(words: int):
    @F.arrow_udf("array<bigint>")
    def sets(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set(t.as_py(), words).view(np.int64) for t in texts], pa.list_(pa.int64()))

    return sets


def shard_forest(fp: list[int], n: list[int], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """A spanning forest, as (index, index), of the candidate pairs of a shard: within the radius and near enough in size."""
    tree, parent = BKTree(), list(range(len(fp)))
    for i, v in enumerate(fp):
        for k in tree.within(v, 64 if 4 * n[i] <= 5 * SMALL else RADIUS):
            if min(n[i], n[k]) >= similarity * max(n[i], n[k]):
                a, b = _find(parent, i), _find(parent, k)
                parent[max(a, b)] = min(a, b)
        tree.add(v)
    return [(i, r) for i in range(len(fp)) if (r := _find(parent, i)) != i]


def _candidates(shards: DataFrame, similarity: float) -> DataFrame:
    """(a, b) links among the nodes of ``shards`` (t, k, sid, fp, n) that together join what a shard's candidates join."""
    counts = shards.groupBy("t", "k").agg(F.count("*").alias("c"), F.min("sid").alias("b"))
    hot = written(counts.where(F.col("c") > TREE_NODES).drop("c"), "hot")
    whole = shards.join(hot, ["t", "k"]).select(F.col("sid").alias("a"), "b")
    dealt = shards.join(hot, ["t", "k"], "left_anti").repartition("t", "k").sortWithinPartitions("t", "k", "sid").select("t", "k", "sid", "fp", "n")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for b in batches:
            waiting = b if waiting is None else pa.Table.from_batches([waiting, b]).combine_chunks().to_batches()[0]
            t, k = waiting.column(0).to_numpy(), waiting.column(1).to_numpy()
            edge = np.flatnonzero((np.diff(t) != 0) | (np.diff(k) != 0)) + 1
            if len(edge):  # the last shard may go on in the next batch
                yield from links(waiting.slice(0, int(edge[-1])), edge)
                waiting = waiting.slice(int(edge[-1]))
        if waiting is not None and waiting.num_rows > 1:
            yield from links(waiting, np.array([waiting.num_rows]))

    def links(rows: pa.RecordBatch, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        sid, fp, n = (rows.column(i).to_numpy() for i in (2, 3, 4))
        begins = np.concatenate([[0], ends[:-1]])
        several = ends - begins > 1
        a, b = [], []
        for s, e in zip(begins[several].tolist(), ends[several].tolist()):
            for i, r in shard_forest(fp[s:e].astype(np.uint64).tolist(), n[s:e].tolist(), similarity):
                a.append(sid[s + i])
                b.append(sid[s + r])
        if a:
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(search, "a long, b long").union(whole)


class _Block:
    """Shingle sets of one block with their groups; ``shared`` counts what a set has in common with each of them."""

    def __init__(self, sets: list[np.ndarray]):
        self.words, self.ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.sizes = np.array([len(s) for s in sets])
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.mark = np.zeros(len(self.words), bool)

    def similar(self, h: np.ndarray, similarity: float, upto: int | None = None) -> np.ndarray:
        """Indexes (below ``upto``) of the sets that reach ``similarity`` with ``h``."""
        upto = len(self.sizes) if upto is None else upto
        if not upto:
            return np.zeros(0, np.int64)
        at = np.searchsorted(self.words, h)
        at = at[self.words[np.minimum(at, len(self.words) - 1)] == h]
        self.mark[at] = True
        end = int(self.begins[upto - 1] + self.sizes[upto - 1])
        shared = np.add.reduceat(self.mark[self.ids[:end]], self.begins[:upto], dtype=np.int64)
        self.mark[at] = False
        return np.flatnonzero(shared >= similarity * (len(h) + self.sizes[:upto] - shared))


def groups_within(sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[int]:
    """For each set (not empty) the first index of its group: single linkage at ``similarity``, exact."""
    block, parent = _Block(sets), list(range(len(sets)))
    for i, h in enumerate(sets):
        for k in block.similar(h, similarity, i).tolist():
            a, b = _find(parent, i), _find(parent, k)
            parent[max(a, b)] = min(a, b)
    return [_find(parent, i) for i in range(len(sets))]


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple]:
    """Consecutive rows that agree on the first ``width`` columns, as (key, iterator of the other columns); lists come as arrays."""
    rows = (r for b in batches for r in zip(*([x.values.to_numpy() for x in c] if pa.types.is_list(c.type) else c.to_pylist() for c in b.columns)))
    return groupby(rows, key=lambda r: r[:width])


def _inside(members: DataFrame, similarity: float) -> DataFrame:
    """(sid, root): the groups within each block of ``members`` (family, block, sid, h)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, run in _runs(batches, 2):
            sid, sets = zip(*(r[2:] for r in run))
            root = [sid[r] for r in groups_within(sets, similarity)] if len(sid) > 1 else sid
            yield pa.record_batch([pa.array(sid, pa.int64()), pa.array(root, pa.int64())], names=["sid", "root"])

    dealt = members.repartition("family", "block").sortWithinPartitions("family", "block", "sid").select("family", "block", "sid", "h")
    return dealt.mapInArrow(work, "sid long, root long")


def _meetings(members: DataFrame, similarity: float) -> DataFrame:
    """(a, b), group names: links of the sets that meet at each place. ``members``: (place, part, guest, sid, root, h).

    Sets that are no guests are held, and linked among each other; guests pass by them one at a time.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, run in _runs(batches, 2):
            names, sets, block, known, links = [], [], None, {}, []

            def link(x: int, y: int) -> None:
                x, y = _root(known, x), _root(known, y)  # noqa: B023
                if x != y:
                    known[max(x, y)] = min(x, y)  # noqa: B023
                    links.append((x, y))  # noqa: B023

            for guest, _, root, h in (r[2:] for r in run):
                if not guest:  # these come first
                    names.append(root)
                    sets.append(h)
                    continue
                block = block or (_Block(sets) if sets else None)
                for k in block.similar(h, similarity).tolist() if block else ():
                    link(root, names[k])
            if len(set(names)) > 1:
                for i, r in enumerate(groups_within(sets, similarity)):
                    link(names[i], names[r])
            if links:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*links)], names=["a", "b"])

    order = ["place", "part", "guest", "sid"]
    return members.repartition("place", "part").sortWithinPartitions(*order).select(*order, "root", "h").mapInArrow(work, "a long, b long")


def _root(known: dict[int, int], v: int) -> int:
    while known.get(v, v) != v:
        v = known[v]
    return v


def _shingle_sets(ends: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """``ends`` (sid, family, block, id, key) with h in place of id and key, from the one pass over ``texts`` (doc_id, row_key, text)."""
    small = ends.count() <= BROADCAST_ROWS
    same = F.coalesce(F.col("doc_id") == F.col("id"), F.col("doc_id").isNull() & F.col("id").isNull())
    body = texts.join(F.broadcast(ends) if small else ends, (F.col("row_key") == F.col("key")) & same)
    return written(body.select("family", "block", "sid", _sets(words)("text").alias("h")).dropDuplicates(["family", "block", "sid"]), "sets")


def _prefixes(large: DataFrame, similarity: float) -> DataFrame:
    """(place, sid, c): the rarest shingles of each set of ``large`` (family, sid, root, h) that other sets of its family hold too.

    Of two sets at ``similarity`` each has one of its n - ceil(similarity n) + 1 first shingles, in any one order of all, in common with those of the
    other. In the order of how many sets hold them (c) the shingles that all texts of a template share come last, and a text's own are held by no other set.
    """
    rows = large.select("family", "sid", F.size("h").alias("n"), F.explode("h").alias("s"))
    counts = rows.groupBy("family", "s").agg(F.count("*").alias("c"))
    order = F.array_sort(F.collect_list(F.struct("c", "s")))
    first = F.slice("o", F.lit(1), F.col("n") - F.ceil(F.col("n") * F.lit(similarity) - F.lit(1e-9)).cast("int") + 1)
    ranked = rows.join(counts, ["family", "s"]).groupBy("family", "sid", "n").agg(order.alias("o"))
    held = ranked.select("family", "sid", F.explode(F.filter(first, lambda x: x["c"] > 1)).alias("x"))
    return written(held.select(F.xxhash64("family", "x.s").alias("place"), "sid", F.col("x.c").alias("c")), "prefixes")


def _several(at: DataFrame) -> DataFrame:
    """(place, most, parts) of the places of ``at`` (place, sid, root, n) where sets of several groups meet: the group with most sets, and over how many parts the others' sets are held."""
    each = at.groupBy("place", "root").agg(F.count("*").alias("k"), F.sum(F.col("n") + NODE).alias("w"))
    place = each.groupBy("place").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("k", "root")).alias("most"), F.sum("w").alias("w"), F.max(F.struct("k", "root", "w")).alias("m"))
    return place.where("roots > 1").select("place", "most", F.greatest(F.lit(1), F.ceil((F.col("w") - F.col("m.w")) / BLOCK)).cast("int").alias("parts"))


def _groups(members: DataFrame, cut: DataFrame, similarity: float) -> DataFrame:
    """(sid, group) of ``members`` (family, block, sid, h); ``cut``: (family, blocks) of the families that have several.

    Sets of several blocks meet where they share a rare shingle: first each set at one place, which joins most groups, then, at the places where
    groups are still apart, all sets of the smaller ones and, as guests, those of the largest.
    """
    inside = written(_inside(members, similarity), "inside")
    if not cut.head(1):
        return inside.withColumnRenamed("root", "group")
    large = written(members.join(cut.select("family"), "family").join(inside, "sid").select("family", "sid", "root", "h"), "large")
    prefixes = _prefixes(large, similarity)
    held = large.select("sid", "root", F.size("h").alias("n"))
    part = lambda of: F.pmod(F.xxhash64("sid", F.lit(1)), of).cast("int")  # noqa: E731  not the hash of blocks: parts mix them

    at = prefixes.join(held, "sid")
    one = at.join(_several(at).select("place"), "place").groupBy("sid").agg(F.min(F.struct("c", "place")).alias("m")).select("sid", F.col("m.place").alias("place"))
    weights = one.join(held, "sid").groupBy("place").agg(F.ceil(F.sum(F.col("n") + NODE) / BLOCK).cast("int").alias("parts"))
    met = one.join(weights, "place").join(large, "sid").select("place", part(F.col("parts")).alias("part"), F.lit(False).alias("guest"), "sid", "root", "h")
    links = written(_meetings(met, similarity), "links")
    roots = written(connected_components(links).withColumnRenamed("node", "old"), "roots")
    renamed = lambda df: df.withColumnRenamed("root", "old").join(roots, "old", "left").withColumn("root", F.coalesce("root", "old")).drop("old")

    at = renamed(prefixes.join(held, "sid"))
    apart = at.join(_several(at), "place").select("place", "sid", "parts", (F.col("root") == F.col("most")).alias("big"))
    to = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(o.alias("part"), (F.col("big") | (o != part(F.col("parts")))).alias("guest")))
    met = apart.select("place", "sid", F.explode(to).alias("t")).join(renamed(large), "sid").select("place", "t.part", "t.guest", "sid", "root", "h")
    joined = connected_components(links.union(_meetings(met, similarity))).withColumnsRenamed({"root": "group", "node": "root"})
    return inside.join(joined, "root", "left").select("sid", F.coalesce("group", "root").alias("group"))


def near_copies(df: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, row_key, group) for every row of ``df``: rows are of one group if links of at least ``similarity`` connect them.

    The similarity is that of the sets of word shingles of whole texts, A-Z lower-cased (fewer words: the whole sequence). Null, empty and
    word-free texts form one group. Equal texts always meet; repeated rows stay rows; an empty table gives no rows.
    row_key is a 64-bit hash of id and text. ``similarity`` under 0.8 lowers the share of pairs that meet in a shard. Lowers the session's Arrow batch limits.
    """
    text_batches(df.sparkSession)
    key = F.xxhash64(doc_id, text)
    rows = df.select(F.col(doc_id).alias("doc_id"), key.alias("row_key"), _sketch(words)(F.col(text)).alias("s"))
    rows = written(rows.select("doc_id", "row_key", "s.*"), "sketches")
    place = F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("id"), F.col("row_key").alias("key")))
    nodes = written(rows.groupBy("sid").agg(place.alias("p"), *[F.first(c).alias(c) for c in ("fp", "n", "keys")]), "nodes")
    texts = df.select(F.col(doc_id).alias("doc_id"), key.alias("row_key"), F.col(text).alias("text"))

    shards = nodes.select("sid", "fp", "n", F.posexplode("keys").alias("t", "k"))
    families = written(connected_components(_candidates(shards, similarity)).withColumnsRenamed({"node": "sid", "root": "family"}), "families")
    named = families.join(nodes.select("sid", "n", "p.id", "p.key"), "sid")
    weights = named.groupBy("family").agg(F.sum(F.col("n") + NODE).alias("w"))
    cut = written(weights.where(F.col("w") > BLOCK).select("family", F.ceil(F.col("w") / BLOCK).cast("int").alias("blocks")), "cut")
    block = F.pmod(F.xxhash64("sid"), F.coalesce("blocks", F.lit(1))).cast("int")
    ends = written(named.join(cut, "family", "left").select("sid", "family", block.alias("block"), "id", "key"), "ends")
    groups = _groups(_shingle_sets(ends, texts, words), cut, similarity)
    return rows.join(groups, "sid", "left").select("doc_id", "row_key", F.coalesce("group", "sid").alias("group"))


def keep_one(df: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``df`` with one row of each group of ``near_copies``: that with the smallest (doc_id, row_key), null ids last; repeats of that row go too.

    All columns stay, whatever their names, and no others come.
    """
    mine = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row_key")
    kept = near_copies(df, text, doc_id, words, similarity).groupBy("group").agg(F.min(mine).alias("m"))
    own, kept_id, kept_key = (spare_name(df, n) for n in ("row_key", "kept_id", "kept_key"))
    kept = kept.select(F.col("m.doc_id").alias(kept_id), F.col("m.row_key").alias(kept_key))
    rows = df.withColumn(own, F.xxhash64(doc_id, text))
    # Joined on the hash, which covers the id, so that dropping repeats needs no second exchange of the texts.
    same = F.coalesce(F.col(f"`{doc_id}`") == F.col(kept_id), F.col(f"`{doc_id}`").isNull() & F.col(kept_id).isNull())
    out = rows.join(kept, (F.col(own) == F.col(kept_key)) & same, "left_semi")
    return out.dropDuplicates([doc_id, own]).drop(own)
