"""The corpus operators against plain Python, and on nulls, empty tables, ties, repeats, long texts and clashing names."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracesheaf.llm import bpe, langid, mixing, nearcopies, pii, quality, queries, simhash, syncmers, topk, urlfilter, warc
from tracesheaf.llm.common import connected_components, held_out

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, score string, pii string, copies string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeats, and columns named like outputs."""
    long = "lorem ipsum dolor sit amet " * 6000
    rows = [(1, None, "en", "a"), (2, "", None, "a"), (3, "call +1 (017) 555-7713 now", "en", None), (3, "call +1 (017) 555-7713 now", "en", None), (None, "no id here at all", "fr", "b"), (4, long, "en", "b"), (5, long, "en", "b"), (6, "x" * 70_000, "de", "c"), (7, "... 123 !!!", "de", "c"), (None, None, None, None), (8, "ÉCOLE <|endoftext|> été 😀", "fr", "a")]
    return spark.createDataFrame([(*r, None, "i", "s", "p", "c") for r in rows], DOCS)


def test_bpe_equals_the_library(spark, odd):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    lib, codec = Tokenizer.from_file(path), bpe.codec(path)
    for df in (odd, odd.limit(0)):
        for r in bpe.decode(bpe.encode(df, path, piece_chars=4000), path).collect():
            assert r.ids == lib.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "")
    rng = random.Random(1)
    parts = ["a", "the ", "ing", "  ", "\n", "'s", "'re", "é", "中文", "1", "!", "<|endoftext|>", "<|endof", "text|>", "　", "🙂", "abcabc" * 20]
    for i in range(600):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        assert codec.encode_tree(s, rng.choice([1, 3, 16, 50])).tolist() == lib.encode(s, add_special_tokens=False).ids


def test_mix_meets_targets(spark, odd):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(1, 400)), f"s{i % 7}") for i in range(700)]
    m = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    total = m["size"].sum()
    assert len(m) == 700 and (m["taken"] <= 3 * m["size"]).all()
    g = m.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(g.taken / g.target - 1) < 0.01).all() and abs(g.target.sum() / total - 1) < 1e-9
    assert np.allclose([g.target[f"s{i}"] / g.target["s2"] for i in range(6)], [5, 2, 1, 5, 2, 1])
    again = mixing.mix(odd).toPandas()
    assert len(again) == odd.count() and mixing.mix(odd.limit(0)).count() == 0
    assert sum(r.copies for r in mixing.mix(odd).collect()) == mixing.apply_mix(odd).count()


def test_targets_stop_at_the_cap(spark):
    rows = [(1, "w " * 10, "a"), (2, "w " * 1000, "b"), (3, "w " * 1000, "c")]
    m = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas().set_index("source")
    assert m.target["a"] == 30 and np.isclose(m.target["b"], 1980 * 2 / 3) and np.isclose(m.target["c"], 1980 / 3) and m.taken["a"] == 30


def test_quality_learns_and_scores_everything(spark, odd):
    rows = [(i, "good words in a row of text " * (i % 5 + 1) if i % 2 else "###$$$ %%% ||| ###") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    model = quality.train(docs, labels.where(~held_out("doc_id")))
    got = quality.score(docs, model).collect()
    assert np.mean([(r.score >= 0.5) == bool(r.doc_id % 2) for r in got]) == 1
    assert all(0 <= r.score <= 1 for r in quality.score(odd, model).collect())
    empty = quality.train(docs, labels.limit(0))
    assert quality.score(docs, empty).first().score == 0.5


def test_language(spark, odd, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs.where(~held_out("doc_id")))
    p = docs.where(held_out("doc_id")).select("lang", langid.predict_column(spark, model).alias("p")).select("lang", "p.*").collect()
    assert np.mean([r.lang == r.lang_pred for r in p if r.lang]) > 0.95
    got = {r.doc_id: r.p for r in odd.select("doc_id", langid.predict_column(spark, model).alias("p")).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[7].lang_pred == "und" and got[6].lang_pred != "und"
    assert langid.train(docs.limit(0)).predict("words") == ("und", 0.0)


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-2, 3, 8).astype(float).tolist()) for i in range(300)]
    rows += [(400, None), (401, [1.0, None] + [0.0] * 6), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (None, [1.0] * 8), (20, rows[20][1]), (404, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.topk(df, 20, shard_rows=40, block_rows=8).collect()}
    v = {i: np.floor(64 * np.array(x)) for i, x in rows[:300]}
    for q in range(0, 300, 20):
        best = sorted(((-int(v[q] @ v[c]), c) for c in v if c != q))[:20]
        assert [got[q, k + 1] for k in range(20)] == [(c, -s) for s, c in best]
    assert topk.topk(df.limit(0)).count() == 0
    big = spark.createDataFrame([(0, [1e30]), (1, [1e30]), (2, [-1e30])], "vec_id long, embedding array<double>")
    assert [r.score for r in topk.topk(big).orderBy("rank").collect()] == [2**63 - 1, -(2**63)]


def test_simhash_components(spark, odd):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = sorted({b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(6)} | set(base))
    df = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    roots = {r.node: r.root for r in connected_components(simhash.fingerprint_links(df)).collect()}
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    groups = {}
    for v in values:
        groups.setdefault(find(v), set()).add(roots.get(simhash._signed(v), simhash._signed(v)))
    assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)
    many = list(range(5000))
    links = simhash.shard_links(many, 0, 2)
    assert len({i for i, _ in links}) == len(many) - 1
    c = {r.doc_id: r for r in simhash.near_duplicates(odd).collect()}
    assert c[1].fp == 0 and c[1].component_id == c[2].component_id == 1 and c[5].component_id == 4
    kept = simhash.keep_one(odd)
    assert sorted(r.doc_id or 0 for r in kept.collect()).count(3) == 1 and kept.columns == odd.columns
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


@pytest.mark.parametrize(("nodes", "block"), [(4096, 1 << 18), (40, 1 << 18), (4096, 3000), (40, 1000)])
def test_near_copies_equal_brute_force(spark, odd, monkeypatch, nodes, block):
    """Several templates with copies edited more or less, so that groups hold pairs on either side of the threshold; small trees make shards whole families, small blocks cut families."""
    monkeypatch.setattr(nearcopies, "TREE_NODES", nodes)
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = []
    for size, copies in ((120, 150), (60, 40), (300, 40), (8, 20)):
        template = [word() for _ in range(size)]
        for _ in range(copies):
            own = list(template)
            for _ in range(rng.randint(0, max(1, size // 25))):
                own[rng.randrange(size)] = word()
            texts.append(" ".join(own))
    texts += [" ".join(word() for _ in range(50)) for _ in range(60)] + ["one two", "One TWO ", "", " \n", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [frozenset(nearcopies.shingle_set(t).tolist()) for t in texts]
    parent = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                parent[simhash._find(parent, i)] = simhash._find(parent, j)
    want, got = {}, {}
    for i in range(len(texts)):
        want.setdefault(simhash._find(parent, i), set()).add(i)
    for r in nearcopies.near_copies(df).collect():
        got.setdefault(r.group, set()).add(r.doc_id)
    assert {frozenset(x) for x in got.values()} == {frozenset(x) for x in want.values()}
    kept = nearcopies.keep_one(odd)
    assert sorted(r.doc_id or 0 for r in kept.collect()).count(3) == 1 and kept.columns == odd.columns
    assert nearcopies.near_copies(odd).count() == odd.count() and nearcopies.keep_one(odd.limit(0)).count() == 0


def test_syncmers_follow_the_order(spark, odd):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 200)))) for i in range(60)]
    got = {r.doc_id: r for r in syncmers.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string"), partitions=7).collect()}
    t = dict(rows)
    for i in t:
        nxt, n = t[(i - 1) % 60], len(t[i])
        e = t[i][: n - n // 2] + nxt[: n // 2]
        assert got[i].n_chars == n and got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert got[i].fingerprint == syncmers.fingerprint(t[i]) and 0 <= got[i].near_next <= 1
        assert n < 500 or got[i].near_edited > 0.3 > got[i].near_next
    rows = syncmers.compare_with_next(odd).collect()
    assert len(rows) == odd.count() and len({r.fingerprint for r in rows if r.doc_id in (4, 5)}) == 1
    one = syncmers.compare_with_next(odd.where("doc_id = 8")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert syncmers.compare_with_next(odd.limit(0)).count() == 0


def test_syncmers_of_short_texts(spark):
    rng = random.Random(3)
    # The next text is one code point longer; that of the longest is the empty one.
    rows = [(200 - n, "".join(rng.choice("abcdefghijklmnop éß") for _ in range(n))) for n in range(201)]
    t = dict(rows)
    for r in syncmers.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string"), partitions=3).collect():
        n = len(t[r.doc_id])
        assert (r.fingerprint == "4:") == (n == 0)
        if n > 1:
            assert 0 < r.near_edited < 1 and r.near_next < 1 and r.fingerprint != r.edited_fingerprint, n
    for n in range(2, 400):
        for _ in range(20):
            a, b = ("".join(rng.choice("abcdefghijklmnop") for _ in range(n)) for _ in "ab")
            e = syncmers.edit(a, b[: rng.randint(0, n)])
            got = syncmers.fingerprint_likeness(syncmers.fingerprint(a), syncmers.fingerprint(e))
            assert got == 1.0 if a == e else 0 < got < 1, (a, e)
            assert len(syncmers.anchors(a, syncmers.K, syncmers.S))
    assert syncmers.fingerprint_likeness(*[syncmers.fingerprint("")] * 2) == 1.0
    assert syncmers.fingerprint_likeness(syncmers.fingerprint("a"), syncmers.fingerprint("")) == 0.0


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(re.sub("[^0-9]", "", s)) <= 19 and luhn(re.sub("[^0-9]", "", s))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
]


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(s))) % 10 == 0


def test_pii_base_spans(spark, odd):
    rng = random.Random(8)
    parts = ["a.b@c.de", "x@y", "@", "..", ".", "1.2.3.4", "256.1.1.1", "001.2.3.004", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "+", "12", " ", "-", "a@b..c.d", "é😀", "79927398713", "5", "", "v@w.x.y.z.q"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for i in range(400)]
    rows += [(900, "1 " * 20_000), (901, "a." * 20_000 + "@" + "b." * 20_000 + "c"), (902, "9" * 30_000), (903, "+1" + "(" * 20_000)]
    got = {r.doc_id: r.pii for r in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        if i < 900:
            want = [(k, m.start(), m.end()) for k, p, ok in BASE for m in re.finditer(p, t) if ok(m[0])]
            assert [(s.kind, s.start, s.end) for s in got[i] if s.base] == want, t
    assert [(s.kind, s.start, s.end) for s in got[901]] == [("email", 0, 80_002)]
    found = pii.find_spans(odd)
    assert found.count() == odd.count() and pii.find_spans(odd.limit(0)).count() == 0
    clean = [r.t for r in found.where("doc_id = 3").select(pii.redact(F.col("text"), F.col("pii")).alias("t")).collect()]
    assert clean == ["call [PHONE] now"] * 2


def test_warc_round_trip(spark):
    rows = [(i, f"http://h{i % 3}.example.com/{i}", f"<p>{'page ' * 40}{i % 9}</p>\r\n\r\nWARC/1.1\r\n") for i in range(60)] + [(70, None, None), (71, "http://a/\r\nX: y", ""), (72, "http://a", "short"), (73, "http://a", "short"), (None, "http://b", "é" * 200), (5, "http://dup", "é" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("first", F.lit(2))
    for compression in ("gzip", "none"):
        got = warc.archive(pages, compression=compression).collect()
        assert len(got) == len(rows) and all(r.verified for r in got)
        assert [(r.urlkey, r.ts) for r in got] == sorted((r.urlkey, r.ts) for r in got)
        by = {r.page_id: r for r in got if r.url != "http://dup"}
        assert by[9].record_type == "revisit" and by[9].refers_to == 0 and by[3].record_type == "response"
        assert by[73].record_type == "response" and by[None].record_type == "revisit" and by[None].refers_to == 5
        assert all(by[i].payload_digest == hashlib.sha256((h or "").encode()).hexdigest() and by[i].payload_bytes == len((h or "").encode()) for i, _, h in rows[:-1])
    assert warc.archive(pages.limit(0)).count() == 0
    runs = [sorted(random.Random(k).sample(range(1000), k * 3)) for k in range(7)]
    assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_url_filter(spark):
    entries = spark.createDataFrame([("example.com", 10, "block"), ("example.com", 50, "remove"), ("a.example.com", 20, "allow"), ("a.example.com", 20, "block"), (None, 1, "block"), ("x.org", None, "block")], "pattern string, listed_at long, action string")
    rows = [(1, "http://a.example.com/x", 5), (2, "http://a.example.com:80/x", 15), (3, "https://u@A.Example.com./x", 25), (4, "http://b.example.com", 49), (4, "http://b.example.com", 49), (5, "http://b.example.com", 50), (6, None, 30), (7, "http://example.com", None), (8, "mailto:x", 3)]
    c = spark.createDataFrame(rows, "page_id long, url string, fetched_at long").withColumn("host", F.lit("clash"))
    got = sorted((r.page_id, r.verdict, r.pattern) for r in urlfilter.evaluate(c, entries).collect())
    assert got == [(1, "none", None), (2, "block", "example.com"), (3, "block", "a.example.com"), (4, "block", "example.com"), (4, "block", "example.com"), (5, "none", None), (6, "none", None), (7, "none", None), (8, "none", None)]
    assert urlfilter.evaluate(c.limit(0), entries).count() == 0 and urlfilter.evaluate(c, entries.limit(0)).count() == len(rows)


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at, n = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, sf).persist()
        assert at.columns == corpus_pipeline.COLUMNS
        n.append(at.count())
    assert n[0] <= docs.count() and n[1] <= n[0] and n[2] == n[1]
    assert corpus_pipeline.run(spark, sf).count() == n[3]


def test_pipeline_decodes_its_tokens(spark, sf, odd):
    import corpus_pipeline

    codec = bpe.codec(queries.tokenizer_path())
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    for df in (docs, odd.select(*corpus_pipeline.COLUMNS), docs.limit(0)):
        got = corpus_pipeline.tokens(spark, df, sf)
        texts = [(r.doc_id or 0, r.text or "") for r in df.collect()]
        want = sorted((i, len(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts)
        rows = got.collect()
        assert sorted((r.doc_id or 0, r.n_decoded, r.decoded_sha256) for r in rows) == want
        assert all(r.n_tokens == len(r.ids) and r.n_decoded == len(codec.decode(np.array(r.ids, np.int32))) for r in rows)


def test_names_of_the_caller_may_be_ours(spark):
    """Every name that operators give to columns of their own, held by the caller's table too: all stay with their values."""
    names = ["row_key", "kept_id", "kept_key", "copies", "own_id", "own_key", "row", "n", "text_key", "joined", "piece", "part", "__copies", "__kept_id", "__row", "__row_key", "__bpe_key", "__key", "sha", "kept_sha", "h", "fp", "group", "periodic_", "out"]
    rows = [(i, t, "s", *[f"{n}{i}" for n in names]) for i, t in enumerate(["one two three four", "one two three four", "other words " * 9, "x" * 50])]
    df = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "source string", *[f"`{n}` string" for n in names]]))
    from tracesheaf.llm import exactdedup, runs

    path = queries.tokenizer_path()
    for make in (mixing.apply_mix, simhash.keep_one, nearcopies.keep_one, exactdedup.keep_one, runs.find_runs, lambda d: bpe.encode(d, path, piece_chars=20)):
        got = make(df)
        assert got.columns[: len(df.columns)] == df.columns
        assert all(r[n] == f"{n}{r.doc_id}" for r in got.collect() for n in names)
