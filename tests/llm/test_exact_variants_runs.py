"""Exact dedup, spelling variants and periodic runs against brute force, and on odd input."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tracesheaf.llm import exactdedup, queries, runs, variants

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, tag string, ids string, digests string, word string, n long, c string, p string, periodic string, kept string, keep_id string, sha string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeats, and columns named like those that the operators make."""
    long = "lorem ipsum dolor sit amet " * 6000
    rows = [(1, None), (2, ""), (3, "Once Ago the same"), (3, "Once Ago the same"), (None, "once ago THE same"), (4, long), (5, long.upper()), (6, "x" * 70_000), (7, "X" * 70_000), (None, None), (8, "École   É"), (9, "école   é"), (10, "école   É"), (None, "alone"), (None, "ALONE")]
    return spark.createDataFrame([(i, t, *["k"] * 2, 1, *["k"] * 4, 2, *["k"] * 6) for i, t in rows], DOCS)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def check_classes(rows, got):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    assert len(got) == len(rows)
    kept = Counter()
    for (i, t), r in zip(sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, lower(x[1]))), sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text))):
        ids = groups[lower(t)]
        best = max((x for x in ids if x is not None), default=None)
        assert (r.doc_id, r.keep_id, r.group_size, r.text_sha256) == (i, best, len(ids), hashlib.sha256(lower(t).encode()).hexdigest())
        assert not r.kept or r.doc_id == best
        kept[lower(t)] += r.kept
    assert set(kept.values()) == {1}


@pytest.mark.parametrize("identify", [F.xxhash64, F.char_length, lambda c: F.lit(7)])
def test_exact_dedup_equals_brute_force(spark, odd, identify):
    """Also with identifiers that stand for many chunks: they are found out, and texts that hold them are told apart all the same."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.choice([2, 3, 3, 5]))) for _ in range(60)]
    bases = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 50, 900]))) for _ in range(25)]
    rows = [(i, rng.choice([str.upper, str.title, str])(rng.choice(bases)) + rng.choice(["", "", "", "!"])) for i in range(300)]
    rows += [(r.doc_id, r.text) for r in odd.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = exactdedup.classes(df, identify=identify)
    texts = {hashlib.sha256(lower(t).encode()).hexdigest(): lower(t) for _, t in rows}
    got = [type("R", (), {**r.asDict(), "text": texts[r.text_sha256]}) for r in found.collect()]
    check_classes(rows, got)


def test_hot_copies_meet_by_broadcast_or_shuffle(spark, monkeypatch):
    rows = [(i, "one text of many" if i % 3 else f"text {i % 50}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for share in (1, 3, 10**6):
        monkeypatch.setattr(exactdedup, "HOT_SHARE", share)
        got = exactdedup.classes(df).collect()
        assert sum(r.kept for r in got) == len({t for _, t in rows}) and all(r.group_size == sum(t == x for _, x in rows) for r in got[:20] for t in [dict(rows)[r.doc_id]])


def test_exact_dedup_of_odd_rows(spark, odd):
    kept = exactdedup.keep_one(odd)
    assert kept.columns == odd.columns
    got = sorted((lower(r.text), r.doc_id or 0) for r in kept.collect())
    want = defaultdict(int)
    for r in odd.collect():
        want[lower(r.text)] = max(want[lower(r.text)], r.doc_id or 0)
    assert got == sorted(want.items())
    assert exactdedup.classes(odd.limit(0)).count() == 0 and exactdedup.keep_one(odd.limit(0)).count() == 0


def test_chunks_join_to_the_text_and_follow_its_content(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghiklmnoprst") for _ in range(rng.randint(2, 5))) for _ in range(400)]
    text = " ".join(rng.choice(words) for _ in range(20_000))
    texts = [text, "Changed at the front. " + text, "x" * 20_000, "😀é" * 9000, "a\nb\r\n" * 5000, ""]
    cut = [r.c for r in spark.createDataFrame([(t,) for t in texts], "text string").select(exactdedup.chunks(F.col("text")).alias("c")).collect()]
    assert ["".join(c) for c in cut] == texts and max(len(x) for c in cut for x in c) <= exactdedup.MAX_CHARS + 5
    assert len(set(cut[0]) & set(cut[1])) > 0.9 * len(cut[0])


def edits(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b))
    a, b = sorted((a, b), key=len)
    return 1 if len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b))) else 2


def plain_variants(counts):
    near = defaultdict(list)
    for a, b in combinations(counts, 2):
        if edits(a, b) == 1:
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w in counts:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 5 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


@pytest.mark.parametrize("alphabet", ["ab", "abc", "abcdefghijklmnopqrstéÿÀ"])
def test_variants_equal_brute_force(spark, alphabet):
    rng = random.Random(3)
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(6, 9))) for _ in range(40)]
    counts = Counter()
    for w in base:
        counts[w] += rng.choice([5, 30, 200, 1000])
        for _ in range(6):
            k, x = rng.randrange(len(w)), rng.choice(alphabet)
            v = rng.choice([w[:k] + w[k + 1 :], w[:k] + x + w[k:], w[:k] + x + w[k + 1 :], w[:k] + w[k : k + 2][::-1] + w[k + 2 :]])
            counts[v] += rng.choice([1, 4, 5, 6, 40])
    rows = [(w,) for w, n in counts.items() for _ in range(n)] + [(None,), ("short",), ("",)]
    got = variants.group_variants(spark.createDataFrame(rows, "word string").withColumn("n", F.lit("x"))).collect()
    want = plain_variants({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5})
    assert sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got) == want


def test_pivots_are_disjoint_and_rarest():
    rng = random.Random(4)
    for _ in range(300):
        grams = sorted((p, rng.randint(1, 9)) for p in rng.sample(range(12), rng.randint(3, 6)))
        got = variants.choose_pivots(grams)
        weight = dict(grams)
        want = min(weight[a] + weight[b] for a, b in combinations(sorted(weight), 2) if b - a >= 2)
        assert got[1] - got[0] >= 2 and weight[got[0]] + weight[got[1]] == want


def slips(rows):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def test_op12_equals_brute_force(spark, sf, odd):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    counts = slips(rows)
    if len(counts) < 6000:
        got = queries.op12_variants(spark, sf).collect()
        assert sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got) == plain_variants(counts) and any(r.form for r in got)
    got = variants.group_variants(queries.typed_with_slips(odd)).collect()
    assert sorted((r.word, r.n) for r in got) == sorted(slips([(r.doc_id, r.text) for r in odd.collect()]).items())
    assert variants.group_variants(queries.typed_with_slips(odd.limit(0))).count() == 0
    with pytest.raises(ValueError):
        variants.group_variants(odd, ratio=1)


def plain_runs(words, least=6, periods=4):
    found = []
    for q in range(1, len(words) // periods + 1):
        i = 0
        while i < len(words) - q:
            s = i
            while i < len(words) - q and words[i] == words[i + q]:
                i += 1
            stretch = words[s : i + q]
            if i > s and len(stretch) >= max(least, periods * q) and not any(stretch[r:] == stretch[:-r] for r in range(1, q)):
                found.append((s, len(stretch), q))
            i += i == s
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_collapse(words, found):
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def test_runs_equal_brute_force(spark, odd):
    rng = random.Random(5)
    texts = ["a " * n for n in range(9)] + ["a b " * 4, "x " + "a b " * 4 + "a", "a a b " * 4 + "a b"]
    for _ in range(500):
        parts = []
        for _ in range(rng.randint(1, 5)):
            unit = [rng.choice("ab" if rng.random() < 0.5 else "abcdefé") for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 40]))]
            parts += [unit[i % len(unit)] for i in range(rng.randint(1, 7 * len(unit)))]
        texts.append(rng.choice([" ", "\n", "\x0b \t"]).join(parts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    for r in runs.find_runs(df).collect():
        words = WORD.findall(r.text or "")
        want = plain_runs(words) if len(words) < 5000 else [(0, 30_000, 5)]
        assert [tuple(x) for x in r.periodic.runs] == want and r.periodic.n_words == len(words), r.text
        assert r.periodic.collapsed == plain_collapse(words, want)
    got = runs.find_runs(odd)
    assert sorted(got.columns) == sorted(odd.columns) and got.count() == odd.count() and runs.find_runs(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.find(runs.np.zeros(9, int), runs.np.array([0, 9]), min_periods=3)


def test_op13_equals_brute_force(spark, sf):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    seen = 0
    for r in queries.op13_runs(spark, sf).collect():
        words = WORD.findall(rows[r.doc_id] or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        found = plain_runs(words)
        top = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        milli = 1000 * top[1] // top[2] if found else None
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want = (len(found), *top, milli, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(plain_collapse(words, found)))
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == want
        seen += bool(found)
    assert seen
