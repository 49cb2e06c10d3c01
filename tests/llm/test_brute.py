"""Operators that SQL does not express, against plain brute-force versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tracesheaf.llm import langid, mixing, pii, quality, simhash, syncmers, topk, urlfilter, warc

WORDS = "the order of many things was here and then some more text about it".split()


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_bit_by_bit(spark):
    rng = random.Random(1)
    texts = [None, "", " \n", "One", "ONE", "one two", "one two three four", "a b c d e", "É É É é", "x\x0by z\x1cw \x85v \xa0u"]
    texts += [" ".join(rng.choice(WORDS) for _ in range(n)) for n in range(1, 60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in simhash.near_duplicates(df).collect():
        assert r.fp & (1 << 64) - 1 == plain_simhash(texts[r.doc_id]), texts[r.doc_id]


def test_mix_is_the_optimum(spark):
    """The rates of every source against bisection on its own dual, document by document."""
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 300)), f"s{i % 4}") for i in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    for _, g in got.groupby("source"):
        size, target = g["size"].to_numpy(float), g.target.iloc[0]
        u = size / (size.sum() / len(size))
        rate = lambda t: 3 / (1 + 2 * np.exp(np.minimum(700, -t * u)))
        if target >= 3 * size.sum() - 1e-9:
            want = np.full(len(size), 3.0)
        else:
            lo, hi = -4096.0, 4096.0
            for _ in range(200):
                t = (lo + hi) / 2
                lo, hi = (t, hi) if (size * rate(t)).sum() < target else (lo, t)
            want = rate(t)
        some = size > 0
        assert np.allclose(g.rate.to_numpy()[some], want[some], atol=2e-3) and (g.copies.to_numpy() <= 3).all()


def test_quality_table_sums(spark):
    """Scores against a sum of table entries, one row and one feature at a time."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 80))) if i % 2 else "###$$$ %%% ||| " * rng.randint(1, 9)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.train(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("quality")))
    x = [quality.features(t) for _, t in rows]
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    for (i, _), row in zip(rows, x):
        assert math.isclose(got[i], plain_score(model, row), rel_tol=1e-9, abs_tol=1e-12)


def plain_score(model, row):
    bins = [sum(v >= e for e in edges) for edges, v in zip(model.edges, row)]
    s = model.bias + sum(table[b] for table, b in zip(model.tables, bins))
    s += sum(table[bins[i], bins[j]] for (i, j), table in zip(model.pairs, model.pair_tables))
    return 1 / (1 + math.exp(-s))


class PlainLanguages:
    """Word counts and n-gram backoff in dictionaries."""

    def __init__(self, rows):
        words, grams = defaultdict(Counter), defaultdict(Counter)
        for text, lang in rows:
            for w in plain_letters(text):
                words[w][lang] += 1
        for w, c in words.items():
            p = f"^{w}$"
            for k in range(1, 5):
                for i in range(len(p) - k + 1):
                    grams[p[i : i + k]].update(c)
        self.langs = sorted({x for _, x in rows})
        self.words = {w: c for w, c in words.items() if sum(c.values()) >= 2}
        self.grams = {g: c for g, c in grams.items() if sum(c.values()) >= 3}

    def logs(self, table, key, add, among):
        return [math.log((table[key][x] + add) / (sum(table[k][x] for k in among) + add * len(among))) for x in self.langs]

    def of_word(self, w):
        if w in self.words:
            return self.logs(self.words, w, 0.05, list(self.words))
        p = f"^{w}$"
        for k in range(min(4, len(p)), 0, -1):
            found = [p[i : i + k] for i in range(len(p) - k + 1) if p[i : i + k] in self.grams]
            if found:
                among = [g for g in self.grams if len(g) == k]
                return list(np.mean([self.logs(self.grams, g, 0.5, among) for g in found], axis=0))
        return [0.0] * len(self.langs)

    def predict(self, text):
        words = plain_letters(text)
        if not words:
            return "und", 0.0
        s = np.mean([self.of_word(w) for w in words], axis=0)
        p = np.exp(s - s.max())
        return self.langs[int(p.argmax())], p.max() / p.sum()


def plain_letters(text):
    import unicodedata

    return "".join(c if unicodedata.category(c).startswith("L") else " " for c in (text or "").lower()).split()


def test_language_equals_a_plain_scorer(spark):
    rng = random.Random(5)
    lexicon = {x: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(25)] for x, letters in {"aa": "abcde", "bb": "cdefg", "cc": "xyzéß"}.items()}
    lexicon["aa"].append("long" * 15)
    make = lambda x: " ".join(rng.choice(lexicon[x]) for _ in range(rng.randint(1, 9)))
    rows = [(i, make(x), x) for i, x in enumerate(rng.choice(list(lexicon)) for _ in range(90))]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    plain = PlainLanguages([(t, x) for _, t, x in rows])
    for text in [t for _, t, _ in rows[:30]] + ["abcabd unseen", "zzé ßß", "q", "½ ②", "Ⅷ", "a½b", "x1y2", "中文", "longlong" * 9, None, ""]:
        lang, score = model.predict(text)
        want = plain.predict(text)
        assert lang == want[0] and math.isclose(score, want[1], rel_tol=1e-4), text
    for text in ("½", "①②", "Ⅷ ²", "12_34"):
        assert model.predict(text) == ("und", 0.0)


def test_every_language_stays(spark):
    rows = [(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} " * 2, f"l{i % 300:03d}") for i in range(900)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 300


def subsequence(a, b):
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
    return int(best[-1, -1])


def test_positions_of_anchors_count():
    rng = random.Random(6)
    for n in (0, 1, 5, 40, 90):
        a = rng.sample(range(200), n)
        b = [x if rng.random() < 0.6 else rng.randrange(200, 400) for x in a]
        b = list(dict.fromkeys(b[n // 3 :] + b[: n // 3]))
        assert syncmers.matched_in_order(np.array(a, np.uint32), np.array(b, np.uint32)) == subsequence(a, b)
        c = [rng.randrange(6) for _ in range(n)]
        d = [rng.randrange(6) for _ in range(n)]
        both = syncmers.matched_in_order(np.array(c, np.uint32), np.array(d, np.uint32))
        assert both <= subsequence(c, d) and syncmers.matched_in_order(np.array(c, np.uint32), np.array(c, np.uint32)) == n
    parts = ["".join(rng.choice("abcdefghijklmnop") for _ in range(300)) for _ in range(8)]
    straight, mixed = "".join(parts), "".join(parts[::-1])
    assert syncmers.likeness(syncmers.anchors(straight), syncmers.anchors(mixed)) < 0.3


def test_the_edited_text_is_nearer_than_the_next(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(200))[: 20 + i]) for i in range(300)]
    got = syncmers.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string"), partitions=3).collect()
    assert all(r.near_edited > r.near_next for r in got if r.doc_id)


def test_likeness_follows_from_the_fingerprints(spark):
    """Both numbers from the returned strings alone, over texts on either side of every level."""
    rng = random.Random(13)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(500)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(100))[: rng.choice([0, 1, 3, 5, 6, 7, 11, 13, 24, 47, 49, 95, 97, 143, 145, 200, 287, 289, 400])]) for i in range(200)]
    rows += [(200, "word " * 26), (201, "word " * 40), (202, rows[7][1]), (203, rows[7][1])]
    got = sorted(syncmers.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string"), partitions=3).collect(), key=lambda r: -r.doc_id)
    for r, nxt in zip(got, [*got[1:], got[0]]):
        assert r.near_edited == syncmers.fingerprint_likeness(r.fingerprint, r.edited_fingerprint) and r.near_next == syncmers.fingerprint_likeness(r.fingerprint, nxt.fingerprint)
    by = {r.doc_id: r for r in got}
    assert by[203].near_next == 1 and by[201].near_next > 0.5 and sum(r.near_edited > 0.2 for r in got) > 150


def plain_anchors(text, k, s):
    """Closed syncmers of code points, place by place, with the module's own hash of an s-mer."""
    c = [ord(x) for x in text]
    h = [int(syncmers._mix(np.array([_value(c[i : i + s])], np.uint64))[0]) for i in range(len(c) - s + 1)]
    return [i for i in range(len(c) - k + 1) if min(h[i : i + k - s + 1]) in (h[i], h[i + k - s])]


def _value(codes):
    v = 0
    for x in codes:
        v = (v * int(syncmers._BASE) + x) % 2**64
    return v


def test_anchors_are_closed_syncmers():
    rng = random.Random(8)
    for n in (144, 300, 700):
        text = "".join(rng.choice("abcdeé 中") for _ in range(n))
        assert syncmers.level(n) == (syncmers.K, syncmers.S)
        assert len(syncmers.anchors(text)) == len(plain_anchors(text, syncmers.K, syncmers.S))


def plain_em(patterns):
    """EM with tables for each labeler and class, written out."""
    post = [min(0.95, max(0.05, 0.5 + 0.15 * sum(v))) for _, v, _ in patterns]
    kinds, width = sorted({k for k, _, _ in patterns}), len(patterns[0][1])
    for _ in range(pii.EM_ROUNDS):
        prior = {k: [1.0, 1.0] for k in kinds}
        seen = np.full((2, width, 3), 0.5)
        for (k, v, n), p in zip(patterns, post):
            prior[k][0] += n * (1 - p)
            prior[k][1] += n * p
            for j, x in enumerate(v):
                seen[0, j, x + 1] += n * (1 - p)
                seen[1, j, x + 1] += n * p
        share = seen / seen.sum(axis=2, keepdims=True)
        for i, (k, v, _) in enumerate(patterns):
            odds = prior[k][1] / prior[k][0]
            for j, x in enumerate(v):
                odds *= share[1, j, x + 1] / share[0, j, x + 1]
            post[i] = odds / (1 + odds)
    return post


def test_reliabilities_by_em():
    rng = random.Random(9)
    patterns = list({(k, tuple(rng.choice([-1, 0, 1]) for _ in pii.LABELERS)): rng.randint(1, 50) for k in pii.KINDS for _ in range(15)}.items())
    patterns = [(k, v, n) for (k, v), n in patterns]
    got = pii.estimate(patterns)
    for (k, v, _), p in zip(patterns, plain_em(patterns)):
        assert math.isclose(got[k, v], p, rel_tol=1e-6, abs_tol=1e-9)


def card(rng, sep):
    body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    last = next(x for x in "0123456789" if sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(body + x))) % 10 == 0)
    return sep.join((body + last)[i : i + 4] for i in range(0, 16, 4))


def test_further_spans(spark):
    """Texts with known spans: what the base rules miss is found, and serial numbers, versions and failing cards are not."""
    rng = random.Random(10)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    who, where = ["anna", "john.doe", "li.wei", "info"], ["mail", "corp", "example"]
    ip = lambda dot: f"{rng.randint(1, 120)}{dot}{rng.randint(0, 255)}{dot}{rng.randint(0, 255)}{dot}{rng.randint(1, 250)}"
    makers = [
        lambda: ("call ", f"({rng.randint(200, 999)}) {d(3)}-{d(4)}", "phone", False), lambda: ("mail ", f"{rng.choice(who)} (at) {rng.choice(where)} (dot) com", "email", False),
        lambda: ("card ", card(rng, "."), "card", False), lambda: ("host ", ip("[.]"), "ip", False), lambda: ("phone ", f"+49 (0) {d(3)} {d(4)}", "phone", True),
        lambda: ("mail ", f"{rng.choice(who)}@{rng.choice(where)}.org", "email", True), lambda: ("card ", card(rng, " "), "card", True), lambda: ("host ", ip("."), "ip", True),
        lambda: ("isbn ", "978" + d(10), None, None), lambda: ("serial ", f"{d(3)}-{d(3)}-{d(4)}", None, None), lambda: ("version ", f"{rng.randint(300, 900)}.1.2.3", None, None), lambda: ("id ", f"9999 0000 1111 {d(4)}", None, None),
    ]
    rows, want = [], set()
    for i in range(600):
        text = ""
        for _ in range(rng.randint(1, 4)):
            before, span, kind, base = rng.choice(makers)()
            text += " ".join(rng.choice(WORDS) for _ in range(5)) + " " + before
            if kind and not base:
                want.add((i, kind, len(text), len(text) + len(span)))
            text += span + " "
        rows.append((i, text + "end"))
    found = pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(r.doc_id, s.kind, s.start, s.end) for r in found for s in r.pii if not s.base}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)


def test_columns_of_the_caller_stay(spark):
    df = spark.createDataFrame([(1, "mail a@b.de", ["x"], "mine")], "doc_id long, text string, spans array<string>, base string")
    r = pii.find_spans(df).first()
    assert r.spans == ["x"] and r.base == "mine" and r.pii[0].kind == "email"


def test_topk_on_repeats_and_outliers(spark):
    rng = np.random.default_rng(11)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(120)] + [(7, rng.normal(size=6).tolist()), (20, rng.normal(size=6).tolist())]
    rows += [(200, [1e12, 3.0, -1e12, 0.5, 0.25, -7.0]), (201, [1e30] * 6), (203, [-2.5e14, 1.0, 2.0, 3.0, 4.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in topk.topk(df, 20, shard_rows=30, block_rows=4).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    whole = [(i, [math.floor(64 * v) for v in x]) for i, x in rows]
    for q in sorted({i for i, _ in rows if i % 20 == 0}):
        asks = min(x for i, x in whole if i == q)
        clip = lambda s: max(-(2**63), min(2**63 - 1, s))
        best = sorted((-clip(sum(a * b for a, b in zip(asks, x))), i) for i, x in whole if i != q)[:20]
        assert got[q] == [(i, -s) for s, i in best], q


def test_offsets_can_be_sought(spark, tmp_path):
    rows = [(i, f"http://h/{i}", "page " * (i % 40)) for i in range(50)]
    path = f"file://{tmp_path}/warc"
    index = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"), path, compression="none")
    for r in index.collect():
        with open(r.file.removeprefix("file:").replace("///", "/"), "rb") as f:
            f.seek(r.offset)
            record = f.read(r.length)
        assert record.startswith(b"WARC/1.1\r\n") and f"<urn:page:{r.page_id}>".encode() in record
        assert r.record_type == "revisit" or hashlib.sha256(record.split(b"\r\n\r\n", 2)[2][: r.payload_bytes]).hexdigest() == r.payload_digest


def test_a_broken_payload_is_an_error(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "http://h/", "text " * 30)], "page_id long, url string, html string")
    whole = warc.read_index
    monkeypatch.setattr(warc, "read_index", lambda *a: whole(*a).withColumn("verified", F.lit(False)))
    with pytest.raises(Exception, match="payload differs"):
        warc.archive(pages).select("page_id").collect()


def test_long_hosts_match(spark):
    host = ".".join(["a" * 60] * 5) + ".example.com"
    entries = spark.createDataFrame([("example.com", 1, "block")], "pattern string, listed_at long, action string")
    captures = spark.createDataFrame([(1, f"http://{host}/x", 5, "h", 9)], "page_id long, url string, fetched_at long, p string, b int")
    r = urlfilter.evaluate(captures, entries).first()
    assert r.verdict == "block" and r.p == "h" and r.b == 9


def plain_verdict(host, at, entries):
    best = None
    for i in range(len(parts := host.split("."))):
        name = ".".join(parts[i:])
        days = {}
        for p, day, action in entries:
            if p == name and day <= at:
                days.setdefault(day, []).append(action)
        if days and (last := max(days[max(days)])) != "remove":
            best = best or (last, name, max(days))
    return best


def test_url_filter_equals_brute_force(spark):
    rng = random.Random(12)
    names = ["com", "x.com", "a.x.com", "b.x.com", "y.org", "a.y.org"]
    entries = [(rng.choice(names), rng.randrange(-500, 400), rng.choice(["allow", "block", "remove"])) for _ in range(60)]
    rows = [(i, f"https://{rng.choice(['', 'c.', 'a.'])}{rng.choice(names[1:])}/p", rng.randrange(0, 365)) for i in range(400)]
    got = urlfilter.evaluate(spark.createDataFrame(rows, "page_id long, url string, fetched_at long"), spark.createDataFrame(entries, "pattern string, listed_at long, action string"))
    for r in got.collect():
        want = plain_verdict(r.host, r.fetched_at, entries) or ("none", None, None)
        assert (r.verdict, r.pattern, r.valid_from) == want
