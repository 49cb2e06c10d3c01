"""Every stage of the pipeline against plain Python, on ordinary rows, on odd ones and on none."""

import hashlib
import random
import re
from collections import Counter

import pytest

from tracesheaf.llm import bpe, mixing, nearcopies, pii, queries, simhash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages():
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    lexicon = {x: ["".join(rng.choice(c) for _ in range(rng.randint(3, 8))) for _ in range(60)] for x, c in {"aa": "abcdefgh", "bb": "mnopqrst"}.items()}
    out = []
    for i in range(120):
        lang = rng.choice(["aa", "bb"])
        words = [rng.choice(lexicon[lang]) for _ in range(rng.randint(6, 60))]
        out.append((i, " ".join(words), lang, rng.choice(["s1", "s2", None])))
        if i % 5 == 0:  # a near copy
            words[rng.randrange(len(words))] = "changed"
            out.append((1000 + i, " ".join(words), lang, "s1"))
    out += [(2000, "mail anna@corp.org or call +49 (0) 123 4567 " + out[0][1], out[0][2], "s1"), (2001, out[3][1], out[3][2], "s2")]
    odd = [(3000, None, None, None), (3001, "", "aa", "s1"), (3002, "123 ½ !!!", "aa", "s1"), (None, out[7][1] + " more", "aa", "s2"), (None, None, None, None), (3003, out[9][1], None, None), (3003, out[9][1], None, None), (3004, "abc " * 9000, "aa", "s2")]
    return [(i, t, x, s, None if t is None else len(t)) for i, t, x, s in out + odd]


def test_languages(spark, stages, rows):
    kept = stages["languages"](spark, spark.createDataFrame(rows, COLUMNS), None).collect()
    want = Counter((i, t) for i, t, *_ in rows if re.search("[a-z]", t or ""))
    assert Counter((r.doc_id, r.text) for r in kept) == want
    true = {i: x for i, _, x, *_ in rows if x}
    wrong = {r.doc_id for r in kept if r.doc_id in true and r.lang != true[r.doc_id]}
    assert wrong <= {3004}, wrong  # one word that no text teaches
    assert stages["languages"](spark, spark.createDataFrame([], COLUMNS), None).count() == 0


def test_near_duplicates(spark, stages, rows):
    sets = [frozenset(nearcopies.shingle_set(t).tolist()) for _, t, *_ in rows]
    parent = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                parent[simhash._find(parent, i)] = simhash._find(parent, j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(simhash._find(parent, i), []).append((r[0] is None, r[0] or 0))
    kept = stages["near_duplicates"](spark, spark.createDataFrame(rows, COLUMNS), None).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == sorted(min(g) for g in groups.values())
    assert stages["near_duplicates"](spark, spark.createDataFrame([], COLUMNS), None).count() == 0


def test_personal_data(spark, stages, rows):
    df = spark.createDataFrame(rows, COLUMNS)
    spans = {(r.doc_id, r.text): r.pii for r in pii.find_spans(df).collect()}
    got = stages["personal_data"](spark, df, None).collect()
    want = []
    for i, t, x, s, n in rows:
        out, at = "", 0
        for c in sorted(spans[i, t], key=lambda c: (c.start, c.end)):
            if c.start >= at:
                out += t[at : c.start] + f"[{c.kind.upper()}]"
            at = max(at, c.end)
        new = out + t[at:] if at else t
        want.append((i, new, x, s, len(new) if at else n))
    assert Counter(map(tuple, got)) == Counter(want)
    assert any(r.doc_id == 2000 and r.text.startswith("mail [EMAIL] or call [PHONE] ") for r in got)


def test_mixture(spark, stages, rows):
    df = spark.createDataFrame(rows, COLUMNS)
    copies = Counter()
    for r in mixing.mix(df).collect():
        copies[r.doc_id, r.source] += r.copies
    got = Counter((r.doc_id, r.source) for r in stages["mixture"](spark, df, None).collect())
    assert got == +copies


def test_tokens(spark, stages, rows):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.tokenizer_path())
    got = stages["tokens"](spark, spark.createDataFrame(rows, COLUMNS), None).collect()
    want = Counter()
    for i, t, x, s, _ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        want[i, x, s, len(ids), len(back), hashlib.sha256(back.encode()).hexdigest(), tuple(ids)] += 1
    assert Counter((r.doc_id, r.lang, r.source, r.n_tokens, r.n_decoded, r.decoded_sha256, tuple(r.ids)) for r in got) == want
    assert bpe.encode(spark.createDataFrame([], COLUMNS), queries.tokenizer_path()).count() == 0
