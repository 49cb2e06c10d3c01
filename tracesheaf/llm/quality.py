"""Quality classifier: a generalised additive model with pairwise interactions.

Shape functions are lookup tables over feature bins, learnt by cyclic boosting of shallow trees: in each round every
feature in turn gets a tree of at most four leaves on its bins, then chosen pairs get four-quadrant trees.
Scoring adds table entries, vectorised over the rows of a batch.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesheaf.llm.common import text_batches

#: Labelled documents that the model is fitted on at most (those of the smallest id hash), bins, rounds, pairs, rate.
SAMPLE_DOCS, BINS, ROUNDS, PAIRS, RATE = 20_000, 32, 150, 8, 0.1
FEATURES = [
    "log_bytes", "log_words", "word_length", "upper", "digit", "punctuation", "symbol", "pipe", "non_ascii", "distinct_words",
    "distinct_lines", "line_words", "one_letter_words", "long_words", "symbol_words", "sentence_ends", "upper_words", "zip_ratio",
]
_CLASS = np.zeros(256, np.int64)
_CLASS[[*range(65, 91)]] = 1
_CLASS[[*range(97, 123)]] = 2
_CLASS[[*range(48, 58)]] = 3
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 4
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]] = 5
_CLASS[ord("|")] = 6
_CLASS[[9, 10, 11, 12, 13, 32]] = 7
_CLASS[128:] = 8
_SYMBOLS = re.compile(rb"[#$%&*+/<=>@\[\\\]^_`{}~|!]{2}")


def features(text: str | None) -> list[float]:
    """Numeric features of one whole text; null counts as empty and gives zeros where nothing is there to measure."""
    raw = (text or "").encode("utf-8", "replace")
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n, m, k = max(1, len(raw)), max(1, len(words)), max(1, len(lines))
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=9) if raw else np.zeros(9)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    upper = sum(1 for w in words if len(w) > 1 and w.isupper())
    packed = len(zlib.compress(raw, 1)) if raw else 0
    return [
        np.log1p(len(raw)), np.log1p(len(words)), sizes.mean() if len(sizes) else 0.0, kinds[1] / n, kinds[3] / n, kinds[4] / n, kinds[5] / n, kinds[6] / n, kinds[8] / n,
        len(set(words)) / m, len(set(lines)) / k, len(words) / k, (sizes == 1).sum() / m, (sizes > 12).sum() / m, len(_SYMBOLS.findall(raw)) / m,
        (raw.count(b". ") + raw.count(b".\n")) / m, upper / m, packed / n,
    ]


class Gam:
    """bias + sum of per-feature tables + sum of pair tables, through a logistic link."""

    def __init__(self, x: np.ndarray, y: np.ndarray, bins: int = BINS, rounds: int = ROUNDS, pairs: int = PAIRS, rate: float = RATE):
        n, d = x.shape if x.ndim == 2 else (0, len(FEATURES))
        mean = float(y.mean()) if n else 0.5
        self.bias = float(np.log((mean * n + 0.5) / ((1 - mean) * n + 0.5))) if n else 0.0
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(d)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        if not n or mean in (0.0, 1.0):
            return
        at = self._bins(x)
        score = np.full(n, self.bias)
        for _ in range(rounds):
            for j in range(d):
                score += self._boost(self.tables[j], at[j], score, y, rate)
        gains = []
        for i in range(d):
            for j in range(i):
                shape = (len(self.tables[j]), len(self.tables[i]))
                step, gain = _quadrants(at[j], at[i], *shape, *_slopes(score, y))
                gains.append((-gain, j, i))
        self.pairs = [(j, i) for _, j, i in sorted(gains)[:pairs]]
        self.pair_tables = [np.zeros((len(self.tables[j]), len(self.tables[i]))) for j, i in self.pairs]
        for _ in range(rounds // 3):
            for t, (j, i) in zip(self.pair_tables, self.pairs):
                step, _ = _quadrants(at[j], at[i], *t.shape, *_slopes(score, y))
                t += rate * step
                score += rate * step[at[j], at[i]]

    def _bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]

    @staticmethod
    def _boost(table: np.ndarray, at: np.ndarray, score: np.ndarray, y: np.ndarray, rate: float) -> np.ndarray:
        g, h = _slopes(score, y)
        step = _tree(np.bincount(at, g, len(table)), np.bincount(at, h, len(table)), 2)
        table += rate * step
        return rate * step[at]

    def scores(self, x: np.ndarray) -> np.ndarray:
        at = self._bins(x)
        s = np.full(len(x), self.bias)
        for t, b in zip(self.tables, at):
            s += t[b]
        for t, (j, i) in zip(self.pair_tables, self.pairs):
            s += t[at[j], at[i]]
        return 1 / (1 + np.exp(-s))


def _slopes(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-score))
    return y - p, p * (1 - p)


def _tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Newton steps of a tree on ordered bins: the best cut, then again in both halves."""
    gain = lambda a, b: a * a / (b + 1.0)
    if depth and len(g) > 1:
        cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        each = gain(cg, ch) + gain(g.sum() - cg, h.sum() - ch)
        k = int(each.argmax()) + 1
        if each[k - 1] > gain(g.sum(), h.sum()) + 1e-9:
            return np.concatenate([_tree(g[:k], h[:k], depth - 1), _tree(g[k:], h[k:], depth - 1)])
    return np.full(len(g), g.sum() / (h.sum() + 1.0))


def _quadrants(a: np.ndarray, b: np.ndarray, na: int, nb: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best cut of each axis into four quadrants, each with its Newton step, and the gain."""
    cell = a * nb + b
    cg = np.bincount(cell, g, na * nb).reshape(na, nb).cumsum(0).cumsum(1)
    ch = np.bincount(cell, h, na * nb).reshape(na, nb).cumsum(0).cumsum(1)
    if na < 2 or nb < 2:
        return np.zeros((na, nb)), 0.0

    def quads(c):
        low, left, top = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1]
        return low, left - low, top - low, c[-1, -1] - left - top + low

    qg, qh = quads(cg), quads(ch)
    total = sum(x * x / (w + 1.0) for x, w in zip(qg, qh))
    i, j = np.unravel_index(int(total.argmax()), total.shape)
    v = [x[i, j] / (w[i, j] + 1.0) for x, w in zip(qg, qh)]
    step = np.empty((na, nb))
    step[: i + 1, : j + 1], step[: i + 1, j + 1 :], step[i + 1 :, : j + 1], step[i + 1 :, j + 1 :] = v
    return step, float(total[i, j])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample_docs: int = SAMPLE_DOCS) -> Gam:
    """Fit on at most ``sample_docs`` labelled documents, those of the smallest id hash; the caller removes held-out labels.

    Null ids and labels teach nothing; of several labels of one id the smallest holds. Without rows the model says 0.5.
    Only the chosen rows' features reach the driver: sample_docs times len(FEATURES) numbers.
    """
    spark = docs.sparkSession
    text_batches(spark)
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("double").alias("y")).where("doc_id is not null and y is not null")
    known = known.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    rows = known.collect()
    if not rows:
        return Gam(np.zeros((0, len(FEATURES))), np.zeros(0))
    picked = spark.createDataFrame([(r["doc_id"], r["y"]) for r in rows], known.schema)
    body = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(picked), "doc_id").repartition(24)

    @F.arrow_udf("array<double>")
    def measure(texts: pa.Array) -> pa.Array:
        return pa.array([features(t.as_py()) for t in texts], pa.list_(pa.float64()))

    got = sorted((r["doc_id"], r["y"], r["f"]) for r in body.select("doc_id", "y", measure("text").alias("f")).collect())
    return Gam(np.array([r[2] for r in got]), np.array([r[1] for r in got])) if got else Gam(np.zeros((0, len(FEATURES))), np.zeros(0))


def score(df: DataFrame, model: Gam, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the probability of label 1 for each whole text in ``out``; empty and null texts are scored too."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def rate(texts: pa.Array) -> pa.Array:
        x = np.array([features(t.as_py()) for t in texts]).reshape(-1, len(FEATURES))
        return pa.array(shared.value.scores(x))

    return df.withColumn(out, rate(F.col(text)))
