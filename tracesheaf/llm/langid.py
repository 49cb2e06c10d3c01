"""Language identification, word first with n-gram backoff.

A known word scores its log frequency in each language. An unseen word is padded and scored by its
character n-grams of the longest order of which any is known, falling back order by order.
The model is two tables (words and n-grams) counted by Spark over a bounded, documented sample. A letter is a
character of Unicode category L, in training and in prediction.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracesheaf.llm.common import text_batches

#: Size of the model: training documents for each language; words and n-grams, the most frequent ones; numbers in a table (with more
#: than TABLE / MAX_WORDS languages fewer words fit, but no language goes).
SAMPLE_DOCS, MAX_WORDS, MAX_GRAMS, TABLE = 2500, 150_000, 60_000, 30_000_000
MAX_ORDER = 4
#: Candidates for a language's sample, as a multiple of it.
CUT_MARGIN = 2
_ALPHANUMERIC = re.compile(r"[^\W\d_]+")


def letter_runs(text: str) -> list[str]:
    """The runs of letters (category L) of ``text``, lower-cased first."""
    runs = _ALPHANUMERIC.findall(text.lower())
    if all(map(str.isalpha, runs)):
        return runs
    # Numbers such as a half or a circled one are alphanumeric and no letters.
    return "".join(c if c.isalpha() else " " for c in " ".join(runs)).split()


class LangModel:
    """Per-language log frequencies of words and n-grams; ``predict`` scores one text. Counts: a row for each name, a column for each language."""

    def __init__(self, langs: list[str], words: list[str], word_counts: np.ndarray, grams: list[str], gram_counts: np.ndarray):
        self.langs, n = langs, max(1, len(langs))
        word_counts, gram_counts = word_counts.reshape(-1, n).astype(float), gram_counts.reshape(-1, n).astype(float)
        self.word_row = {w: i for i, w in enumerate(words)}
        self.rows = np.log((word_counts + 0.05) / (word_counts.sum(axis=0) + 0.05 * len(words))).astype(np.float32) if words else np.zeros((0, n), np.float32)
        self.gram_row = {g: i for i, g in enumerate(grams)}
        self.gram_logs = np.zeros((len(grams), n))
        orders = np.array([len(g) for g in grams], int)
        for k in np.unique(orders):
            c = gram_counts[orders == k]
            self.gram_logs[orders == k] = np.log((c + 0.5) / (c.sum(axis=0) + 0.5 * len(c)))
        self.base = len(words)
        self.cache: dict[str, int] = {}

    def _grams(self, word: str) -> list[int]:
        """Rows of the word's known n-grams of the longest order that has any."""
        padded, known = f"^{word}$", self.gram_row.get
        for k in range(min(MAX_ORDER, len(padded)), 0, -1):
            found = [r for i in range(len(padded) - k + 1) if (r := known(padded[i : i + k])) is not None]
            if found:
                return found
        return []

    def _learn(self, words: list[str]) -> None:
        """Give each unseen word a row: the mean over its n-grams, 0 without any."""
        grams = [self._grams(w) for w in words]
        sizes = np.fromiter(map(len, grams), np.int64, len(grams))
        new = np.zeros((len(words), self.rows.shape[1]))
        some = sizes > 0
        if some.any():
            flat = self.gram_logs[np.array([i for g in grams for i in g])]
            new[some] = np.add.reduceat(flat, np.concatenate([[0], np.cumsum(sizes[some])[:-1]])) / sizes[some, None]
        if self.used + len(words) > len(self.rows):
            more = max(len(self.rows), len(words), 1024)
            self.rows = np.concatenate([self.rows, np.zeros((more, self.rows.shape[1]), np.float32)])
        self.rows[self.used : self.used + len(words)] = new
        self.cache.update(zip(words, range(self.used, self.used + len(words))))
        self.used += len(words)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): the score is the share of the best language by the mean log frequency of the text's words, so it does not rise with length."""
        words = letter_runs(text or "")
        if not words or not self.langs:
            return "und", 0.0
        if not self.cache or len(self.cache) > 300_000:
            self.cache, self.used = dict(self.word_row), self.base
        cache = self.cache
        if unseen := [w for w in set(words) if w not in cache]:
            self._learn(unseen)
        s = self.rows[[cache[w] for w in words]].mean(axis=0, dtype=np.float64)
        p = np.exp(s - s.max())
        best = int(p.argmax())
        return self.langs[best], float(p[best] / p.sum())


def _table(counted: DataFrame, name: str, least: int, most: int, n: int) -> tuple[list[str], np.ndarray]:
    """The ``most`` frequent names of ``counted`` (name, i, n) that occur ``least`` times: names, and their counts by language."""
    each = counted.groupBy(name).agg(F.sum("n").alias("total"), F.collect_list("i").alias("i"), F.collect_list("n").alias("n"))
    top = each.where(F.col("total") >= least).orderBy(F.desc("total"), name).limit(most).select(name, "i", "n").toArrow().combine_chunks()
    counts = np.zeros((top.num_rows, n), np.int64)
    if top.num_rows:
        held = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (top["i"], top["n"])]
        at = np.repeat(np.arange(top.num_rows), held[0].value_lengths().to_numpy())
        counts[at, held[0].flatten().to_numpy()] = held[1].flatten().to_numpy()
    return top[name].to_pylist(), counts


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> LangModel:
    """Fit on whole texts of at most ``sample_docs`` documents for each language, those of the smallest id hash.

    The caller removes held-out rows. Rows with null lang, id or text teach nothing; an empty table gives a model
    that answers ``und``. Every language stays. What reaches the driver is the names of languages, the ids of the samples and two tables: of words
    the MAX_WORDS most frequent that occur twice, of n-grams the MAX_GRAMS most frequent that occur three times, fewer where TABLE asks for it.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang")).where("doc_id is not null and lang is not null")
    rows = named.groupBy("lang").count().orderBy("lang").collect()  # a row for each language
    langs = [r["lang"] for r in rows]
    if not langs:
        return LangModel([], [], np.zeros(0), [], np.zeros(0))
    # Hashes below the cut are about CUT_MARGIN samples of a language, however many documents it has; the window picks among those.
    share = F.create_map(*[F.lit(x) for r in rows for x in (r["lang"], min(1.0, CUT_MARGIN * sample_docs / r["count"]))])
    below = F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5 <= F.element_at(share, F.col("lang"))
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = named.where(below).withColumn("r", F.row_number().over(w)).where(F.col("r") <= sample_docs)
    ids = [r[0] for r in chosen.select("doc_id").distinct().collect()]  # at most sample_docs for each language
    picked = spark.createDataFrame([(i,) for i in ids], docs.select(F.col(doc_id).alias("doc_id")).schema)
    body = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null")
    body = body.join(F.broadcast(picked), "doc_id")
    index = F.create_map(*[F.lit(x) for i, name in enumerate(langs) for x in (name, i)])
    words = body.select(F.element_at(index, F.col("lang")).alias("i"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    counts = words.groupBy("word", "i").agg(F.count("*").alias("n")).persist()
    most = max(1, TABLE // len(langs))
    top = _table(counts, "word", 2, min(MAX_WORDS, most), len(langs))
    padded = F.concat(F.lit("^"), F.col("word"), F.lit("$"))

    def cut(k: int):
        every = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - (k - 1))), lambda i: F.substring(padded, i, F.lit(k)))
        return F.when(F.length(padded) >= k, every).otherwise(F.array().cast("array<string>"))

    cuts = [cut(k) for k in range(1, MAX_ORDER + 1)]
    grams = counts.select(F.explode(F.flatten(F.array(*cuts))).alias("gram"), "i", "n").groupBy("gram", "i").agg(F.sum("n").alias("n"))
    best = _table(grams, "gram", 3, min(MAX_GRAMS, most), len(langs))
    counts.unpersist()
    return LangModel(langs, *top, *best)


def predict_column(spark, model: LangModel, text: str = "text") -> Column:
    """Struct (lang_pred, score) for each whole text; null and letterless texts are ``und`` with score 0."""
    text_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        both = [shared.value.predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([b[0] for b in both], pa.string()), pa.array([b[1] for b in both], pa.float64())], ["lang_pred", "score"])

    return predict(F.col(text))
