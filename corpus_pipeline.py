"""A corpus pipeline of five stages; each returns what the next one reads as ``docs``.

Every stage takes empty tables, nulls in any column and texts of any length. Rows are told apart by id and text, so repeated rows are
kept or dropped together unless a stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracesheaf.llm import bpe, langid, mixing, nearcopies, pii
from tracesheaf.llm.common import held_out, written
from tracesheaf.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document is rejected if no language can be told (``und``) or the best one is less likely than this.
MIN_SCORE = 0.4


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is known; ``lang`` becomes the predicted one. Learns from rows that are not held out.

    Null, empty and letterless texts are rejected, as is a text of which no language has the share MIN_SCORE, by the mean over its words. Of equally likely
    languages the first by name is taken. Null ids and repeated rows are judged like others; without labelled rows nothing can be told and nothing stays.
    """
    model = langid.train(docs.where(~held_out("doc_id")))
    found = docs.withColumn("__p", langid.predict_column(spark, model))
    kept = found.where((F.col("__p.lang_pred") != "und") & (F.col("__p.score") >= MIN_SCORE)).withColumn("lang", F.col("__p.lang_pred"))
    return kept.select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles, similarity of 0.8 or more), that with the smallest id.

    Null ids come last, of equal ids the smallest hash of id and text stays, repeats of that row go. Word-free and null texts are one group.
    """
    return nearcopies.keep_one(docs).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every span of personal data by its kind; no document goes and repeated rows stay. ``n_chars`` follows the text.

    A text without spans, null or empty ones among them, stays as it is, with its ``n_chars``; of overlapping spans the first covers the others.
    """
    found = pii.find_spans(docs, keep=COLUMNS)
    clean = found.withColumn("text", pii.redact(F.col("text"), F.col("pii")))
    return clean.withColumn("n_chars", F.when(F.size("pii") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that each source's words come to its target share.

    Null sources are one source; a text without words, null or empty, gets one copy. Documents of one source and size are equal to the mix and a hash
    deals the odd copies, so reruns agree. Repeated rows share their copies.
    """
    return mixing.apply_mix(docs).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the number of characters and the sha256 of the text that decoding gives back.

    Null texts count as empty and give no ids. Every row gives one row, repeats and null ids too.
    """
    path = tokenizer_path()
    encoded = bpe.encode(docs.select("doc_id", "text", "lang", "source"), path)
    back = bpe.decode(encoded.drop("text"), path)
    decoded = [F.length("decoded").cast("long").alias("n_decoded"), F.sha2("decoded", 256).alias("decoded_sha256")]
    return back.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), *decoded, "ids")


STAGES = [("languages", languages), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("tokens", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; what each stage returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
