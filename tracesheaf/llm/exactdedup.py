"""Exact deduplication by content-defined chunk recipes, with DataFrame functions only.

A text is cut where its own characters say so, and each chunk becomes a 64-bit identifier: the list of them, in order, is the text's recipe.
Identifiers are verified over all distinct chunks: one that stands for two SHA-256 digests is contested, and texts that hold it are
told apart by the digest of the whole text. Recipes, a few bytes for each thousand characters, are all that is shuffled: no text leaves the task that reads it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesheaf.llm.common import spare_name, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS, MAX_CHARS = 512, 8192
#: A chunk ends after a word of three letters of these kinds, about once in 400 characters of prose.
BOUNDARY = r"[\x20\x09-\x0D][a-d][a-z][bdfhkmptz][\x20\x09-\x0D]"
#: A recipe is hot where it has over one in so many rows; there are fewer than that, and their lists are on average no longer than this times the mean list.
HOT_SHARE = 1000


def normalised(text: str) -> Column:
    """The text with A-Z in lower case and all else as it is; null becomes empty."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def chunks(text: Column, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS) -> Column:
    """The chunks of a text, which joined give it back: each ends at the first boundary after ``min_chars``, or at ``max_chars`` where there is none."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{{min_chars},{max_chars}}}?{BOUNDARY}|.{{1,{max_chars}}}"), F.lit(0))


def recipes(df: DataFrame, text: str = "text", doc_id: str = "doc_id", identify: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(tag, doc_id, n_bytes, text_sha256, ids, digests) of every row, as a written table; tag tells rows apart."""
    cut = df.select(F.col(f"`{doc_id}`").alias("doc_id"), normalised(text).alias("t"))
    cut = cut.select("doc_id", F.octet_length("t").cast("long").alias("n_bytes"), F.sha2("t", 256).alias("text_sha256"), chunks(F.col("t")).alias("c"))
    ids, digests = F.transform("c", lambda c: identify(c).cast("long")), F.transform("c", lambda c: F.unhex(F.sha2(c, 256)))
    return written(cut.select(F.monotonically_increasing_id().alias("tag"), "doc_id", "n_bytes", "text_sha256", ids.alias("ids"), digests.alias("digests")), "recipes")


def contested(rows: DataFrame) -> DataFrame:
    """The identifiers that stand for more than one digest."""
    pairs = rows.select(F.explode(F.arrays_zip("ids", "digests")).alias("p")).select("p.ids", "p.digests").distinct()
    return written(pairs.groupBy(F.col("ids").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id"), "contested")


def classes(df: DataFrame, text: str = "text", doc_id: str = "doc_id", identify: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, n_chunks) for every row of ``df``.

    Rows are equal where their texts are, null as empty and A-Z as a-z. Of equal rows the one with the largest id stays, and of several
    with that id any one, a null id being below all others. An empty table gives an empty one. ``identify``: the identifier of a chunk; a weak one costs time, not
    results.
    """
    rows = recipes(df, text, doc_id, identify)
    doubtful = contested(rows)
    rows = rows.drop("digests")
    if doubtful.isEmpty():
        rows = rows.withColumn("whole", F.lit(None).cast("string"))
    else:
        held = rows.select("tag", F.explode("ids").alias("id")).join(doubtful, "id", "left_semi").select("tag").distinct()
        rows = rows.join(held.withColumn("hit", F.lit(True)), "tag", "left").withColumn("whole", F.when(F.col("hit"), F.col("text_sha256"))).drop("hit")
    rows = rows.withColumn("whole", F.coalesce("whole", F.lit(""))).withColumn("list_hash", F.xxhash64("ids"))
    key = ["list_hash", "n_bytes", "ids", "whole"]
    groups = rows.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.coalesce(F.max_by("tag", "doc_id"), F.min("tag")).alias("keep_tag"))
    groups = written(groups.where("group_size > 1"), "groups")
    hot = F.broadcast(groups.where(F.col("group_size") * HOT_SHARE > rows.count()))
    rest = groups.where(F.col("group_size") * HOT_SHARE <= rows.count())
    named = rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(rest, key, "left"), allowMissingColumns=True)
    alone = F.col("group_size").isNull()
    return named.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("tag") == F.col("keep_tag"))).alias("kept"),
        "text_sha256",
        F.size("ids").alias("n_chunks"),
    )


def keep_one(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``df`` with one row of each class of equal texts, all its columns and no others; of rows that share id and text any one stays."""
    sha, kept_sha, kept_id = spare_name(df, "sha"), spare_name(df, "kept_sha"), spare_name(df, "kept_id")
    kept = classes(df, text, doc_id).where("kept").select(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(kept_sha))
    rows = df.withColumn(sha, F.sha2(normalised(text), 256))
    found = rows.join(kept, F.col(f"`{doc_id}`").eqNullSafe(F.col(kept_id)) & (F.col(sha) == F.col(kept_sha)), "left_semi")
    return found.dropDuplicates([doc_id, sha]).drop(sha)
