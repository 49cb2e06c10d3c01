"""Spelling variants: words one edit apart, by pivotal grams.

Bigrams are ordered by how many words hold them, the rarest first. A word's prefix is its three rarest bigrams, and its pivots are two
of them that share no letter, chosen by dynamic programming so that together they are rarest. One edit spoils at most one of two
disjoint bigrams, so of two words one edit apart the one whose prefix ends first has a pivot that lies in the prefix of the other, at the same
place or one beside it as their lengths say. Pivots meet prefixes in an equi-join on bigram, place and length, whose
condition verifies the distance: only true pairs leave it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesheaf.llm.common import written

#: Letters of the contract: basic Latin, and Latin-1 from A with grave on.
LETTERS = r"[A-Za-zÀ-ÿ]"
MIN_CHARS, MIN_COUNT, RATIO = 6, 5, 5
#: Place and length of a bigram in the other word, less those in this one: a letter is replaced, added behind or before it, or taken behind or before it.
SHIFTS = [(0, 0), (0, 1), (1, 1), (0, -1), (-1, -1)]


def letter_runs(df: DataFrame, text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``df`` without its text and with ``word``, one row for each maximal run of ``min_chars`` letters or more, A-Z in lower case; null has none."""
    found = df.withColumn(text, F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"{LETTERS}{{{min_chars},}}"), F.lit(0))))
    word, upper = F.col(f"`{text}`"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lower = F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, upper, upper.lower()))
    return found.withColumn("word", lower).select(*[F.col(f"`{c}`") for c in df.columns if c not in (text, "word")], "word")


def choose_pivots(grams: list[tuple[int, int]], count: int = 2) -> list[int]:
    """Places of ``count`` disjoint bigrams of least total weight, by dynamic programming over (place, weight) in order of place; of ties the first places."""
    best: list[list[tuple[int, tuple[int, ...]] | None]] = [[(0, ())] + [None] * count]
    for i, (at, weight) in enumerate(grams):
        free = next((k for k in range(i, 0, -1) if grams[k - 1][0] <= at - 2), 0)  # the grams before it that end before it begins
        row = list(best[i])
        for c in range(1, count + 1):
            if best[free][c - 1] is not None:
                with_it = (best[free][c - 1][0] + weight, (*best[free][c - 1][1], at))
                row[c] = min(row[c] or with_it, with_it)
        best.append(row)
    return list(best[-1][count][1])


def pivots_column(grams: str) -> Column:
    """``struct<pivots: places, last: the last bigram of the prefix>`` of each word's bigrams (p, w, g) in order of place."""

    @F.arrow_udf("struct<pivots:array<int>,last:struct<w:bigint,g:string>>")
    def choose(words: pa.Array) -> pa.Array:
        out = []
        for word in words.to_pylist():
            last = sorted((x["w"], x["g"]) for x in word)[2]
            pivots = choose_pivots([(x["p"], x["w"]) for x in word if (x["w"], x["g"]) <= last])
            out.append({"pivots": pivots, "last": {"w": last[0], "g": last[1]}})
        return pa.array(out, pa.struct([("pivots", pa.list_(pa.int32())), ("last", pa.struct([("w", pa.int64()), ("g", pa.string())]))]))

    return choose(F.col(grams))


def vocabulary(words: DataFrame, word: str = "word", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words of at least ``min_chars`` letters and ``min_count`` rows, as a written table."""
    if min_chars < 4:
        raise ValueError("a word needs three bigrams")
    long = words.select(F.col(f"`{word}`").alias("word")).where(F.char_length("word") >= min_chars)
    return written(long.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count), "words")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n) both ways for all pairs of ``words`` (word, n) that are one insertion, deletion or replacement apart."""
    places = F.sequence(F.lit(1), F.char_length("word") - 1)
    gram = words.select("word", "n", F.explode(places).alias("p")).withColumn("g", F.substring(F.col("word"), F.col("p"), F.lit(2)))
    weights = written(gram.groupBy("g").agg(F.count_distinct("word").alias("w")), "grams")  # at most the square of the alphabet
    own = F.array_sort(F.collect_list(F.struct("p", "w", "g")))
    chosen = gram.join(weights, "g").groupBy("word", "n").agg(own.alias("grams")).withColumn("c", pivots_column("grams"))
    chosen = written(chosen.select("word", "n", F.char_length("word").alias("len"), "grams", "c.pivots", "c.last"), "pivots")
    prefix = chosen.select(F.col("word").alias("other"), F.col("n").alias("other_n"), "len", F.col("last").alias("other_last"), F.explode("grams").alias("x"))
    prefix = prefix.where(F.struct("x.w", "x.g") <= F.col("other_last")).select("other", "other_n", "other_last", F.col("x.g").alias("g"), F.col("x.p").alias("p"), "len")
    pivots = chosen.select("word", "n", "len", "last", F.explode(F.filter("grams", lambda x: F.array_contains(F.col("pivots"), x["p"]))).alias("x"))
    shifted = F.explode(F.array(*[F.struct((F.col("x.p") + dp).alias("p"), (F.col("len") + dl).alias("len")) for dp, dl in SHIFTS])).alias("s")
    pivots = pivots.select("word", "n", "last", F.col("x.g").alias("g"), shifted).select("word", "n", "last", "g", "s.p", "s.len")
    found = pivots.join(prefix, ["g", "p", "len"]).where((F.col("last") <= F.col("other_last")) & (F.levenshtein("word", "other", 1) == 1))
    names = ["word", "n", "other", "other_n"]
    ways = F.array(*[F.struct(*[F.col(c).alias(k) for c, k in zip(order, names)]) for order in (names, [*names[2:], *names[:2]])])
    return found.select(F.explode(ways).alias("s")).select("s.*").distinct()


def roots(links: DataFrame) -> DataFrame:
    """(word, root): the last word that ``links`` (word, form) lead to; ways are doubled in each round and must not be circular.

    A round is a join of the links with themselves, written, until no way grows.
    """
    at, far = written(links.select("word", F.col("form").alias("root")), "links"), True
    while far:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("far")), "links", instead_of=at)
        at, far = step.drop("far"), not step.where("far").isEmpty()
    return at


def group_variants(words: DataFrame, word: str = "word", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each distinct word of at least ``min_chars`` letters in ``min_count`` rows of ``words``.

    The form is the near word of largest n (of ties the smallest in code-point order) where that is at least ``ratio`` times the
    word's own, and root the end of the chain of forms (the word itself where it has none). Null words are left out, other columns
    and repeated rows count for nothing but occurrences, and an empty table gives an empty one.
    """
    if ratio < 2:
        raise ValueError("forms could go round in a circle")
    known = vocabulary(words, word, min_chars, min_count)
    near = near_pairs(known).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("w"))).alias("best"))
    found = known.join(near, "word", "left")
    has = -F.col("best.m") >= ratio * F.col("n")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.w")).alias("form"), F.when(has, -F.col("best.m")).alias("form_n"))
    found = written(found, "forms")
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
