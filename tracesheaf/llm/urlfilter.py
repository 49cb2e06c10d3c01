"""URL filters over time: dated list entries become validity intervals, and an as-of join evaluates each capture.

DataFrame functions only. Intervals are cut at bucket borders, so the as-of join is an equi-join on (pattern, bucket) with a
residual range test: hot hosts spread over buckets, and the planner may split or broadcast as sizes allow. A host asks only for parents of as many
labels as some entry has; top labels, which hold a good part of all hosts each, are few and their entries are salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 30
#: Parts of what asks for a top label.
SALTS = 64


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot; empty if there is none."""
    authority = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"[.]?(:[0-9]*)?$", "")


def intervals(entries: DataFrame, pattern: str = "pattern", at: str = "listed_at", action: str = "action") -> DataFrame:
    """(pattern, action, valid_from, valid_to) from dated entries.

    An entry holds from its date until the pattern's next one (valid_to null: open). Of several entries on one date the
    alphabetically last action holds. Action ``remove`` ends what was active. Rows with null in any column are ignored.
    """
    e = entries.select(F.col(pattern).alias("pattern"), F.col(at).alias("valid_from"), F.col(action).alias("action")).dropna()
    e = e.groupBy("pattern", "valid_from").agg(F.max("action").alias("action"))
    e = e.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("pattern").orderBy("valid_from")))
    return e.where("action <> 'remove'")


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at", bucket: int = BUCKET) -> DataFrame:
    """``captures`` with host, verdict, pattern and valid_from of the entry active when each was fetched.

    Times are whole numbers (days). Patterns are hosts or parent domains; of the active ones the longest decides. Captures
    without host, time or active entry get verdict ``none`` and null pattern. Repeated rows stay; columns of ``captures`` with
    the names of the new ones are replaced. Empty tables on either side are fine.

    The as-of join runs on the distinct (host, time) only; other columns of the captures meet its result in one equi-join.
    """
    new = ["host", "verdict", "pattern", "valid_from"]
    kept = [c for c in captures.columns if c not in new]
    rows = captures.select(*[F.col(f"`{c}`") for c in kept], host_of(F.col(f"`{url}`")).alias("host"))
    asked = rows.select("host", F.col(f"`{fetched}`").cast("long").alias("at")).where("host <> '' and at is not null").distinct()
    begin, end = rows.agg(F.min(f"`{fetched}`").cast("long"), F.max(f"`{fetched}`").cast("long")).first()
    labels = F.split("host", r"\.")
    held = intervals(entries)
    depths = [r.k for r in held.select(F.size(F.split("pattern", r"\.")).alias("k")).distinct().collect()]  # as many as names have depths
    asks = F.filter(F.sequence(F.lit(1), F.size(labels)), lambda i: (F.size(labels) - i + 1).isin(depths)) if depths else F.array().cast("array<int>")
    suffixes = F.transform(asks, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    top = ~F.contains("p", F.lit("."))
    wide = asked.withColumn("p", F.explode(suffixes)).withColumn("b", F.floor(F.col("at") / bucket)).withColumn("salt", F.when(top, F.pmod(F.xxhash64("host"), F.lit(SALTS)).cast("int")).otherwise(0))
    # An interval counts within the time of the captures only, so an old entry has no more buckets than they have.
    spans = held.withColumn("from_", F.greatest("valid_from", F.lit(begin).cast("long"))).withColumn("to_", F.least(F.coalesce(F.col("valid_to") - 1, F.lit(end).cast("long")), F.lit(end).cast("long")))
    spans = spans.where("from_ <= to_").withColumn("b", F.explode(F.sequence(F.floor(F.col("from_") / bucket), F.floor(F.col("to_") / bucket))))
    spans = spans.withColumn("salt", F.explode(F.when(F.contains("pattern", F.lit(".")), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    s, c = spans.alias("s"), wide.alias("c")
    active = (F.col("c.p") == F.col("s.pattern")) & (F.col("c.b") == F.col("s.b")) & (F.col("c.salt") == F.col("s.salt")) & F.col("c.at").between(F.col("s.from_"), F.col("s.to_"))
    hit = F.struct(F.length("s.pattern").alias("n"), F.col("s.pattern"), F.col("s.action"), F.col("s.valid_from"))
    best = c.join(s, active).groupBy("c.host", "c.at").agg(F.max(hit).alias("hit")).alias("v")
    out = rows.alias("r").join(best, (F.col("r.host") == F.col("v.host")) & (F.col(f"r.`{fetched}`").cast("long") == F.col("v.at")), "left")
    found = [F.coalesce("v.hit.action", F.lit("none")).alias("verdict"), F.col("v.hit.pattern").alias("pattern"), F.col("v.hit.valid_from").alias("valid_from")]
    return out.select(*[F.col(f"r.`{c}`") for c in kept], "r.host", *found)
