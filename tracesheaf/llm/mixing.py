"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Document rates are tilted exponentially in document size under a cap, r = C / (1 + (C - 1) exp(-t u)), where u is the size over the
source's mean size; t = 0 gives rate 1. The convex dual has one unknown t for each source, solved by safeguarded Newton
steps on the table of (source, size, count). Rates become copies by cumulative rounding over sizes, then a few
passes move what is left onto the largest sizes that fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracesheaf.llm.common import WORD, spare_name, written

WEIGHTS, CAP, STEPS, TOLERANCE, SALTS, PASSES = (5, 2, 1), 3, 40, 1e-4, 256, 6
_SRC = ["s0", "s1"]


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(s0, s1, n_docs, source_size, target) from rows (s0, s1, size): shares of all sizes by weight, capped and reshared.

    The capped sources are a prefix in order of cap over weight, so one pass over the table of sources (a row for
    each) finds the common share. Without words all targets are 0.
    """
    per = sizes.groupBy(*_SRC).agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.asc("s0"), F.asc("s1"))
    ladder = F.lit(list(weights)).cast("array<int>")
    per = per.withColumn("weight", F.get(ladder, ((F.row_number().over(by_name) - 1) % len(weights)).cast("int")))
    per = per.withColumn("most", F.col("source_size") * cap)
    w = Window.orderBy(F.asc(F.col("most") / F.col("weight")), F.asc("s0"), F.asc("s1"))
    lower, everything = w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(lower), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(lower), F.lit(0))
    per = per.withColumn("share", left / weight_left).withColumn("share", F.max("share").over(everything))
    return per.select(*_SRC, "n_docs", "source_size", F.least(F.col("most").cast("double"), F.col("weight") * F.col("share")).alias("target"))


def tilted(t: Column, u: Column, cap: int = CAP) -> Column:
    return F.lit(float(cap)) / (1.0 + (cap - 1.0) * F.exp(F.least(F.lit(700.0), -t * u)))


def solve_rates(cells: DataFrame, targets: DataFrame, cap: int = CAP, steps: int = STEPS) -> DataFrame:
    """(s0, s1, t) with sum(count * size * rate) at each source's target; a source at its cap gets t = null (rate = cap)."""
    free = (F.col("target") < F.col("source_size") * float(cap)) & (F.col("source_size") > 0)
    at = targets.where(free).select(*_SRC, "target", (F.col("source_size") / F.col("n_docs")).alias("mean"), F.lit(0.0).alias("t"), F.lit(-4096.0).alias("lo"), F.lit(4096.0).alias("hi"))
    at = written(at, "dual")
    for _ in range(steps):
        r = tilted(F.col("t"), F.col("u"), cap)
        mass = F.col("n") * F.col("size")
        sums = cells.join(at, _SRC).withColumn("u", F.col("size") / F.col("mean"))
        sums = sums.groupBy(*_SRC).agg(F.sum(mass * r).alias("f"), F.sum(mass * F.col("u") * r * (1.0 - r / cap)).alias("d"), *[F.first(c).alias(c) for c in ("target", "mean", "t", "lo", "hi")])
        gap = F.col("f") - F.col("target")
        lo, hi = F.when(gap < 0, F.col("t")).otherwise(F.col("lo")), F.when(gap > 0, F.col("t")).otherwise(F.col("hi"))
        newton = F.col("t") - F.try_divide(gap, F.col("d"))
        step = F.when((newton > lo) & (newton < hi), newton).otherwise((lo + hi) / 2)
        done = F.abs(gap) <= TOLERANCE * F.greatest(F.lit(1.0), F.col("target"))
        at = written(sums.select(*_SRC, "target", "mean", F.when(done, F.col("t")).otherwise(step).alias("t"), lo.alias("lo"), hi.alias("hi"), done.alias("done")), "dual", instead_of=at)
        if not at.where("not done").head(1):
            return at.select(*_SRC, "t")
    raise RuntimeError(f"rates are not settled after {steps} steps")


def cell_copies(cells: DataFrame, targets: DataFrame, rates: DataFrame, cap: int = CAP) -> DataFrame:
    """Adds to (s0, s1, size, n): source_size, target, rate, k = copies that the n documents of the cell get together.

    Windows run within a source over its distinct sizes, not over its documents.
    """
    u = F.col("size") * F.col("n_docs") / F.col("source_size")
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("t").isNull(), float(cap)).otherwise(tilted(F.col("t"), u, cap))
    c = cells.join(targets, _SRC).join(rates, _SRC, "left").withColumn("rate", rate)
    down = Window.partitionBy(*_SRC).orderBy(F.desc("size"))
    whole, upto = Window.partitionBy(*_SRC), down.rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("e", F.sum(F.col("n") * F.col("rate")).over(upto)).withColumn("e", F.floor(F.col("e") + 0.5))
    c = c.withColumn("k", F.least(F.col("n") * cap, F.col("e") - F.lag("e", 1, 0).over(down)))
    for _ in range(PASSES):
        c = c.withColumn("gap", F.col("target") - F.sum(F.col("k") * F.col("size")).over(whole))
        room = F.when(F.col("gap") > 0, F.col("n") * cap - F.col("k")).otherwise(F.col("k"))
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("gap")) & (room > 0)
        c = c.withColumn("pick", F.max(F.when(fits, F.col("size"))).over(whole))
        move = F.least(room, F.floor(F.abs("gap") / F.col("size")))
        c = c.withColumn("k", F.when(F.col("size") == F.col("pick"), F.col("k") + F.signum("gap").cast("long") * move).otherwise(F.col("k")))
    return c.select(*_SRC, "size", "n", "source_size", "target", "rate", "k")


def mix(df: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken, row_key) for every row of ``df``.

    size counts words (null text: 0). Documents of one source and size are equal to the mix: which of them get the odd copies
    is decided by a hash of (id, text, source), so reruns agree. Null sources are one source of their own, last in
    order; documents without words get one copy. Repeated rows stay rows. An empty table gives no rows.
    """
    rows = df.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(source).isNull().alias("s0"), F.coalesce(F.col(source), F.lit("")).alias("s1"),
        F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("size"), F.xxhash64(doc_id, text, source).alias("row_key"),
    )
    rows = written(rows.withColumn("salt", F.pmod("row_key", F.lit(SALTS)).cast("int")), "sizes")
    cells = written(rows.groupBy(*_SRC, "size").agg(F.count("*").alias("n")), "cells")
    targets = written(source_targets(rows.select(*_SRC, "size"), weights, cap), "targets")
    copies = written(cell_copies(cells, targets, solve_rates(cells, targets, cap), cap), "copies")
    # A large cell is cut by salt: the odd copies are dealt over its salts, then within each.
    subs = rows.groupBy(*_SRC, "size", "salt").agg(F.count("*").alias("m"))
    subs = subs.join(copies, [*_SRC, "size"])
    upto = Window.partitionBy(*_SRC, "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)
    base, odd = F.expr("k div n"), F.col("k") % F.col("n")
    subs = subs.withColumn("run", F.sum("m").over(upto)).withColumn("base", base).withColumn("odd", odd)
    share = F.expr("(odd * run) div n - (odd * (run - m)) div n")
    subs = subs.withColumn("extra", share).select(*_SRC, "size", "salt", "source_size", "target", "rate", "base", "extra")
    w = Window.partitionBy(*_SRC, "size", "salt").orderBy("row_key", "doc_id")
    out = rows.join(subs, [*_SRC, "size", "salt"]).withColumn("copies", F.col("base") + F.when(F.row_number().over(w) <= F.col("extra"), 1).otherwise(0))
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"), "row_key")


def apply_mix(df: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **settings) -> DataFrame:
    """``df`` with every row repeated as often as the mix takes it; rows with no copy go. Equal rows share their copies."""
    key = F.xxhash64(doc_id, text, source)
    copies, own_id, own_key, row, n = (spare_name(df, x) for x in ("copies", "own_id", "own_key", "row", "n"))
    taken = mix(df, text, source, doc_id, **settings).groupBy("doc_id", "row_key").agg(F.sum("copies").alias(copies))
    taken = taken.where(F.col(copies) > 0).withColumnsRenamed({"doc_id": own_id, "row_key": own_key})
    joined = df.withColumn(row, key).join(taken, F.col(f"`{doc_id}`").eqNullSafe(F.col(own_id)) & (F.col(row) == F.col(own_key)))
    once = joined.dropDuplicates([doc_id, row])
    return once.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).drop(n, copies, row, own_key, own_id)
