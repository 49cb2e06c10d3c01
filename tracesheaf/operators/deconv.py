"""D3: AR(1) deconvolution with an L1 penalty, after the published pool-adjacent method for calcium traces.

One row holds one trace, so the solver is an Arrow function over rows: no shuffle, one trace in memory at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FUDGE, _LAGS, _ROUNDS, _HALVINGS = 0.98, 10, 50, 50


def noise_sd(y: np.ndarray) -> float:
    """Root of half the mean one-sided Welch density (periodic Hann, half overlap, means removed) over frequencies in (0.25, 0.5)."""
    n = min(256, len(y))
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    starts = range(0, len(y) - n + 1, max(1, n - n // 2))
    psd = np.mean([np.abs(np.fft.rfft((y[s : s + n] - y[s : s + n].mean()) * w)) ** 2 for s in starts], axis=0) / (w @ w)
    psd[1 : len(psd) - (n % 2 == 0)] *= 2
    f = np.fft.rfftfreq(n)
    band = (f > 0.25) & (f < 0.5)
    return float(np.sqrt(psd[band].mean() / 2)) if band.any() else 0.0


def decay(y: np.ndarray, sn: float) -> float:
    """g from the autocovariance: least squares of lags 1.. on lags 0.., the noise taken off lag 0."""
    d = y - y.mean()
    lags = min(_LAGS + 1, len(y) - 1)
    c = np.array([d[: len(d) - k] @ d[k:] for k in range(lags + 1)]) / len(y)
    a, b = c[:-1].copy(), c[1:]
    a[0] -= sn * sn
    g = _FUDGE * float(a @ b) / float(a @ a) if a @ a else 0.0
    return min(max(g, 0.0), 0.999)


def _pools(y: np.ndarray, g: float, lam: float, b: float, powers: list[float]) -> tuple[list[float], list[int]]:
    """Values and lengths of the pools that solve a fixed penalty and baseline; ``powers`` are those of g up to the trace's length."""
    x = y - b - lam * (1 - g)
    x[-1] = y[-1] - b - lam
    v, w, n = [], [], []
    for value in x.tolist():
        cv, cw, cn = value, 1.0, 1
        while v and cv < powers[n[-1]] * v[-1]:
            m, before = n.pop(), w.pop()
            k = powers[m]
            total = before + k * k * cw
            cv, cw, cn = (before * v.pop() + k * cw * cv) / total, total, cn + m
        v.append(cv)
        w.append(cw)
        n.append(cn)
    return v, n


class _Fixed:
    """The solution on fixed pools, linear in baseline and penalty: c = a - b * e - lam * d."""

    def __init__(self, y: np.ndarray, g: float, v: list[float], n: list[int]):
        sizes = np.array(n)
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        h = g ** (np.arange(len(y)) - np.repeat(begins, sizes)).astype(float)
        pay = np.full(len(y), 1 - g)
        pay[-1] = 1.0
        weight = np.add.reduceat(h * h, begins)
        spread = lambda u: h * np.repeat(np.where(np.array(v) > 0, np.add.reduceat(h * u, begins) / weight, 0.0), sizes)
        self.y, self.a, self.e, self.d = y, spread(y), spread(np.ones(len(y))), spread(pay)

    def trace(self, lam: float, b: float) -> np.ndarray:
        return np.maximum(self.a - b * self.e - lam * self.d, 0.0)

    def baseline(self) -> tuple[float, float]:
        """(p, q): the baseline that leaves a mean residual of zero is p + q * lam, and not below 0."""
        left = 1 - self.e.mean()
        return ((self.y - self.a).mean() / left, self.d.mean() / left) if left > 1e-12 else (0.0, 0.0)

    def penalty(self, goal: float) -> tuple[float, float] | None:
        """(lam, b) at which the squared residual is ``goal``, the baseline following; None if there is none."""
        for p, q in (self.baseline(), (0.0, 0.0)):
            r0, r1 = self.y - self.a - p * (1 - self.e), self.d - q * (1 - self.e)
            k2, k1, k0 = r1 @ r1, 2 * (r0 @ r1), r0 @ r0 - goal
            root = k1 * k1 - 4 * k2 * k0
            if k2 <= 0 or root < 0:
                return None
            lam = max(0.0, (math.sqrt(root) - k1) / (2 * k2))
            if p + q * lam >= 0:
                return lam, p + q * lam
        return None


def _settle(y: np.ndarray, g: float, lam: float, b: float, powers: list[float]) -> tuple[np.ndarray, float]:
    """Trace and baseline for a fixed penalty: pools and baseline in turn, the baseline in closed form on the pools."""
    for _ in range(_ROUNDS):
        fixed = _Fixed(y, g, *_pools(y, g, lam, b, powers))
        p, q = fixed.baseline()
        new = max(0.0, p + q * lam)
        if abs(new - b) <= 1e-10 * (1 + abs(b)):
            return fixed.trace(lam, b), b
        b = new
    return fixed.trace(lam, b), b


def deconvolve_trace(y: np.ndarray, g: float | None = None) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(denoised, spikes, baseline, g): the largest penalty whose residual stays within the noise; 0 if none does.

    Penalty and baseline are solved on the pools that stand, then the pools anew, until neither moves; should that not settle, the penalty is halved in.
    """
    y = np.asarray(y, float)
    if len(y) < 4 or not np.isfinite(y).all():
        return np.full(len(y), np.nan), np.full(len(y), np.nan), 0.0, 0.0
    sn = noise_sd(y)
    g = decay(y, sn) if g is None else g
    powers = (g ** np.arange(len(y) + 1.0)).tolist()
    goal = sn * sn * len(y)
    gap = lambda c, b: float(((y - b - c) ** 2).sum())
    c, base = _settle(y, g, 0.0, max(float(np.percentile(y, 15)), 0.0), powers)
    if gap(c, base) < goal:
        c, base = _raised(y, g, goal, base, powers) or _halved(y, g, goal, c, base, powers)
    s = c.copy()
    s[1:] -= g * c[:-1]
    s[0] = 0.0
    return c, np.maximum(s, 0.0), base, g


def _raised(y: np.ndarray, g: float, goal: float, b: float, powers: list[float]) -> tuple[np.ndarray, float] | None:
    lam = 0.0
    for _ in range(_ROUNDS):
        fixed = _Fixed(y, g, *_pools(y, g, lam, b, powers))
        found = fixed.penalty(goal)
        if found is None:
            return None
        if abs(found[0] - lam) <= 1e-10 * (1 + lam) and abs(found[1] - b) <= 1e-10 * (1 + b):
            return fixed.trace(*found), found[1]
        lam, b = found
    return None


def _halved(y: np.ndarray, g: float, goal: float, c: np.ndarray, b: float, powers: list[float]) -> tuple[np.ndarray, float]:
    lo, hi = 0.0, max(float(np.abs(y).max()) * len(y), 1e-6)
    for _ in range(_HALVINGS):
        lam = (lo + hi) / 2
        c2, b2 = _settle(y, g, lam, b, powers)
        if float(((y - b2 - c2) ** 2).sum()) <= goal:
            lo, c, b = lam, c2, b2
        else:
            hi = lam
        if hi - lo <= 1e-9 * hi:
            break
    return c, b


def deconvolve(df: DataFrame, trace: str = "dff", seconds: str | None = None, tau: float = 0.0) -> DataFrame:
    """Adds ``dec`` (denoised), ``spikes``, ``dec_baseline`` and ``dec_g`` to array traces.

    With tau > 0 and a recording time, g = exp(-1 / (frames a second * tau)); otherwise it is estimated. Null traces
    give nulls; traces under four samples or with non-finite ones give arrays of NaN.
    """
    known: Column = F.lit(None).cast("double")
    if tau > 0 and seconds:
        known = F.exp(-1.0 / (F.size(trace) / F.col(seconds) * tau))

    @F.arrow_udf("struct<dec:array<double>,spikes:array<double>,dec_baseline:double,dec_g:double>")
    def solve(traces: pa.Array, gs: pa.Array) -> pa.Array:
        kinds = [("dec", pa.list_(pa.float64())), ("spikes", pa.list_(pa.float64())), ("dec_baseline", pa.float64()), ("dec_g", pa.float64())]
        cols: list[list] = [[], [], [], []]
        for t, g in zip(traces, gs):
            y = np.array([math.nan if v is None else v for v in t.as_py()], float) if t.is_valid else np.zeros(0)
            for col, x in zip(cols, deconvolve_trace(y, g.as_py())):
                col.append(x)
        arrays = [pa.array(c, k) for c, (_, k) in zip(cols, kinds)]
        return pa.StructArray.from_arrays(arrays, [n for n, _ in kinds], mask=traces.is_null())

    return df.withColumn("__d", solve(F.col(trace).cast("array<double>"), known)).select(*df.columns, "__d.*")


def certificate(df: DataFrame, trace: str = "trace") -> DataFrame:
    """D3: adds what makes a solution of ``deconvolve`` the right one, from ``dec``, ``spikes``, ``dec_baseline`` and ``dec_g`` alone but for the noise level.

    ``feasible``: no spike is negative and every sample is g times the one before plus its spike. ``stationary``: the residuals, summed back from the
    end with g, reach their maximum, the penalty, at every spike, and sum to 0 around a baseline above 0. ``at_noise``: the squared residuals come to the
    noise level, or to less where nothing but the baseline is left, or to more without a penalty. Traces without a solution (NaN, null) get null.
    """

    @F.arrow_udf("double")
    def level(traces: pa.Array) -> pa.Array:
        each = (np.array([math.nan if v is None else v for v in t.as_py() or []], float) for t in traces)
        return pa.array([noise_sd(y) ** 2 * len(y) if len(y) >= 4 and np.isfinite(y).all() else None for y in each], pa.float64())

    found = df.withColumn("__goal", level(F.col(trace).cast("array<double>")))
    rows = F.arrays_zip(F.col(trace).alias("y"), F.col("dec").alias("c"), F.col("spikes").alias("s"))
    start = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("gap"), F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("top"), F.lit(None).cast("double").alias("low"), F.lit(0.0).alias("size"))
    g, b = F.col("dec_g"), F.col("dec_baseline")

    def back(acc: Column, x: Column) -> Column:
        r = x["y"] - b - x["c"]
        w = r + g * acc["w"]
        return F.struct(
            w.alias("w"), (acc["gap"] + r * r).alias("gap"), (acc["sum"] + r).alias("sum"), F.greatest(acc["top"], w).alias("top"),
            F.when(x["s"] > 1e-7, F.least(acc["low"], w)).otherwise(acc["low"]).alias("low"), (acc["size"] + F.abs(r)).alias("size"),
        )

    fold = F.aggregate(F.reverse(rows), start, back)
    ahead = F.zip_with(F.slice("dec", F.lit(2), F.size("dec") - 1), F.slice("dec", F.lit(1), F.size("dec") - 1), lambda c, before: c - g * before)
    misses = F.array_max(F.zip_with(ahead, F.slice("spikes", F.lit(2), F.size("spikes") - 1), lambda a, s: F.abs(a - s)))
    found = found.withColumns({"__f": fold, "__miss": misses, "__least": F.array_min("spikes")})
    size, solved = F.greatest(F.col("__f.size"), F.lit(1e-9)), F.col("__goal").isNotNull()
    penalty = F.coalesce(F.col("__f.low"), F.col("__f.top"))
    near = lambda v: F.abs(v) <= 1e-6 * size
    feasible = (F.col("__least") >= 0) & (F.coalesce("__miss", F.lit(0.0)) <= 1e-9 * (1 + size))
    stationary = near(F.col("__f.top") - penalty) & ((F.col("dec_baseline") <= 1e-12) | near(F.col("__f.sum")))
    slack = F.col("__goal") - F.col("__f.gap")
    flat = F.col("__f.low").isNull() & (F.array_max("dec") <= 1e-9)
    goal = F.col("__goal")
    at_noise = (F.abs(slack) <= 1e-4 * goal) | (flat & (slack > 0)) | (near(penalty) & (slack < 0))
    flags = {"feasible": feasible, "stationary": stationary, "at_noise": at_noise}
    return found.withColumns({k: F.when(solved, v) for k, v in flags.items()}).drop("__goal", "__f", "__miss", "__least")
