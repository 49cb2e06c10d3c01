"""Pairwise operators within a field: synchrony, cross-correlation, networks."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesheaf.operators.traces import exact_percentile
from tracesheaf.sources.scratch import saved

#: Regions of a block of the pair jobs, at least and at most, and the values that its trains hold: a task holds two blocks. Regions of either side whose pairs a task holds at a time.
BLOCK, BLOCK_MOST, BLOCK_VALUES, HELD = 128, 16_384, 1 << 22, 1024
#: Frames of event trains that are dense rows at a time; tasks of a pair job at most.
CHUNK, PAIR_TASKS = 4_096, 2048
#: Pairs that leave a task at a time.
BATCH = 1 << 18


def roi_pairs(rois: DataFrame) -> DataFrame:
    """(fov, roi_i, roi_j) with i < j, from rows (fov, roi)."""
    a, b = rois.select("fov", F.col("roi").alias("roi_i")), rois.select("fov", F.col("roi").alias("roi_j"))
    return a.join(b, "fov").where("roi_i < roi_j")


def mirrored(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, in one pass over the edges."""
    ends = F.explode(F.array(F.struct(F.col("roi_i").alias("i"), F.col("roi_j").alias("j")), F.struct(F.col("roi_j").alias("i"), F.col("roi_i").alias("j"))))
    both = edges.withColumn("__ends", ends)
    return both.select(*[F.col(f"__ends.{c[-1]}").alias(c) if c in ("roi_i", "roi_j") else F.col(c) for c in edges.columns])


def interval_matches(left: DataFrame, right: DataFrame, window: int, keys: list[str]) -> DataFrame:
    """Pairs of rows with equal ``keys`` and frames at most ``window`` apart, by an equi-join on frame buckets."""
    size = window + 1
    r = right.withColumn("__b", F.explode(F.array(*[F.floor(F.col("frame") / size) + d for d in (-1, 0, 1)])))
    r = r.withColumnRenamed("frame", "frame_right")
    hit = left.withColumn("__b", F.floor(F.col("frame") / size)).join(r, [*keys, "__b"])
    return hit.where(F.abs(F.col("frame") - F.col("frame_right")) <= window).drop("__b")


def _trains(rois: DataFrame, events: DataFrame) -> DataFrame:
    """(fov, roi, frames): the sorted frames of every region's events, empty where it has none."""
    e = events.groupBy("fov", "roi").agg(F.array_sort(F.collect_set(F.col("frame").cast("long"))).alias("frames"))
    return rois.select("fov", "roi").distinct().join(e, ["fov", "roi"], "left").withColumn("frames", F.coalesce("frames", F.array().cast("array<bigint>")))


def _dense(frames: list[np.ndarray], values: list[np.ndarray] | None, begin: int, end: int, kind: type = np.float32) -> np.ndarray:
    """A row for each train: its values (1 without) on the frames from begin to end."""
    out = np.zeros((len(frames), end - begin), kind)
    for i, f in enumerate(frames):
        lo, hi = np.searchsorted(f, [begin, end])
        out[i, f[lo:hi] - begin] = 1 if values is None else values[i][lo:hi]
    return out


def _chunks(a: list[np.ndarray], b: list[np.ndarray]) -> list[tuple[int, int]]:
    """Frame ranges in which either side has events, CHUNK frames each."""
    last = max((int(f[-1]) for f in [*a, *b] if len(f)), default=-1)
    return [(s, min(s + CHUNK, last + 1)) for s in range(0, last + 1, CHUNK)]


def _sizes(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([len(f) for f in a], float)[:, None], np.array([len(f) for f in b], float)[None, :]


#: What a pair job gives: each pair, each pair in both directions and the diagonal (with the regions' places, of a column ``place``), the pairs of each value (``window``: of each within the field's columns ``low`` and ``high``, side 0, and how many there are on either side with the nearest of these), each region's sum and number of pairs, or for each two blocks (regions ``one`` and ``other``) their
#: square of distances 1 - |value| in UNIT, row by row, -1 where there is no edge.
GIVES = {
    "pairs": "roi_i long, roi_j long, value double", "values": "value double, pairs long", "regions": "roi long, total double, pairs long",
    "distances": "one array<long>, other array<long>, d array<int>",
    "window": "side long, value double, pairs long", "square": "roi_i long, roi_j long, value double", "placed": "row long, col long, roi_i long, roi_j long, value double",
}
#: Distances are whole numbers of this: 8 decimals.
UNIT = 1e-8


def dealt_blocks(trains: DataFrame, columns: tuple[str, ...], block: int | None = None, by: str = "roi", parts: int = 8, most: int = BLOCK_MOST) -> DataFrame:
    """(fov, roi, ``columns``, mine, bi, bj): every train once for each two blocks (bi, bj) of its field that hold it, ``mine`` being its own, dealt to a task for each few of these.

    Regions are hashed by ``by`` to blocks: ``parts`` of a field, or more where they would hold over ``most`` regions.
    """
    longest = F.max(F.greatest(F.lit(1), *[F.size(c) for c in columns if dict(trains.dtypes)[c].startswith("array")], F.lit(1)))
    own = F.greatest(F.lit(BLOCK), F.least(F.lit(most), F.ceil(F.col("n") / parts), F.floor(F.lit(BLOCK_VALUES) / F.col("longest")))) if block is None else F.lit(block)
    fields = trains.groupBy("fov").agg(F.count("*").alias("n"), longest.alias("longest")).select("fov", F.greatest(F.lit(1), F.ceil(F.col("n") / own).cast("int")).alias("__k"))
    fields = saved(fields, "fields")
    groups = fields.agg(F.sum(F.col("__k").cast("long") * (F.col("__k") + 1) / 2)).first()[0] or 1
    t = trains.select("fov", "roi", *columns).join(F.broadcast(fields), "fov")
    t = t.withColumn("mine", F.pmod(F.xxhash64(by), F.col("__k")).cast("int")).withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__k") - 1)))
    t = t.select("fov", "roi", *columns, "mine", F.least("mine", "__o").alias("bi"), F.greatest("mine", "__o").alias("bj"))
    return t.repartition(max(1, min(PAIR_TASKS, int(groups))), "fov", "bi", "bj")


def _given(give: str, v: np.ndarray, keep: np.ndarray | None, one: np.ndarray, other: np.ndarray, ids: np.ndarray, place: np.ndarray | None, diagonal: bool, window: tuple[float, float] | None = None) -> Iterator[list[np.ndarray]]:
    """The columns that ``give`` asks for (see GIVES), from the values of rows ``one`` with rows ``other``, of which those in ``keep`` count (None: all)."""
    if give in ("pairs", "square", "placed"):
        if keep is None:
            left, right, v = np.repeat(one, len(other)), np.tile(other, len(one)), v.ravel()
        else:
            left, right = np.nonzero(keep)
            left, right, v = one[left], other[right], v[left, right]
        if give == "pairs":
            left, right = ids[left], ids[right]
            yield [np.minimum(left, right), np.maximum(left, right), v]
            return
        for a, b in ((left, right), (right, left), *([(one, one)] if diagonal else [])):
            yield [*([] if place is None else [place[a], place[b]]), ids[a], ids[b], v if a is not b else np.ones(len(one))]
        return
    keep = np.ones(v.shape, bool) if keep is None else keep
    if give == "values":
        yield list(np.unique(v[keep], return_counts=True))
    elif give == "window":
        v = v[keep]
        under, over = v < window[0], np.zeros(len(v), bool) if np.isnan(window[1]) else ~(v <= window[1])
        value, n = np.unique(v[~(under | over)], return_counts=True)
        for side, far, nearest in ((-1, v[under], np.max), (1, v[over], np.min)):
            if len(far):
                yield [np.array([side]), np.array([nearest(far)]), np.array([len(far)])]
        yield [np.zeros(len(value), np.int64), value, n]
    elif give == "distances":
        far = 1 - np.abs(v[keep])
        if np.isnan(far).any():
            raise ValueError("a correlation is no number")
        d = np.full(v.shape, -1, np.int32)
        d[keep] = np.maximum(np.floor(far * 1e8 + 0.5), 0)
        yield [ids[one], ids[other], d.ravel()]
    else:
        n, kept = [keep.sum(axis=k) for k in (1, 0)], np.where(keep, v, 0.0)
        out = [np.concatenate(x) for x in ([ids[one], ids[other]], [kept.sum(axis=k) for k in (1, 0)], n)]
        yield [x[out[2] > 0] for x in out]


def block_pairs(trains: DataFrame, kernel: Callable, columns: tuple[str, ...] = ("frames",), block: int | None = None, give: str = "pairs") -> DataFrame:
    """(fov, roi_i, roi_j, value) for all pairs i < j of a field, from trains (fov, roi and ``columns``); other rows by ``give`` (see GIVES).

    Regions are hashed to blocks, each pair of blocks is one group, and ``kernel`` gives the matrix of up to HELD regions of either from their columns, or that and which
    pairs count. What is shuffled is each train once for each block of its field, eight times however many regions that has; of the pairs only what is asked for leaves a task, and
    no task holds those of more than HELD regions with as many. The number of tasks goes by the pairs of blocks, as small trains make much work.
    """
    fov_type = dict(trains.dtypes)["fov"]
    kinds = [part.split() for part in GIVES[give].split(", ")]

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        ids, mine = rows["roi"].to_numpy(), rows["mine"].to_numpy()
        place = rows["place"].to_numpy() if give == "placed" else None
        held = {c: [x.values.to_numpy(zero_copy_only=False) for x in rows[c]] if pa.types.is_list(rows[c].type) else rows[c].to_pylist() for c in columns}
        one, other = (np.flatnonzero(mine == key[k].as_py()) for k in (1, 2))
        same = key[1].as_py() == key[2].as_py()
        for i in range(0, len(one), HELD):
            for j in range(i if same else 0, len(other), HELD):
                sides = [one[i : i + HELD], other[j : j + HELD]]
                diagonal = same and i == j
                a, b = ({c: [x[k] for k in at] for c, x in held.items()} for at in sides)
                v = kernel(a, a if diagonal else b)
                v, keep = v if isinstance(v, tuple) else (v, None)
                if same:
                    apart = ids[sides[0]][:, None] != ids[sides[1]]
                    apart = np.triu(apart, 1) if diagonal else apart
                    keep = apart if keep is None else keep & apart
                keep = None if keep is None or keep.all() else keep
                for found in _given(give, v, keep, *sides, ids, place, diagonal, (held["low"][0], held["high"][0]) if give == "window" else None):
                    fov = pa.array([key[0].as_py()], rows.schema.field("fov").type)
                    if give == "distances":
                        yield pa.RecordBatch.from_arrays([fov, *[pa.array([x]) for x in found]], names=["fov", "one", "other", "d"])
                    elif len(found[0]):
                        columns_ = [pa.array(x, pa.int64() if kind == "long" else pa.float64()) for x, (_, kind) in zip(found, kinds)]
                        fov = fov.take(pa.array(np.zeros(len(found[0]), np.int64)))
                        yield from pa.Table.from_arrays([fov, *columns_], names=["fov", *[name for name, _ in kinds]]).to_batches(BATCH)

    return dealt_blocks(trains, columns, block).groupBy("fov", "bi", "bj").applyInArrow(run, f"fov {fov_type}, {GIVES[give]}")


def jitter_synchrony(rois: DataFrame, events: DataFrame, window: int = 2, give: str = "pairs", trains: DataFrame | None = None) -> DataFrame:
    """M1: (fov, roi_i, roi_j, value), the share of events that have one of the other region within ``window`` frames."""

    def kernel(a: dict, b: dict) -> np.ndarray:
        hits = np.zeros((len(a["frames"]), len(b["frames"])))
        wide = lambda frames: [np.unique((f[:, None] + np.arange(-window, window + 1)).ravel()) for f in frames]
        near_a, near_b = wide(a["frames"]), wide(b["frames"])
        for s, e in _chunks(a["frames"], b["frames"]):
            hits += _dense(a["frames"], None, s, e) @ _dense(near_b, None, s, e).T + _dense(near_a, None, s, e) @ _dense(b["frames"], None, s, e).T
        n, m = _sizes(a["frames"], b["frames"])
        return np.where((n > 0) & (m > 0), hits / np.maximum(n + m, 1), 0.0)

    return block_pairs(_trains(rois, events) if trains is None else trains, kernel, give=give)


def lag_synchrony(rois: DataFrame, events: DataFrame, max_lag: int = 5, give: str = "pairs", trains: DataFrame | None = None) -> DataFrame:
    """The best coincidence count over lags up to ``max_lag``, over the root of both counts, within 0 to 1."""

    def kernel(a: dict, b: dict) -> np.ndarray:
        n, m = _sizes(a["frames"], b["frames"])
        best, chunks = np.zeros((n.shape[0], m.shape[1])), _chunks(a["frames"], b["frames"])
        for lag in range(-max_lag, max_lag + 1):
            best = np.maximum(best, sum(_dense(a["frames"], None, s, e) @ _dense(b["frames"], None, s + lag, e + lag).T for s, e in chunks)) if chunks else best
        return np.where((n > 0) & (m > 0), np.minimum(1.0, best / np.sqrt(np.maximum(n * m, 1))), 0.0)

    return block_pairs(_trains(rois, events) if trains is None else trains, kernel, give=give)


def correlation_synchrony(rois: DataFrame, events: DataFrame, frames: DataFrame, give: str = "pairs", trains: DataFrame | None = None) -> DataFrame:
    """M3: |Pearson| of binary trains in closed form from counts; 0 where a train is constant. ``frames``: (fov, n_frames)."""

    def kernel(a: dict, b: dict) -> np.ndarray:
        n, m = _sizes(a["frames"], b["frames"])
        t = float((a["n_frames"] + b["n_frames"])[0])
        both = sum((_dense(a["frames"], None, s, e) @ _dense(b["frames"], None, s, e).T for s, e in _chunks(a["frames"], b["frames"])), np.zeros((n.shape[0], m.shape[1])))
        spread = n * (t - n) * m * (t - m)
        return np.where(spread > 0, np.abs(t * both - n * m) / np.sqrt(np.where(spread > 0, spread, 1)), 0.0)

    lengths = F.broadcast(frames.select("fov", F.col("n_frames").cast("double").alias("n_frames")))
    trains = _trains(rois, events) if trains is None else trains
    return block_pairs(trains.join(lengths, "fov"), kernel, ("frames", "n_frames"), give=give)


def synchrony(method: str, rois: DataFrame, events: DataFrame, frames: DataFrame, window: int = 2, max_lag: int = 5, give: str = "pairs", trains: DataFrame | None = None) -> DataFrame:
    """Edges by method name: ``jitter_window``, ``cross_correlation``, anything else correlation."""
    if method == "jitter_window":
        return jitter_synchrony(rois, events, window, give, trains)
    return lag_synchrony(rois, events, max_lag, give, trains) if method == "cross_correlation" else correlation_synchrony(rois, events, frames, give, trains)


def synchronies(methods: list[str], rois: DataFrame, events: DataFrame, frames: DataFrame, window: int = 2, max_lag: int = 5) -> DataFrame:
    """The edges of several methods, with the column ``method``; trains and lengths are made once and saved, as the pair jobs read them twice each."""
    trains, frames = saved(_trains(rois, events), "trains"), saved(frames.select("fov", "n_frames"), "lengths")
    parts = [synchrony(m, rois, events, frames, window, max_lag, trains=trains).withColumn("method", F.lit(m)) for m in methods]
    return reduce(DataFrame.unionByName, parts)


def global_synchrony(edges: DataFrame) -> DataFrame:
    """A10: (fov, value), the median over regions of their mean edge; fields with under two regions have no row.

    ``edges`` may be the sums by region that a pair job gives (``give="regions"``), so that no pair leaves its task.
    """
    if "total" in edges.columns:
        each = edges.groupBy("fov", "roi").agg((F.sum("total") / F.sum("pairs")).alias("m"))
    else:
        each = mirrored(edges).groupBy("fov", "roi_i").agg(F.avg("value").alias("m"))
    return each.groupBy("fov").agg(F.percentile("m", 0.5).alias("value"))


def matrix(edges: DataFrame, diagonal: float = 1.0, regions: DataFrame | None = None) -> DataFrame:
    """The full square: both directions and the fixed diagonal of all regions that have an edge; ``regions`` (fov, roi), where they are known, save a run over the edges."""
    both = mirrored(edges)
    own = both.select("fov", F.col("roi_i").alias("roi")).distinct() if regions is None else regions
    return both.unionByName(own.select("fov", F.col("roi").alias("roi_i"), F.col("roi").alias("roi_j"), F.lit(diagonal).alias("value")))


#: Values of which spectra are held at once in a correlation task, whatever the length of traces; frames up to which lags are products of matrices.
SPECTRUM_VALUES, DIRECT_FRAMES = 1 << 22, 256
#: Regions of either side whose products are held at a time.
TILE = 256


def _centred(traces: list[np.ndarray], absolute: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The traces as rows, their norms, and which are flat."""
    x = np.array(traces, float)
    if not absolute:
        x = x - x.mean(axis=1, keepdims=True)
    norm = np.sqrt((x * x).sum(axis=1))
    return x, norm, norm <= 1e-12 * np.sqrt(x.shape[1]) * (1 + np.abs(x).max(axis=1))


def _direct(x: np.ndarray, y: np.ndarray, absolute: bool) -> np.ndarray:
    """As ``_best_lag``, by products of matrices, in squares of TILE rows that stay in a core's cache over all lags; where ``y`` is ``x``, squares below the diagonal are those above it."""
    size = x.shape[1]
    best = np.empty((len(x), len(y)), x.dtype)
    held, turned = np.empty((2, min(TILE, len(x)) * min(TILE, len(y))), x.dtype), np.ascontiguousarray(y.T)
    for i in range(0, len(x), TILE):
        a = np.ascontiguousarray(x[i : i + TILE])
        for j in range(i if y is x else 0, len(y), TILE):
            b = np.ascontiguousarray(turned[:, j : j + TILE])
            c, top = (h[: a.shape[0] * b.shape[1]].reshape(a.shape[0], b.shape[1]) for h in held)
            top.fill(0 if absolute else -np.inf)
            for lag in range(1 - size, size):
                np.matmul(a[:, max(0, lag) : size + min(0, lag)], b[max(0, -lag) : size - max(0, lag)], out=c)
                np.maximum(top, np.abs(c, out=c) if absolute else c, out=top)
            best[i : i + TILE, j : j + TILE] = top
            if y is x and j > i:
                best[j : j + TILE, i : i + TILE] = top.T
    return best if absolute else np.maximum(best, 0.0)  # at the lag of the whole length nothing overlaps


#: Lags whose counts one product holds, eight bits each, and what makes their sum the low bits of a double.
PACKED, LOW = 6, 2.0**52


def _counted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """As ``_direct`` for trains of 0 and 1 of up to 255 frames: a product of matrices gives the counts of PACKED lags, as bytes of a whole number that a double holds."""
    size = x.shape[1]
    best, turned = np.empty((len(x), len(y))), np.ascontiguousarray(y.T)
    held, most = np.empty(min(TILE, len(x)) * min(TILE, len(y))), np.empty(min(TILE, len(x)) * min(TILE, len(y)) * 8, np.uint8)
    for i in range(0, len(x), TILE):
        a = x[i : i + TILE]
        packs = []
        for first in range(1 - size, size, PACKED):
            lags = range(first, min(first + PACKED, size))
            begin, end = max(0, -lags[-1]), min(size, size - first)
            pack = np.zeros((len(a), end - begin))
            for k, lag in enumerate(lags):
                lo, hi = max(0, -lag), size - max(0, lag)
                pack[:, lo - begin : hi - begin] += a[:, lo + lag : hi + lag] * 256.0**k
            packs.append((pack, begin, end))
        for j in range(i if y is x else 0, len(y), TILE):
            b = np.ascontiguousarray(turned[:, j : j + TILE])
            c, top = held[: len(a) * b.shape[1]].reshape(len(a), b.shape[1]), most[: len(a) * b.shape[1] * 8]
            top.fill(0)
            for pack, begin, end in packs:
                np.matmul(pack, b[begin:end], out=c)
                np.maximum(top, np.add(c, LOW, out=c).view(np.uint8).ravel(), out=top)
            each = top.reshape(*c.shape, 8)
            best[i : i + TILE, j : j + TILE] = reduce(np.maximum, [each[:, :, k] for k in range(PACKED)])
            if y is x and j > i:
                best[j : j + TILE, i : i + TILE] = best[i : i + TILE, j : j + TILE].T
    return best


def _best_lag(x: np.ndarray, y: np.ndarray, absolute: bool) -> np.ndarray:
    """The greatest product sum (``absolute``: by absolute value) over all lags of every row of ``x`` with every row of ``y``.

    Trains of small whole numbers have the same sums in single precision.
    """
    size = x.shape[1]
    if size <= DIRECT_FRAMES:
        if absolute and size < 256 and sys.byteorder == "little" and all(((z == 0) | (z == 1)).all() for z in (x, y)):
            return _counted(x, y)
        whole = all((z == np.rint(z)).all() and np.abs(z).max(initial=0) <= 64 for z in (x, y))
        if whole:
            single = x.astype(np.float32)
            return _direct(single, single if y is x else y.astype(np.float32), absolute).astype(float)
        return _direct(x, y, absolute)
    best = np.full((len(x), len(y)), -np.inf)
    step = max(1, SPECTRUM_VALUES // (2 * size))
    for i in range(0, len(x), step):
        a = np.fft.rfft(x[i : i + step], 2 * size, axis=1)
        for j in range(0, len(y), step):
            b = np.conj(np.fft.rfft(y[j : j + step], 2 * size, axis=1))
            for k in range(len(a)):
                c = np.fft.irfft(a[k] * b, 2 * size, axis=1)
                best[i + k, j : j + step] = np.abs(c).max(axis=1) if absolute else c.max(axis=1)
    return best


def correlations(one: list[np.ndarray], other: list[np.ndarray], absolute: bool, single: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The matrix of best normalised correlations of two lists of traces (of one list, where they are the same), and which of them are of equal length; ``single``: within ``single_error``, at half the cost."""
    sizes = [np.array([len(x) for x in side], int) for side in (one, other)]
    value, keep = np.zeros((len(one), len(other))), (sizes[0][:, None] == sizes[1]) & (sizes[0][:, None] > 0)
    for size in np.intersect1d(*sizes):
        if size:
            at = [np.flatnonzero(s == size) for s in sizes]
            x, norm_x, flat_x = _centred([one[k] for k in at[0]], absolute)
            y, norm_y, flat_y = (x, norm_x, flat_x) if other is one else _centred([other[k] for k in at[1]], absolute)
            with np.errstate(divide="ignore", invalid="ignore"):
                if single and size <= DIRECT_FRAMES:
                    x32 = (x / norm_x[:, None]).astype(np.float32)
                    found = np.where(flat_x[:, None] | flat_y, np.float32(0), _direct(x32, x32 if y is x else (y / norm_y[:, None]).astype(np.float32), absolute))
                else:
                    found = np.where(flat_x[:, None] | flat_y, 0.0, _best_lag(x, y, absolute) / (norm_x[:, None] * norm_y))
            if keep.all():
                return found, keep
            value[np.ix_(*at)] = found
    return value, keep


def single_error(size: int) -> float:
    """How far a correlation in single precision is off at most: sums of ``size`` products of what has a norm of 1."""
    return (size + 8) * 2.0**-24


def some_correlations(one: list[np.ndarray], other: list[np.ndarray], left: np.ndarray, right: np.ndarray, absolute: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """``correlations`` of the pairs (``left``, ``right``) alone, from spectra."""
    sizes = [np.array([len(x) for x in side], int) for side in (one, other)]
    value, keep = np.zeros(len(left)), (sizes[0][left] == sizes[1][right]) & (sizes[0][left] > 0)
    for size in np.unique(sizes[0][left[keep]]).tolist():
        at = np.flatnonzero(keep & (sizes[0][left] == size))
        step = max(1, SPECTRUM_VALUES // (16 * size))
        for k in range(0, len(at), step):
            sides = []
            for side, ends in ((one, left), (other, right)):
                own, which = np.unique(ends[at[k : k + step]], return_inverse=True)
                x, norm, flat = _centred([side[i] for i in own], absolute)
                sides.append((np.fft.rfft(x, 2 * size, axis=1)[which], norm[which], flat[which]))
            (a, norm_a, flat_a), (b, norm_b, flat_b) = sides
            best = np.fft.irfft(a * np.conj(b), 2 * size, axis=1)
            best = np.abs(best).max(axis=1) if absolute else np.maximum(best.max(axis=1), 0.0)
            with np.errstate(divide="ignore", invalid="ignore"):
                value[at[k : k + step]] = np.where(flat_a | flat_b, 0.0, best / (norm_a * norm_b))
    return value, keep


def _correlated(traces: DataFrame, trace: str) -> DataFrame:
    return traces.select("fov", "roi", F.col(trace).cast("array<double>").alias("trace")).where("trace is not null")


def trace_correlation(traces: DataFrame, trace: str = "trace", absolute: bool = False, block: int | None = None, give: str = "pairs", least: DataFrame | None = None) -> DataFrame:
    """M8, M9: best normalised correlation over all lags of z-scored traces (``absolute``: of raw trains, by absolute value).

    A pair job by blocks. Traces of unequal length are not paired; a flat trace correlates 0. Lags of short traces are products of
    matrices, those of longer ones come from as many spectra as SPECTRUM_VALUES allows. ``least`` (fov, threshold): pairs below their field's threshold do not leave the tasks.
    """
    rows = _correlated(traces, trace)
    if least is None:
        return block_pairs(rows, lambda a, b: correlations(a["trace"], b["trace"], absolute), ("trace",), block, give)

    def kernel(a: dict, b: dict) -> tuple[np.ndarray, np.ndarray]:
        v, keep = correlations(a["trace"], b["trace"], absolute)
        return v, keep & ~(v < a["threshold"][0])

    return block_pairs(rows.join(F.broadcast(least.select("fov", "threshold")), "fov"), kernel, ("trace", "threshold"), block, give)


#: Regions of a field whose pairs show about where its threshold lies, at least and at most, and how far to either side, as a share of all pairs, it is looked for first.
GUESS, ABOUT = (1024, 4096), 0.005


def links(traces: DataFrame, percentile: float = 90.0, trace: str = "trace", absolute: bool = False) -> DataFrame:
    """(fov, threshold, edges): the percentile of a field's correlations, as ``thresholds`` of ``trace_correlation``, and how many pairs reach it, from one run over all pairs.

    Pairs of some regions say about where the threshold lies. The run over all pairs counts what is below and above that and lets only the values between out, so the
    rank is exact; fields whose rank does not lie there are run again with a wider range, in the end with every value.
    """
    rows, q = _correlated(traces, trace), percentile / 100
    kernel = lambda a, b: correlations(a["trace"], b["trace"], absolute)
    n = saved(rows.groupBy("fov").agg(F.count("*").alias("n")), "fields")
    some = F.pmod(F.xxhash64("roi"), "n") < F.least(F.lit(GUESS[1]), F.greatest(F.lit(GUESS[0]), F.col("n") / 2))
    near = block_pairs(rows.join(F.broadcast(n), "fov").where(some), kernel, ("trace",))
    ends = F.percentile_approx("value", [max(0.0, q - ABOUT), min(1.0, q + ABOUT)], 10_000)
    bounds = n.join(near.groupBy("fov").agg(ends.alias("ends")), "fov", "left")
    bounds = saved(bounds.select("fov", *[F.coalesce(F.get("ends", F.lit(k)), F.lit(float(far))).alias(c) for k, c, far in ((0, "low", "-inf"), (1, "high", "inf"))]), "bounds")
    found, turn = None, 0
    while turn == 0 or not bounds.isEmpty():
        turn += 1
        counted = saved(block_pairs(rows.join(F.broadcast(bounds), "fov"), kernel, ("trace", "low", "high"), give="window"), "window")
        twice = counted.withColumn("twice", 2 * F.col("pairs"))
        side = lambda k: F.sum(F.when(F.col("side") == k, F.col("twice")).otherwise(0))  # noqa: B023, E731
        at = (F.sum("twice") - 1) * F.lit(q)
        ranks = twice.groupBy("fov").agg(((F.floor(at) >= side(-1)) & (F.ceil(at) < F.sum("twice") - side(1))).alias("held"))
        ranks = saved(ranks, "ranks")
        thr = exact_percentile(twice.join(F.broadcast(ranks.where("held")), "fov", "left_semi"), "value", q, ["fov"], "twice").select("fov", F.col("q").alias("threshold"))
        thr = saved(thr, "thresholds")
        edges = counted.join(F.broadcast(thr), "fov").groupBy("fov").agg(F.first("threshold").alias("threshold"), F.sum(F.when(F.col("value") >= F.col("threshold"), F.col("pairs")).otherwise(0)).alias("edges"))
        found = edges if found is None else found.unionByName(edges)
        width = F.col("high") - F.col("low")
        wider = [(F.col("low") - 4 * width - 1e-3).alias("low"), (F.col("high") + 4 * width + 1e-3).alias("high")] if turn < 3 else [F.lit(float(x)).alias(c) for x, c in (("-inf", "low"), ("nan", "high"))]
        bounds = saved(bounds.join(F.broadcast(ranks.where("not held")), "fov", "left_semi").select("fov", *wider), "bounds")
    return saved(found, "links")


def trace_square(traces: DataFrame, trace: str = "trace", absolute: bool = False, places: DataFrame | None = None) -> DataFrame:
    """The rows of ``matrix`` for ``trace_correlation``, both directions and the diagonal as they leave the tasks; with ``places`` (fov, roi, place) also ``row`` and ``col``."""
    rows = traces.select("fov", "roi", F.col(trace).cast("array<double>").alias("trace")).join(correlated_regions(traces, trace), ["fov", "roi"], "left_semi")
    columns = ("trace",) if places is None else ("trace", "place")
    rows = rows if places is None else rows.join(places, ["fov", "roi"])
    return block_pairs(rows, lambda a, b: correlations(a["trace"], b["trace"], absolute), columns, give="square" if places is None else "placed")


def correlated_regions(traces: DataFrame, trace: str = "trace") -> DataFrame:
    """(fov, roi) of the regions that ``trace_correlation`` pairs: those with another of equal length in their field."""
    r = traces.select("fov", "roi", F.size(trace).alias("size")).where("size > 0").distinct()
    n = r.groupBy("fov", "size").agg(F.count("*").alias("n")).where("n > 1")
    return r.join(F.broadcast(n), ["fov", "size"], "left_semi").select("fov", "roi").distinct()


def paired_regions(rois: DataFrame) -> DataFrame:
    """(fov, roi) of fields with two regions or more."""
    r = rois.select("fov", "roi").distinct()
    return r.join(F.broadcast(r.groupBy("fov").agg(F.count("*").alias("n")).where("n > 1")), "fov", "left_semi")


def thresholds(edges: DataFrame, percentile: float = 90.0) -> DataFrame:
    """(fov, threshold): percentile of off-diagonal values, each pair twice; ``edges`` may be the counts by value that a pair job gives (``give="values"``)."""
    twice = edges.withColumn("__twice", F.lit(2) * (F.col("pairs") if "pairs" in edges.columns else F.lit(1)))
    return exact_percentile(twice, "value", percentile / 100, ["fov"], "__twice", coarse="pairs" not in edges.columns).select("fov", F.col("q").alias("threshold"))


def connectivity(edges: DataFrame, percentile: float = 90.0, values: DataFrame | None = None) -> DataFrame:
    """Adds threshold (see ``thresholds``, of ``values`` where these are given) and connected (value at least that)."""
    thr = saved(thresholds(edges if values is None else values, percentile), "thresholds")
    return edges.join(F.broadcast(thr), "fov").withColumn("connected", F.col("value") >= F.col("threshold"))


def network_statistics(connected: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """(fov, nodes, edges, density_pct) of a connectivity edge list, or of counts by value with ``connected`` and the ``regions`` (fov, roi) that have an edge."""
    own = mirrored(connected.select("fov", "roi_i", "roi_j")).select("fov", F.col("roi_i").alias("roi")) if regions is None else regions
    nodes = own.groupBy("fov").agg(F.countDistinct("roi").alias("nodes"))
    many = F.coalesce(F.sum(F.when(F.col("connected"), F.col("pairs"))), F.lit(0)) if "pairs" in connected.columns else F.count(F.when(F.col("connected"), 1))
    edges = connected.groupBy("fov").agg(many.alias("edges"))
    n = F.col("nodes")
    return nodes.join(edges, "fov").withColumn("density_pct", F.when(n > 1, 100.0 * F.col("edges") * 2 / (n * (n - 1))).otherwise(0.0))


def network_edges(connected: DataFrame, geometry: DataFrame) -> DataFrame:
    """Connected pairs with weight, sign and both centroids. ``geometry``: (fov, roi, cy, cx).

    The places, a row for each region, are broadcast: pairs are many times more.
    """
    ends = [F.broadcast(geometry.select("fov", F.col("roi").alias(f"roi_{k}"), F.col("cy").alias(f"cy_{k}"), F.col("cx").alias(f"cx_{k}"))) for k in "ij"]
    e = connected.where("connected").select("fov", "roi_i", "roi_j", F.abs("value").alias("weight"), F.signum("value").cast("int").alias("sign"))
    return e.join(ends[0], ["fov", "roi_i"]).join(ends[1], ["fov", "roi_j"])


def phase_locking(events: DataFrame, frames: DataFrame) -> DataFrame:
    """|mean of exp(i phase difference)| of linear phases between successive peaks, over frames where both are defined."""

    def spread(frames: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        at, phase = [], []
        for f in frames:
            gaps = np.diff(f)
            at.append(np.arange(f[0], f[-1]) if len(f) > 1 else np.zeros(0, np.int64))
            step = at[-1] - np.repeat(f[:-1], gaps) if len(f) > 1 else at[-1]
            phase.append(np.exp(2j * np.pi * step / np.repeat(gaps, gaps)))
        return at, phase

    def kernel(a: dict, b: dict) -> np.ndarray:
        (fa, pa_), (fb, pb) = spread(a["frames"]), spread(b["frames"])
        total, count = np.zeros((len(fa), len(fb)), complex), np.zeros((len(fa), len(fb)))
        for s, e in _chunks(fa, fb):
            total += _dense(fa, pa_, s, e, complex) @ _dense(fb, pb, s, e, complex).conj().T
            count += _dense(fa, None, s, e) @ _dense(fb, None, s, e).T
        return np.abs(total) / np.maximum(count, 1), count > 0

    return block_pairs(_trains(events, events), kernel)
