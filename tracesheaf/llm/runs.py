"""Periodic runs of words by a dictionary of basic factors.

For each power of two the stretches of so many words get names (equal names, equal words; a name of twice the length is a pair of
names), of which only those that repeat in their text are kept. Successive occurrences no further apart than twice the length
form arithmetic progressions; each one of three or more proposes its difference as a period. Proposals are extended as far as
words a period apart agree, and of runs over the same words the smallest period stays.

A run of period q and at least 4 q words holds, for the power of two from q to below 2 q, the factor at its start three times, and never
closer than q words: so every run is proposed. Texts are worked on where they lie, a batch at a time in arrays: no shuffle, and memory in
proportion to a batch (at least one text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracesheaf.llm.common import text_batches

MIN_WORDS, MIN_PERIODS = 6, 4
RESULT = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
#: White space by byte: the blank and the five controls from tab to carriage return.
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all ``texts`` one after another: their bytes without white space, each word's first byte (and the end), each text's first word (and the end)."""
    whole = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = whole.buffers()
    offsets = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1] if len(whole) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    begins[first] = inside[first]
    begins = np.flatnonzero(begins)
    before = np.cumsum(inside) - inside
    return data[inside], np.append(before[begins], inside.sum()).astype(np.int64), np.searchsorted(begins, offsets)


def word_codes(data: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A number for each word, the same for the same bytes."""
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words) - 1, [None, pa.py_buffer(words), pa.py_buffer(np.ascontiguousarray(data))])
    return found.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def proposals(codes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, period) of every progression of three or more factors, for each power of two; ``bounds``: where texts begin, and the end."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at, name, span = np.arange(len(codes)), text * (codes.max(initial=0) + 1) + codes, 1
    while len(at) > 2:
        order = np.argsort(name, kind="stable")
        p, name = at[order], name[order]
        same, gap = name[1:] == name[:-1], np.diff(p)
        near = same & (gap <= 2 * span)
        three = near[:-1] & near[1:] & (gap[:-1] == gap[1:])
        begins = three & ~np.append(False, three[:-1])
        yield p[:-2][begins], gap[:-1][begins]
        number = np.append(0, np.cumsum(~same))
        again = np.append(same, False) | np.append(False, same)
        named = np.full(len(codes), -1)
        named[p[again]] = number[again]
        at = np.flatnonzero(named >= 0)
        at = at[at + 2 * span <= bounds[text[at] + 1]]
        at = at[named[at + span] >= 0]
        name = named[at] * (number[-1] + 1) + named[at + span]
        span *= 2


def agreement(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading items are equal, looked at in steps that double."""
    n = min(len(a), len(b))
    a, b, done, step = a[:n], b[:n], 0, 64
    while done < n:
        differ = a[done : done + step] != b[done : done + step]
        k = int(differ.argmax())
        if differ[k]:
            return done + k
        done, step = done + len(differ), step * 2
    return n


def find(codes: np.ndarray, bounds: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, in that order; ``start`` counts within the text."""
    if min_periods < 4:
        raise ValueError("runs of fewer than four periods need not hold a progression of three factors")
    both = list(proposals(codes, bounds))
    at, gap = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*both)) if both else (np.zeros(0, np.int64),) * 2
    text = np.searchsorted(bounds, at, "right") - 1
    order = np.lexsort((at, gap, text))
    at, gap, text = at[order], gap[order], text[order]
    edge = np.flatnonzero(np.append(True, (np.diff(gap) != 0) | (np.diff(text) != 0)))[: len(at)]
    found = []
    for k, stop in zip(edge.tolist(), [*edge[1:].tolist(), len(at)]):
        t, d = int(text[k]), int(gap[k])
        lo, hi = int(bounds[t]), int(bounds[t + 1])
        while k < stop:
            i = int(at[k])
            end = i + d + agreement(codes[i : hi - d], codes[i + d : hi])
            start = i - agreement(codes[lo:i][::-1], codes[lo + d : i + d][::-1])
            if end - start >= max(min_words, min_periods * d):
                found.append((t, start - lo, end - start, d))
            k += int(np.searchsorted(at[k:stop], end - d))
    rows = np.array(sorted(found), np.int64).reshape(-1, 4)
    smallest = np.append(True, (np.diff(rows[:, :3], axis=0) != 0).any(axis=1))[: len(rows)]
    rows = rows[smallest]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def collapsed(data: np.ndarray, words: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> pa.Array:
    """Each text without the words that a run holds after its first period, its words joined by one blank."""
    inside = np.zeros(len(words), np.int64)
    first = bounds[rows[:, 0]] + rows[:, 1]
    np.add.at(inside, first + rows[:, 3], 1)
    np.add.at(inside, first + rows[:, 2], -1)
    keep = np.cumsum(inside[: len(words) - 1]) == 0
    size = np.diff(words)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[keep]
    kept = size[keep]
    gap = np.append(text[1:] == text[:-1], False)[: len(kept)].astype(np.int64)
    place = np.cumsum(kept + gap) - kept - gap
    out = np.full(int((kept + gap).sum()), 0x20, np.uint8)
    own = np.cumsum(kept) - kept
    out[np.arange(int(kept.sum())) + np.repeat(place - own, kept)] = data[np.repeat(keep, size)]
    ends = np.zeros(len(bounds), np.int64)
    np.add.at(ends, text + 1, kept + gap)
    ends = np.cumsum(ends)
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(ends), pa.py_buffer(out)).cast(pa.string())


def of_texts(texts: pa.Array, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> pa.StructArray:
    """Number of words, runs and collapsed text of each text."""
    data, words, bounds = split_words(texts)
    rows = find(word_codes(data, words), bounds, min_words, min_periods)
    where = pa.array(np.searchsorted(rows[:, 0], np.arange(len(bounds))), pa.int32())
    runs = pa.StructArray.from_arrays([pa.array(rows[:, k], pa.int64()) for k in (1, 2, 3)], ["start", "length", "period"])
    return pa.StructArray.from_arrays([pa.array(np.diff(bounds), pa.int64()), pa.ListArray.from_arrays(where, runs), collapsed(data, words, bounds, rows)], ["n_words", "runs", "collapsed"])


def find_runs(df: DataFrame, text: str = "text", out: str = "periodic", min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """``df`` with the column ``out``: ``n_words``, all ``runs`` (by start, then period) and the text ``collapsed`` to one period of each.

    A run is a stretch of words with smallest period q and at least max(min_words, min_periods * q) words that no neighbouring
    word extends. Null and word-free texts have no run and collapse to the empty text. Every row is worked on by itself: repeats, ties, null
    ids and an empty table change nothing, and all columns stay, but for one named ``out``, which is replaced. The session's Arrow batches
    are made small for good.
    """
    text_batches(df.sparkSession)
    rest = df.drop(out)
    names = rest.columns
    whole = rest.select("*", F.col(f"`{text}`").cast("string").alias(out))  # the last column is the text, and becomes the result

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], of_texts(batch.column(len(names)), min_words, min_periods)], [*names, out])

    return whole.mapInArrow(work, T.StructType([*rest.schema, T.StructField(out, T.StructType.fromDDL(RESULT))]))
