"""Shapes in small arrays: distances, rings and the stimulation filter of one window. Spark deals the windows; see pixels.py."""

from __future__ import annotations

from math import isqrt

import numpy as np

#: The filter's closing, erosion and closing, as (radius, grow), and how far they reach together.
MORPHOLOGY = ((2, True), (2, False), (2, False), (5, True), (5, False))
REACH = sum(r for r, _ in MORPHOLOGY)


def l1_distance(mask: np.ndarray) -> np.ndarray:
    """Steps to the nearest True, by a running minimum of place minus and plus distance along rows, then columns."""
    d = np.where(mask, 0, sum(mask.shape))
    for axis in (1, 0):
        i = np.arange(d.shape[axis])[None, :] if axis else np.arange(d.shape[0])[:, None]
        before = np.minimum.accumulate(d - i, axis) + i
        after = np.flip(np.minimum.accumulate(np.flip(d + i, axis), axis), axis) - i
        d = np.minimum(before, after)
    return d


def around(ys: np.ndarray, xs: np.ndarray, reach: int, height: int, width: int) -> tuple[np.ndarray, int, int]:
    """Distances from the pixels in their window of ``reach`` on all sides, and its first row and column; it leaves the image only for pixels that do."""
    y0, x0 = max(ys.min() - reach, min(0, ys.min())), max(xs.min() - reach, min(0, xs.min()))
    y1, x1 = min(ys.max() + reach, max(height - 1, ys.max())), min(xs.max() + reach, max(width - 1, xs.max()))
    mask = np.zeros((y1 - y0 + 1, x1 - x0 + 1), bool)
    mask[ys - y0, xs - x0] = True
    return l1_distance(mask), int(y0), int(x0)


def within(y0: int, x0: int, shape: tuple[int, int], height: int, width: int) -> np.ndarray:
    """Which pixels of a window lie in the image."""
    y, x = np.arange(y0, y0 + shape[0]), np.arange(x0, x0 + shape[1])
    return ((y >= 0) & (y < height))[:, None] & ((x >= 0) & (x < width))


def growth(ys: np.ndarray, xs: np.ndarray, steps: int, height: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(y, x, distance) of the pixels and of all within ``steps`` of them in the image."""
    d, y0, x0 = around(ys, xs, steps, height, width)
    y, x = np.nonzero((d <= steps) & (within(y0, x0, d.shape, height, width) | (d == 0)))
    return y + y0, x + x0, d[y, x]


def ring(ys: np.ndarray, xs: np.ndarray, free: np.ndarray, inner: int, least: int, step: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(y, x) of the smallest growth by ``step`` beyond ``inner`` that holds ``least`` free pixels; without one, of the last. ``free``: the image's pixels outside all regions."""
    span = 4
    while True:
        span = min(span, rounds)
        d, y0, x0 = around(ys, xs, inner + span * step, *free.shape)
        inside = within(y0, x0, d.shape, *free.shape)
        near = np.zeros(d.shape, bool)
        near[inside] = free[max(y0, 0) : y0 + d.shape[0], max(x0, 0) : x0 + d.shape[1]].ravel()
        near &= (d > inner) & (d <= inner + span * step)
        k = -((inner - d) // step)  # the step that reaches a pixel
        held = np.cumsum(np.bincount(k[near], minlength=span + 1))
        if held[-1] >= least or span == rounds:
            need = int(np.searchsorted(held, least)) if held[-1] >= least else span
            y, x = np.nonzero(near & (k <= need))
            return y + y0, x + x0
        span *= 4


def smooth(value: np.ndarray, held: np.ndarray, kernel: list[tuple[int, float]]) -> np.ndarray:
    """A separable filter with edge samples repeated; pixels that are not held count as 0 and get 0."""
    v = np.where(held, value, 0.0)
    for axis in (0, 1):
        n = v.shape[axis]
        v = np.where(held, sum(w * np.take(v, np.clip(np.arange(n) + k, 0, n - 1), axis) for k, w in kernel), 0.0)
    return v


def _moved(v: np.ndarray, by: int, axis: int, fill: int) -> np.ndarray:
    out = np.full_like(v, fill)
    n = v.shape[axis]
    if abs(by) < n:
        to, of = [slice(None)] * 2, [slice(None)] * 2
        to[axis], of[axis] = slice(max(0, -by), n - max(0, by)), slice(max(0, by), n - max(0, -by))
        out[tuple(to)] = v[tuple(of)]
    return out


def extreme(v: np.ndarray, radius: int, grow: bool) -> np.ndarray:
    """Maximum or minimum over a disk of zeros and ones, -1 where there is no pixel, which counts for nothing; a row's running extreme is widened step by step."""
    none = -1 if grow else 2
    pick = np.maximum if grow else np.minimum
    v = np.where(v < 0, none, v)
    wide = [v]
    for k in range(1, radius + 1):
        wide.append(pick(wide[-1], pick(_moved(v, k, 1, none), _moved(v, -k, 1, none))))
    out = np.full_like(v, none)
    for dy in range(-radius, radius + 1):
        out = pick(out, _moved(wide[isqrt(radius * radius - dy * dy)], dy, 0, none))
    return np.where(out == none, -1, out)


def closed(bright: np.ndarray, held: np.ndarray) -> np.ndarray:
    """The pixels that the closing, erosion and closing leave."""
    v = np.where(held, bright.astype(np.int8), -1).astype(np.int8)
    for radius, grow in MORPHOLOGY:
        v = extreme(v, radius, grow)
    return v == 1
