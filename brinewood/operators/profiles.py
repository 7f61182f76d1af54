"""Measures of one page's ink in arrays: what ``pages`` says in rows of all pages, for the step that needs a page's ink many times over.

A page's runs come as three arrays (y, x0, x1), merged; every function gives what its namesake in ``pages`` gives for that page, to the last digit:
percentiles and rounding are Spark's. Fixed values are arguments, as ``pages`` has them.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


def percentile(values: np.ndarray, share: float) -> float:
    """Spark's exact percentile of whole numbers."""
    at = (values.size - 1) * share
    low, high = int(np.floor(at)), int(np.ceil(at))
    part = np.partition(values, (low, high))
    a, b = int(part[low]), int(part[high])
    return float(a) if a == b else (high - at) * a + (at - low) * b


def half_up(x: float, digits: int) -> float:
    """Spark's round."""
    return float(Decimal(repr(float(x))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def stretches(at: np.ndarray, gap: int) -> list[np.ndarray]:
    """Sorted positions, cut where two are further apart than ``gap``."""
    return np.split(at, np.flatnonzero(np.diff(at) > gap) + 1) if at.size else []


def row_ink(runs: Runs, x0: int, x1: int, y0: int, y1: int) -> np.ndarray:
    """Ink of every row of a box."""
    y, a, b = runs
    n = np.minimum(b, x1) - np.maximum(a, x0)
    inside = (n > 0) & (y >= y0) & (y < y1)
    return np.bincount(y[inside] - y0, weights=n[inside], minlength=max(0, y1 - y0)).astype(np.int64)


def column_ink(runs: Runs, x0: int, x1: int, y0: int, y1: int) -> np.ndarray:
    """Ink of every column of a box: a running sum of where runs begin and end."""
    y, a, b = runs
    lo, hi = np.maximum(a, x0), np.minimum(b, x1)
    inside = (hi > lo) & (y >= y0) & (y < y1)
    size = max(0, x1 - x0) + 1
    return np.cumsum(np.bincount(lo[inside] - x0, minlength=size) - np.bincount(hi[inside] - x0, minlength=size))[:-1]


def _bare(n: np.ndarray, least: float) -> tuple[int, int]:
    """How many places stand solid at the start, and at the end."""
    open_ = np.flatnonzero(~((n > 0) & (n >= least)))
    return (int(open_[0]), int(n.size - 1 - open_[-1])) if open_.size else (n.size, n.size)


def border(runs: Runs, width: int, height: int, solid: float, margin: int, least: float) -> tuple[int, int, int, int]:
    """bx0, by0, bx1, by1."""
    y0, y1 = _bare(row_ink(runs, 0, width, 0, height), solid * width)
    x0, x1 = _bare(column_ink(runs, 0, width, 0, height), solid * height)
    box = x0 + margin, y0 + margin, width - 1 - x1 - margin, height - 1 - y1 - margin
    return box if box[2] - box[0] >= width * least and box[3] - box[1] >= height * least else (0, 0, width, height)


def column_rules(n: np.ndarray, start: int, height: int, share: float, of_best: float, percent: float, second: float, of_first: float, enough: int, gap: int) -> list[int]:
    """Centres of the vertical rules, from the ink of a box's columns."""
    if not n.size or height <= 0:
        return []
    limit = half_up(max(share, of_best * percentile(n, percent) / height), 9)

    def centres(over: float) -> list[int]:
        least = int(over * height)  # the first count whose rounded share is over the limit: about here
        while least > 0 and half_up((least - 1) / height, 9) > over:
            least -= 1
        while half_up(least / height, 9) <= over:
            least += 1
        return [int(s.sum() // s.size) for s in stretches(np.flatnonzero(n >= least) + start, gap)]

    plain = centres(limit)
    return plain if len(plain) >= enough else centres(max(second, half_up(limit * of_first, 9)))


def rule_extent(runs: Runs, rule: int, half: int, gap: int) -> tuple[int, int] | None:
    """top, bottom: the run of inked rows, across gaps, that has most rows; the first of equals."""
    y, a, b = runs
    rows = np.unique(y[(a < rule + half + 1) & (b > max(rule - half, 0))])
    best = max(stretches(rows, gap), key=len, default=None)  # the first of equals
    return None if best is None else (int(best[0]), int(best[-1]))


def text_lines(n: np.ndarray, start: int, percent: float, smooth: int, gap: int, least: int) -> list[int]:
    """Centres of the lines of writing, from the ink of a box's rows."""
    if not n.size:
        return []
    side = smooth // 2
    total = np.concatenate(([0], np.cumsum(n)))
    at = np.arange(n.size)
    s = total[np.minimum(at + side + 1, n.size)] - total[np.maximum(at - side, 0)]
    found = stretches(np.flatnonzero(s > half_up(percentile(s, percent), 6)) + start, gap)
    return [int(x.sum() // x.size) for x in found if x.size >= least]


def comb_start(lines: np.ndarray, pitches: np.ndarray, near: float, least: int) -> tuple[float, float] | None:
    """pitch, start of the best of all combs of these pitches that stand on one of the lines (sorted); None if none holds enough of them.

    A comb counts the lines near its teeth and three times their share of the teeth between the outermost. Of equals the smallest pitch, then the
    highest start.
    """
    best = None
    for k in range(0, pitches.size, max(1, (1 << 20) // max(1, lines.size**2))):  # a page with very many lines isn't tried at once
        p = pitches[k : k + max(1, (1 << 20) // max(1, lines.size**2)), None, None]
        tooth = np.rint((lines[None, None, :] - lines[None, :, None]) / p)
        on = np.abs(lines[None, None, :] - (lines[None, :, None] + tooth * p)) < p * near
        n = on.sum(axis=2)
        span = np.where(on, tooth, -np.inf).max(axis=2) - np.where(on, tooth, np.inf).min(axis=2) + 1
        score = np.where(n >= least, n + 3 * (n / span), -1.0)
        i = int(score.argmax())  # the smallest pitch, then the first line, of equals
        if score.flat[i] >= 0 and (best is None or score.flat[i] > best[0]):
            best = float(score.flat[i]), float(p[i // lines.size, 0, 0]), float(lines[i % lines.size])
    return best and best[1:]
