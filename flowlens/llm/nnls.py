"""Repeat counts of shallow length combinations by non-negative least squares.

A combination is up to three lengths that fill a window exactly. With the combinations as columns of A and the histogram
of lengths h, x minimises |A x - h|^2 over x >= 0. There are millions of columns, so they are priced, not listed: for every
window and longest length the column along which the error falls fastest joins the active set, and the counts of the
active columns are set in turn to their best values. What is left to do is bounded by the window, not by the documents.
"""

from __future__ import annotations

import numpy as np

Column = tuple[int, int, int]  # lengths in falling order, 0 where there are fewer


def price(left: np.ndarray, there: np.ndarray, window: int) -> list[Column]:
    """For each longest length the pair and the triple that fill ``window`` and have the most left; only lengths ``there``."""
    found: list[Column] = []
    if window < len(left) and there[window] and left[window] > 0:
        found.append((window, 0, 0))
    worth = np.where(there, left, -np.inf)
    for first in range(window - 1, (window - 1) // 3, -1):
        if not there[first]:
            continue
        rest = window - first
        if rest <= first and there[rest] and left[first] + left[rest] > 0:
            found.append((first, rest, 0))
        low, high = max(1, rest - first), rest // 2  # the third, so that neither it nor the second is longer than the first
        if low <= high:
            sums = worth[low : high + 1] + worth[rest - high : rest - low + 1][::-1]
            best = int(np.argmax(sums))
            if sums[best] + left[first] > 0:
                found.append((first, rest - low - best, low + best))
    return found


def solve(histogram: np.ndarray, windows: list[int], rounds: int = 6, sweeps: int = 4) -> dict[Column, float]:
    """Counts of the columns in use, for ``histogram[length]``; larger windows are priced first."""
    there = histogram > 0
    there[0] = False
    left = histogram.astype(float).tolist()
    left[0] = 0.0
    counts: dict[Column, float] = {}
    scale = max(1.0, float(histogram.max(initial=0)))
    for _ in range(rounds):
        for window in windows:
            for column in price(np.array(left), there, window):
                if column not in counts:
                    counts[column] = 0.0
                    _step(column, counts, left)
        for _ in range(sweeps):
            moved = sum(abs(_step(column, counts, left)) for column in counts)
            if moved < 1e-6 * scale:
                break
        counts = {column: x for column, x in counts.items() if x > 0}
    return counts


def _step(column: Column, counts: dict[Column, float], left: list[float]) -> float:
    """Set one count to its best value, the others held; ``left`` is what the counts leave of the histogram."""
    a, b, c = column
    norm = (1 if not b else 4 if a == b else 2) if not c else 9 if a == c else 5 if a == b or b == c else 3
    change = max((left[a] + (left[b] if b else 0.0) + (left[c] if c else 0.0)) / norm, -counts[column])
    if change:
        counts[column] += change
        left[a] -= change
        if b:
            left[b] -= change
        if c:
            left[c] -= change
    return change
