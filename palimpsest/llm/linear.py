"""Logistic regression on sparse rows, small enough for one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Entries that are worked on at once.
STEP = 1 << 21


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * np.asarray(x, float)))


class Sparse:
    """Rows of entries, one after another: ``length`` of each, the entries' ``column``, and their ``value`` (None: 1) times the column's ``scale`` (None: 1)."""

    def __init__(self, length: np.ndarray, column: np.ndarray, width: int, value: np.ndarray | None = None, scale: np.ndarray | None = None):
        self.column, self.value, self.width = column, value, width
        self.scale = np.ones(width) if scale is None else np.asarray(scale, float)
        self.ends = np.cumsum(length)
        self.length = np.asarray(length)

    def parts(self) -> Iterator[tuple[int, int, int, int]]:
        """(first row, last row, first entry, last entry) of stretches of about ``STEP`` entries; a row is never cut."""
        row = 0
        while row < len(self.length):
            start = int(self.ends[row] - self.length[row])
            last = max(row + 1, int(np.searchsorted(self.ends, start + STEP, "right")))
            yield row, last, start, int(self.ends[last - 1])
            row = last

    def forward(self, w: np.ndarray) -> np.ndarray:
        """The rows' products with ``w``."""
        scaled, out = self.scale * w, np.zeros(len(self.length))
        for a, b, s, e in self.parts():
            x = scaled[self.column[s:e]]
            if self.value is not None:
                x *= self.value[s:e]
            some = np.flatnonzero(self.length[a:b])
            if len(some):
                out[a + some] = np.add.reduceat(x, (self.ends[a:b] - self.length[a:b])[some] - s)
        return out

    def back(self, e: np.ndarray) -> np.ndarray:
        """The sum of the rows, each times its number in ``e``."""
        total = np.zeros(self.width)
        for a, b, s, t in self.parts():
            x = np.repeat(e[a:b], self.length[a:b])
            if self.value is not None:
                x *= self.value[s:t]
            total += np.bincount(self.column[s:t], x, self.width)
        return total * self.scale


def logistic(table: Sparse, target: np.ndarray, weight: np.ndarray, penalty: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Coefficients and intercept for the rows of ``table``, targets in 0..1 and row weights.

    Minimises the weighted mean log loss plus ``penalty`` / 2 times the squared
    coefficients, by accelerated gradient steps of a length from power iteration.
    """
    share, width = weight / weight.sum(), table.width
    x, bound = np.ones(width) / np.sqrt(max(width, 1)), 1.0
    for _ in range(12 if len(table.column) else 0):
        y = table.back(share * table.forward(x))
        bound = float(np.linalg.norm(y))
        if not bound:
            break
        x = y / bound
    step = 1.0 / (0.25 * 1.1 * (bound + 1.0) + penalty)
    mean = float(np.clip(share @ target, 1e-4, 1 - 1e-4))
    now = np.r_[np.zeros(width), np.log(mean / (1 - mean))]
    ahead, t = now.copy(), 1.0
    for _ in range(steps):
        error = share * (sigmoid(table.forward(ahead[:-1]) + ahead[-1]) - target)
        slope = np.r_[table.back(error) + penalty * ahead[:-1], error.sum()]
        new = ahead - step * slope
        if slope @ (new - now) > 0:
            t = 1.0
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, now, t = new + (t - 1) / t_new * (new - now), new, t_new
    return now[:-1], float(now[-1])
