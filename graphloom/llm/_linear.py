"""Small solvers on sparse rows, for models that are fitted on a bounded sample."""

from __future__ import annotations

import numpy as np


class Rows:
    """Sparse rows: ``row``, ``col`` and ``val`` of the entries."""

    def __init__(self, row, col, val, n: int, width: int):
        self.row, self.col, self.val, self.n, self.width = np.asarray(row), np.asarray(col), np.asarray(val, float), n, width

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.val * r[self.row], self.width)


def adam(gradient, start: np.ndarray, rounds: int = 200, rate: float = 0.1) -> np.ndarray:
    w, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, rounds + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (1 - 0.9 * t / rounds) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))
