"""Sparse logistic regression and bounded samples, shared by the operators that fit linear models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounded(rows: DataFrame, id: str, most: int) -> DataFrame:
    """At most `most` rows, those of the least hash of the id: a sample that does not depend on partitions."""
    return rows.orderBy(F.xxhash64(F.col(id)), F.col(id)).limit(most)


class Sparse:
    """Rows of binary features: distinct feature numbers and offsets by row."""

    def __init__(self, index: np.ndarray, offsets: np.ndarray):
        self.index, self.offsets = index, offsets
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))

    def take(self, keep: np.ndarray) -> Sparse:
        own = keep[self.row]
        return Sparse(self.index[own], np.concatenate([[0], np.cumsum(np.diff(self.offsets)[keep])]))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.index], len(self.offsets) - 1)


def fit(x: Sparse, dense: np.ndarray, y: np.ndarray, width: int, features: int = 4096, l2: float = 1e-3, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features (those with the strongest association, the others 0), and of dense columns and the bias."""
    y = y.astype(float)
    n, rate = max(len(y), 1), y.mean() if len(y) else 0.0
    w, v = np.zeros(width), np.zeros(dense.shape[1] + 1)
    if not 0 < rate < 1:
        v[-1] = 8.0 if rate == 1 else -8.0
        return w, v
    count = np.bincount(x.index, minlength=width)
    hits = np.bincount(x.index, y[x.row], width)
    z = np.abs(hits - count * rate) / np.sqrt(np.maximum(count, 1) * rate * (1 - rate))
    z[count < 2] = 0
    chosen = np.sort(np.argsort(-z, kind="stable")[:features])
    place = np.full(width, -1, np.int64)
    place[chosen] = np.arange(len(chosen))
    at = place[x.index]
    row, at = x.row[at >= 0], at[at >= 0]
    d = np.column_stack([dense, np.ones(len(y))])
    share = np.where(y > 0, 0.5 / rate, 0.5 / (1 - rate)) / n
    w1 = np.zeros(len(chosen))
    g1, g2 = np.full(len(chosen), 1e-8), np.full(len(v), 1e-8)
    for _ in range(rounds):  # AdaGrad on all rows
        p = sigmoid(np.bincount(row, w1[at], len(y)) + d @ v)
        r = share * (p - y)
        a, b = np.bincount(at, r[row], len(chosen)) + l2 * w1 / 10, d.T @ r
        g1 += a * a
        g2 += b * b
        w1 -= 0.3 * a / np.sqrt(g1)
        v -= 0.3 * b / np.sqrt(g2)
    w[chosen] = w1
    return w, v


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def fold_of(id: Column, modulus: int) -> Column:
    return F.crc32(id.cast("string").cast("binary")) % modulus
