"""Exact nearest rows by Euclidean distance, as matrix products of blocks in the workers.

One product gives the squared distances of a block of rows to a block of queries, up to rounding. What
is not farther than a query's k-th so far, with a bound of the rounding, is computed again term by term
in double precision, in the order of columns.euclidean(), so that results and ties are those of the
plain expression. A task sends k rows a query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS, QUERIES, PAIRS = 8192, 512, 1 << 20  # of a block of distances; of pairs computed again at once


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distances of the rows of a and b, summed in the order of the components."""
    total = np.zeros(len(a))
    with np.errstate(all="ignore"):
        for j in range(a.shape[1]):
            d = a[:, j] - b[:, j]
            total += d * d
    return np.sqrt(total)


def slack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A bound of the rounding of products(), for each row of a with any of b."""
    with np.errstate(all="ignore"):
        return 4 * (a.shape[1] + 8) * np.finfo(float).eps * ((a * a).sum(1) + (b * b).sum(1).max(initial=0))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of a and b, up to slack(); NaN where a component is not finite."""
    with np.errstate(all="ignore"):
        left = np.concatenate([a, (a * a).sum(1)[:, None], np.ones((len(a), 1))], 1)
        right = np.concatenate([-2 * b, np.ones((len(b), 1)), (b * b).sum(1)[:, None]], 1)
        return left @ right.T


def matrix(column: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """The vectors of a list column by length: length, places and rows. Null vectors and those with a null component are left out."""
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    flat = column.flatten()
    starts = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])
    values = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    holes = np.concatenate([[0], np.cumsum(np.asarray(flat.is_null()).astype(np.int64))])
    good = (sizes >= 0) & (holes[starts[1:]] == holes[starts[:-1]])
    out = []
    for n in np.unique(sizes[good]).tolist():
        at = np.flatnonzero(good & (sizes == n))
        out.append((n, at, values[starts[at][:, None] + np.arange(n)[None]]))
    return out


class Best:
    """The k nearest of the rows seen so far, for each of the queries of one length."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.far, self.id = np.full((len(ids), k), np.inf), np.full((len(ids), k), -1, ids.dtype)
        self.n = np.zeros(len(ids), int)

    def add(self, ids: np.ndarray, y: np.ndarray) -> None:
        for s in range(0, len(self.ids), QUERIES):
            x = self.x[s : s + QUERIES]
            d, room = products(x, y), slack(x, y)
            limit = np.where(self.n[s : s + QUERIES] >= self.k, self.far[s : s + QUERIES, -1] ** 2, np.inf)
            if len(ids) > self.k and (self.n[s : s + QUERIES] < self.k).any():  # k + 1, as one of them can be the query itself
                with np.errstate(all="ignore"):
                    limit = np.fmin(limit, np.nan_to_num(np.partition(np.where(self.ids[s : s + QUERIES, None] == ids[None], np.inf, d), self.k - 1, 1)[:, self.k - 1] + room, nan=np.inf))
            with np.errstate(all="ignore"):
                q, r = np.nonzero(~(d > (limit * (1 + 1e-12) + room)[:, None]))  # what is not finite is not left out
            keep = self.ids[s + q] != ids[r]
            q, r = q[keep] + s, r[keep]
            for at in range(0, len(q), PAIRS):
                self._merge(q[at : at + PAIRS], ids[r[at : at + PAIRS]], exact(self.x[q[at : at + PAIRS]], y[r[at : at + PAIRS]]))

    def _merge(self, q: np.ndarray, id: np.ndarray, far: np.ndarray) -> None:
        touched = np.unique(q)
        old = np.arange(self.k)[None] < self.n[touched][:, None]
        q = np.concatenate([q, np.repeat(touched, self.n[touched])])
        id, far = np.concatenate([id, self.id[touched][old]]), np.concatenate([far, self.far[touched][old]])
        order = np.lexsort((id, far, q))  # NaN is the farthest
        q, id, far = q[order], id[order], far[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        first = place < self.k
        self.far[q[first], place[first]], self.id[q[first], place[first]] = far[first], id[first]
        self.n[touched] = np.minimum(self.k, np.searchsorted(q, touched, "right") - np.searchsorted(q, touched))


def candidates(df: DataFrame, queries: DataFrame, k: int, id: str, vector: str) -> DataFrame:
    """query, id and distance: of each task the k nearest rows of df for each query but itself, of equal distance the least ids.

    A pair with a null component, or of unequal lengths, has a null distance; it counts only for a query with fewer than k others in the task.
    """
    kind = dict(df.dtypes)[id]
    d = df.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("v")).filter("id IS NOT NULL")
    q = queries.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("v")).filter("id IS NOT NULL").toArrow().combine_chunks()
    names = q["id"].to_numpy()
    found = matrix(q["v"].combine_chunks()) if len(names) else []
    sent = df.sparkSession.sparkContext.broadcast((names, found))

    def nearest(batches):
        names, found = sent.value
        best = {n: Best(names[at], x, k) for n, at, x in found}
        seen: list[tuple[np.ndarray, np.ndarray]] = []  # ids and lengths (-1: null) of rows that could have a null distance
        held: dict[int, list] = {}

        def flush(n: int) -> None:
            ids, rows = zip(*held.pop(n))
            best[n].add(np.concatenate(ids), np.concatenate(rows))

        for batch in batches:
            ids = batch.column(0).to_numpy()
            length = np.full(len(ids), -1)
            for n, at, rows in matrix(batch.column(1)):
                length[at] = n
                if n in best:
                    held.setdefault(n, []).append((ids[at], rows))
                    if sum(len(x) for x, _ in held[n]) >= ROWS:
                        flush(n)
            seen = [_least(seen + [(ids, length)], k)]
        for n in list(held):
            flush(n)
        ids, length = seen[0] if seen else (np.zeros(0, np.int64), np.zeros(0, int))
        here = np.full(len(names), -1)
        for n, b in best.items():
            for s in range(0, len(b.ids), ROWS):
                at = np.arange(k)[None] < b.n[s : s + ROWS][:, None]
                yield _batch(np.repeat(b.ids[s : s + ROWS], b.n[s : s + ROWS]), b.id[s : s + ROWS][at], b.far[s : s + ROWS][at])
        for n, at, _ in found:
            here[at] = n
        count = np.zeros(len(names), int)
        for n, at, _ in found:
            count[at] = best[n].n
        for j in np.flatnonzero(count < k).tolist():
            other = ids[(ids != names[j]) & ((length != here[j]) | (here[j] < 0))][: k - count[j]]
            if len(other):
                yield _batch(np.full(len(other), names[j]), other, None)

    return d.mapInArrow(nearest, "query long, id long, distance double").select(F.col("query").cast(kind).alias("query"), F.col("id").cast(kind).alias("id"), "distance")


def _batch(query: np.ndarray, id: np.ndarray, far: np.ndarray | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(id, pa.int64()), pa.nulls(len(id), pa.float64()) if far is None else pa.array(far, pa.float64())], names=["query", "id", "distance"])


def _least(parts: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each length the rows of the k + 1 least ids, of one id k at most, in ascending order."""
    ids, length = np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])
    order = np.lexsort((ids, length))
    ids, length = ids[order], length[order]
    new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (length[1:] != length[:-1])]) if len(ids) else np.zeros(0, bool)
    run = np.cumsum(new) - 1
    copy = np.arange(len(ids)) - np.flatnonzero(new)[run] if len(ids) else run
    start = run[np.searchsorted(length, length)] if len(ids) else run
    keep = (copy < k) & (run - start <= k)
    ids, length = ids[keep], length[keep]
    order = np.argsort(ids, kind="stable")
    return ids[order], length[order]
