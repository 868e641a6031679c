"""Vectors within a distance of each other, met through tiles of space, in the workers.

A row goes to its own tile and, as the left side of pairs, to those within eps of it, so each pair meets
in the own tile of its right row only. Tiles lie on the components of vectors of up to three, on three
projections of longer ones; projections on unit vectors do not lengthen distances. Distances are
those of columns.euclidean(), term by term in double precision. Rows with a component that is null or not finite
are in reach of none, nor are rows of unequal lengths.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import search

AXES, LEFT, RIGHT, LEAF, BATCH = 3, 256, 1024, 48, 1 << 15
FARTHEST = 2.0**45  # of a tile from the origin; what is farther shares a tile, as its rounding nears the size of one


def axes(x: np.ndarray) -> np.ndarray:
    if x.shape[1] <= AXES:
        return x
    return x @ np.linalg.qr(np.random.default_rng(0).standard_normal((x.shape[1], AXES)))[0]


def _tile(length: int, at: np.ndarray) -> np.ndarray:
    """A hash of the places of tiles. Tiles of equal hash are one, which only makes more rows meet."""
    h = np.full(len(at), length + 1, np.uint64)
    for j in range(at.shape[1]):
        h = (h ^ at[:, j].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def places(x: np.ndarray, eps: float, size: float, left: np.ndarray, below: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row, tile and side of each place: 1 as right row, 2 as left row, 3 as both.

    below: rows go to the tiles between them and what is eps less on every axis; rows in reach of each other then meet in one, whatever their sides.
    """
    with np.errstate(all="ignore"):
        p = np.nan_to_num(axes(x), nan=0.0)
        room = abs(eps) * (1 + 1e-9) + 1e-15 * (x.shape[1] + 4) * np.abs(x).max(1, initial=0)[:, None]
        low, home, high = (np.floor(np.clip(y / size, -FARTHEST, FARTHEST)) for y in (p - room, p, p if below else p + room))
    low, high = np.where(left[:, None], low, home), np.where(left[:, None], high, home)
    own = _tile(x.shape[1], home)
    row, tile = [np.arange(len(x))], [own]
    for step in itertools.product(range(int((high - low).max(initial=0)) + 1), repeat=p.shape[1]):
        there = low + np.array(step, float)
        at = np.flatnonzero((there <= high).all(1) & left)
        row.append(at)
        tile.append(_tile(x.shape[1], there[at]))
    row, tile = np.concatenate(row), np.concatenate(tile)
    order = np.lexsort((tile, row))
    row, tile = row[order], tile[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (tile[1:] != tile[:-1])]) if len(row) else np.zeros(0, bool)
    row, tile = row[new], tile[new]
    return row, tile, (tile == own[row]) + 2 * left[row]


def tiled(df: DataFrame, eps: float, size: float, kernel: Callable, result: str, below: bool = False) -> DataFrame:
    """What kernel gives for each tile. df: key, n (long), left (boolean), v; kernel: keys (Arrow), n, side and vectors of one tile, to record batches of result."""
    key, spark = df.schema["key"].dataType.simpleString(), df.sparkSession

    def spread(batches):
        for whole in batches:
            for s in range(0, whole.num_rows, 2048):
                batch = whole.slice(s, 2048)
                left = batch["left"].to_numpy(zero_copy_only=False).astype(bool)
                for n, at, x in search.matrix(batch["v"]):
                    fine = np.isfinite(x).all(1)
                    at, x = at[fine], x[fine]
                    row, tile, side = places(x, eps, size, left[at], below)
                    v = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1) * n, pa.int32()), pa.array(x[row].ravel(), pa.float64()))
                    yield pa.RecordBatch.from_arrays([pa.array(tile, pa.int64()), batch["key"].take(pa.array(at[row])), batch["n"].take(pa.array(at[row])), pa.array(side, pa.int32()), v], names=["tile", "key", "n", "side", "v"])

    def work(batches):
        return _filled(out for whole in _tiles(batches) for n, at, x in search.matrix(whole["v"]) for out in kernel(whole["key"].take(pa.array(at)), whole["n"].to_numpy()[at], whole["side"].to_numpy()[at], x))

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    sent = df.select("key", "n", "left", "v").mapInArrow(spread, f"tile long, key {key}, n long, side int, v array<double>")
    return sent.repartition(parts, "tile").sortWithinPartitions("tile").mapInArrow(work, result)


def _tiles(batches) -> Iterator[pa.RecordBatch]:
    """The batches, sorted by tile, as one of each tile."""
    held, last = [], None
    for batch in batches:
        tile = batch["tile"].to_numpy()
        cuts = [0, *(np.flatnonzero(tile[1:] != tile[:-1]) + 1).tolist(), len(tile)]
        for s, e in zip(cuts, cuts[1:]):
            if e > s:
                if held and tile[s] != last:
                    yield _one(held)
                    held = []
                held.append(batch.slice(s, e - s))
                last = tile[s]
    if held:
        yield _one(held)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(j) for b in batches]) for j in range(batches[0].num_columns)], names=batches[0].schema.names)


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches together."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BATCH:
            yield _one(held)
            held, rows = [], 0
    if rows:
        yield _one(held)


def pairs(x: np.ndarray, y: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of x and of y in reach, and their distances."""
    most = eps * eps * (1 + 1e-12)
    with np.errstate(all="ignore"):
        if x.shape[1] <= 8:
            total = np.zeros((len(x), len(y)))
            for j in range(x.shape[1]):
                d = x[:, j, None] - y[None, :, j]
                d *= d
                total += d
            q, r = np.nonzero(total <= most)
        else:
            q, r = np.nonzero(~(search.products(x, y) > (most + search.slack(x, y))[:, None]))
    far = search.exact(x[q], y[r])
    near = far <= eps
    return (q, r, far) if near.all() else (q[near], r[near], far[near])


def all_pairs(eps: float) -> Callable:
    """A kernel: the keys and distances of all pairs of a left and a right row."""

    def kernel(keys, n, side, x):
        left, right = np.flatnonzero(side >= 2), np.flatnonzero(side & 1)
        right = right[np.argsort(x[right, 0], kind="stable")] if x.shape[1] else right
        left = left[np.argsort(x[left, 0], kind="stable")] if x.shape[1] else left
        for s in range(0, len(left), LEFT):
            a = left[s : s + LEFT]
            low, high = _window(x[a], x[right], eps)
            for t in range(low, high, RIGHT):
                b = right[t : min(t + RIGHT, high)]
                q, r, far = pairs(x[a], x[b], eps)
                if len(q):
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(a[q])), keys.take(pa.array(b[r])), pa.array(far)], names=["a", "b", "distance"])

    return kernel


def _window(a: np.ndarray, b: np.ndarray, eps: float) -> tuple[int, int]:
    """Where rows in reach of a can lie among those of b, both sorted by their first component."""
    if not a.shape[1]:
        return 0, len(b)
    room = abs(eps) * (1 + 1e-9) + 4e-16 * max(abs(a[0, 0]), abs(a[-1, 0]))
    return int(np.searchsorted(b[:, 0], a[0, 0] - room)), int(np.searchsorted(b[:, 0], a[-1, 0] + room, "right"))


def few(eps: float, least: int) -> Callable:
    """A kernel: for each left row the number of right rows in reach, by n, and their keys; both stop where there are least or more."""

    def kernel(keys, n, side, x):
        left, right = np.flatnonzero(side >= 2), np.flatnonzero(side & 1)
        total, at, near = np.zeros(len(x), np.int64), [], []
        for t in range(0, len(right), RIGHT):
            b = right[t : t + RIGHT]
            left = left[total[left] < least]
            for s in range(0, len(left), LEFT):
                a = left[s : s + LEFT]
                q, r, _ = pairs(x[a], x[b], eps)
                np.add.at(total, a[q], n[b[r]])
                keep = total[a[q]] < least
                at.append(a[q[keep]])
                near.append(b[r[keep]])
        left = np.flatnonzero((side >= 2) & (total > 0))
        if len(left):
            at, near = np.concatenate(at), np.concatenate(near)
            keep = total[at] < least
            at, near = at[keep], near[keep]
            order = np.argsort(at, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(x))[left])])
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(left)), pa.array(total[left]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), keys.take(pa.array(near[order])))], names=["key", "total", "near"])

    return kernel


class _Box:
    """Some of the points, in their least box; parts are made when asked for."""

    __slots__ = ("at", "low", "high", "nodes", "one", "halves")

    def __init__(self, x: np.ndarray, node: np.ndarray, at: np.ndarray):
        self.at, self.low, self.high, self.halves = at, x[at].min(0), x[at].max(0), None
        self.nodes = np.unique(node[at]).tolist()
        self.one = len(self.nodes) == 1  # all nodes known to be linked


class Forest:
    """Which nodes are linked, through points in reach of each other: a walk through pairs of boxes.

    Boxes too far from each other, or all linked already, are passed over; boxes all in reach are linked as a whole.
    """

    def __init__(self, node: np.ndarray, x: np.ndarray, eps: float):
        self.x, self.node, self.eps = x, node, eps
        self.parent, self.edges = list(range(int(node.max()) + 1)), []
        whole = self._box(np.arange(len(x)))
        self._link(whole, whole)

    def _box(self, at: np.ndarray) -> _Box:
        return _Box(self.x, self.node, at)

    def _find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def _unite(self, i: int, j: int) -> None:
        a, b = self._find(i), self._find(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.edges.append((i, j))

    def _single(self, box: _Box) -> bool:
        if not box.one:
            if box.halves:
                a, b = box.halves
                box.one = a.one and b.one and self._find(a.nodes[0]) == self._find(b.nodes[0])
            else:
                box.one = len({self._find(i) for i in box.nodes}) == 1
        return box.one

    def _split(self, box: _Box) -> tuple[_Box, _Box]:
        if not box.halves:
            j = int(np.argmax(box.high - box.low))
            order = np.argpartition(self.x[box.at, j], len(box.at) // 2)
            box.halves = self._box(box.at[order[: len(box.at) // 2]]), self._box(box.at[order[len(box.at) // 2 :]])
        return box.halves

    def _link(self, a: _Box, b: _Box) -> None:
        if self._single(a) and self._single(b) and self._find(a.nodes[0]) == self._find(b.nodes[0]):
            return
        gap = np.maximum(np.maximum(a.low - b.high, b.low - a.high), 0)
        if gap @ gap > self.eps * self.eps * (1 + 1e-9):
            return
        span = np.maximum(a.high - b.low, b.high - a.low)
        if self.eps > 0 and span @ span <= self.eps * self.eps * (1 - 1e-9):
            for i in a.nodes + b.nodes:
                self._unite(a.nodes[0], i)
            a.one = b.one = True
        elif len(a.at) * len(b.at) <= LEAF * LEAF:
            q, r, _ = pairs(self.x[a.at], self.x[b.at], self.eps)
            u, v = self.node[a.at[q]], self.node[b.at[r]]
            for code in np.unique(u[u != v] * len(self.parent) + v[u != v]).tolist():
                self._unite(*divmod(code, len(self.parent)))
        elif a is b:
            left, right = self._split(a)
            self._link(left, left)
            self._link(right, right)
            self._link(left, right)
        else:
            if len(a.at) < len(b.at):
                a, b = b, a
            centre = b.low + b.high
            for half in sorted(self._split(a), key=lambda h: float(np.abs(h.low + h.high - centre).sum())):
                self._link(half, b)


def links(eps: float) -> Callable:
    """A kernel: edges between keys that lead from each to all that its points are linked with in the tile. Points of a key are linked as such."""

    def kernel(keys, n, side, x):
        coded = keys.dictionary_encode()
        edges = Forest(coded.indices.to_numpy().astype(np.int64), x, eps).edges if len(coded.dictionary) > 1 else []
        if edges:
            a, b = zip(*edges)
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(a)), coded.dictionary.take(pa.array(b))], names=["a", "b"])

    return kernel
