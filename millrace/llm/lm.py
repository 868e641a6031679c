"""An interpolated modified Kneser-Ney model of word pairs, counted in Spark.

Every task counts the words and word pairs of its documents as sorted 64-bit hashes and sends each
shard its part; the shards add up the counts and write them as sorted hash arrays to the shared
folder, which workers map into memory to score texts. Pairs are dealt over a square grid, by the
hash of the first word and of the second, so that the pairs of a word, however frequent, go to as
many shards as the grid is wide; statistics of contexts and continuations follow as sums.

A token is a word or the end of a document; the context of a document's first token is a start
mark. With c the count of a pair, D1, D2, D3+ the discounts from the counts of counts, and sums
over the context v:

    p(w | v) = max(c(v w) - D(c), 0) / c(v) + (D1 n1(v) + D2 n2(v) + D3 n3(v)) / c(v) * p(w)

p(w) is the same with the number of distinct words before w in place of c, and ends in the uniform
distribution over the vocabulary and one unknown token, so probabilities add up to 1 and every
text has one. A context that was never seen leaves p(w).

Defined results: a null text is an empty one, which is its end token; a row with null in the
training flag is not trained on; repeated rows count as often as they come; an empty table gives
an empty result; without training tokens every token has the uniform probability of the unknown
token; other columns are not touched.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernels as K
from millrace.llm import store
from millrace.llm.wordtable import shard_of

START, END = np.uint64(0x51A7), np.uint64(0xE4D)
COUNTED, SCORED = 4 << 20, 1 << 20  # bytes of text (or one longer text) that are counted, or scored, at once


@dataclass(frozen=True)
class Model:
    """Addresses of the arrays, by shard of the hash, and the totals of all shards."""

    words: tuple[tuple[str, ...], ...]  # hash, count, continuation count
    pairs: tuple[tuple[int, tuple[str, ...]], ...]  # shard of the grid, hash, count
    contexts: tuple[tuple[str, ...], ...]  # hash, count, n1, n2, n3
    grid: int
    tokens: int
    vocabulary: int
    pair_counts: tuple[int, int, int, int, int]  # how many pairs have count 1, 2, 3, 4, and any
    word_counts: tuple[int, int, int, int, int]  # how many words have continuation count 1, 2, 3, 4, and 3 or more


def discounts(n: tuple[int, ...]) -> tuple[float, float, float]:
    """D1, D2 and D3+ from the counts of counts 1 to 4, at least 0.1 so that every context leaves mass; where these are degenerate, one half."""
    n1, n2, n3, n4 = (float(x) for x in n[:4])
    if min(n1, n2, n3, n4) <= 0:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    out = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.1), k) for k, d in enumerate(out, 1))  # type: ignore[return-value]


def tokens_of(column: pa.Array, most: int):
    """For slices of rows: first row, end row, hashes of all tokens with an end after each row, and offsets by row."""
    for a, b, words, row in K.hashed_words(column, most=most):
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b - a) if len(row) else np.zeros(b - a, np.int64))])
        yield a, b, np.insert(words, offsets[1:], END), offsets + np.arange(len(offsets))


def coded(tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes of tokens and the start mark, ascending; each token's place there, and its context's."""
    u, where = distinct(np.append(tokens, START))
    before = np.empty(len(tokens), np.int64)
    before[1:] = where[: len(tokens) - 1]
    before[offsets[:-1]] = where[-1]
    return u, where[:-1], before


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h)
    s = h[order]
    new = np.append(True, s[1:] != s[:-1])[: len(s)]
    where = np.empty(len(h), np.int64)
    where[order] = np.cumsum(new) - 1
    return s[new], where


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys, ascending, and the sums of their values."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], *[np.add.reduceat(v[order].astype(np.uint64), first) if len(first) else np.zeros(0, np.uint64) for v in values]


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys))).astype(np.uint32)


def _planes(x: np.ndarray) -> bytes:
    """Sorted integers as byte planes, of which shuffles compress the high ones away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _from_planes(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


_ARROW = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), *[(x, pa.binary()) for x in "abcde"]])
_SENT = "shard int, kind int, a binary, b binary, c binary, d binary, e binary"


def _send(kind: int, shard: np.ndarray, *values: np.ndarray):
    """One row for each shard of ascending shard numbers."""
    if not len(shard):
        return
    first = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
    cut = np.append(first, len(shard))
    spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
    columns = [pa.array([_planes(v[i:j]) for i, j in spans], pa.binary()) for v in values]
    columns += [pa.nulls(len(spans), pa.binary())] * (5 - len(columns))
    yield pa.RecordBatch.from_arrays([pa.array(shard[first].astype(np.int32)), pa.array([kind] * len(spans), pa.int32()), *columns], schema=_ARROW)


def pair_shard(first: np.ndarray, second: np.ndarray, grid: int) -> np.ndarray:
    return shard_of(first, grid) * grid + shard_of(second, grid)


def _received(table: pa.Table, kind: int, types: tuple) -> list[np.ndarray]:
    rows = table.filter(pc.equal(table.column("kind"), kind))
    return [np.concatenate([_from_planes(x, t) for x in rows.column(2 + k).to_pylist()] or [np.zeros(0, t)]) for k, t in enumerate(types)]


def fit(docs: DataFrame, train: Column, text: str = "text") -> Model:
    """Counts the rows where train is true. Everything that is counted covers all their text."""
    spark, scratch = docs.sparkSession, store.Scratch(docs.sparkSession, "lm")
    grid, folder = math.isqrt(store.shards(docs, text, 8 << 20) - 1) + 1, scratch.folder("model")
    n = grid * grid

    def count(batches):
        for batch in batches:
            for _, _, tokens, offsets in tokens_of(batch.column(0), COUNTED):
                u, token, before = coded(tokens, offsets)
                times = np.bincount(token, minlength=len(u)).astype(np.uint32)
                some = times > 0  # all but the start mark
                yield from _send(0, shard_of(u[some], n), u[some], times[some])
                key, times = _counted((before.astype(np.uint64) << np.uint64(32)) | token.astype(np.uint64))
                v, w = u[(key >> np.uint64(32)).astype(np.int64)], u[(key & np.uint64(0xFFFFFFFF)).astype(np.int64)]
                shard = pair_shard(v, w, grid)
                order = np.argsort(shard.astype(np.uint16) if n < 1 << 16 else shard, kind="stable")
                yield from _send(1, shard[order], v[order], w[order], times[order])

    def pairs(table: pa.Table) -> pa.Table:
        """Adds up words and pairs of a shard; stores pairs; sends on what contexts and continuations get from them."""
        shard = table.column("shard")[0].as_py()
        out = []
        word, number = _received(table, 0, (np.uint64, np.uint32))
        if len(word):
            word, number = summed(word, number.astype(np.uint64))
            out += list(_send(0, shard_of(word, n), word, number))
        v, w, number = _received(table, 1, (np.uint64, np.uint64, np.uint32))
        if len(v):
            pair = K.chain([v, w], 2)
            order = np.argsort(pair)
            pair = pair[order]
            first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
            c = np.add.reduceat(number[order].astype(np.uint64), first)
            pair, order = pair[first], order[first]
            files = [store.save(folder, f"pairs-{shard}", x) for x in (pair, c if c.max() >> np.uint64(32) else c.astype(np.uint32))]
            out.append(_row(shard, 9, files, np.array([*[(c == k).sum() for k in (1, 2, 3, 4)], len(c)], np.int64)))
            word, times = _counted(w[order])
            out += list(_send(1, shard_of(word, n), word, times))
            v, total, *stats = summed(v[order], c, c == 1, c == 2, c > 2)
            out += list(_send(2, shard_of(v, n), v, total, *[x.astype(np.uint32) for x in stats]))
        return pa.Table.from_batches(out, _ARROW) if out else _ARROW.empty_table()

    def rest(table: pa.Table) -> pa.Table:
        """Adds up words, continuations and contexts of a shard and stores them."""
        shard = table.column("shard")[0].as_py()
        out = []
        word, number = _received(table, 0, (np.uint64, np.uint64))
        follows, times = _received(table, 1, (np.uint64, np.uint32))
        if len(word):
            key, number, times = summed(np.concatenate([word, follows]), np.concatenate([number, np.zeros(len(follows), np.uint64)]), np.concatenate([np.zeros(len(word), np.uint64), times.astype(np.uint64)]))
            stats = np.array([int(number.sum()), len(key), *[(times == k).sum() for k in (1, 2, 3, 4)], (times > 2).sum()], np.int64)
            out.append(_row(shard, 8, [store.save(folder, f"words-{shard}", x) for x in (key, number, times)], stats))
        context = _received(table, 2, (np.uint64, np.uint64, np.uint32, np.uint32, np.uint32))
        if len(context[0]):
            out.append(_row(shard, 7, [store.save(folder, f"contexts-{shard}", x) for x in summed(*context)], np.zeros(1, np.int64)))
        return pa.Table.from_batches(out, _ARROW) if out else _ARROW.empty_table()

    counted = docs.filter(train).select(F.col(text).alias("t")).mapInArrow(count, _SENT)
    first = scratch.table(counted.groupBy("shard").applyInArrow(pairs, _SENT), "first")
    second = scratch.table(first.filter("kind < 7").groupBy("shard").applyInArrow(rest, _SENT), "second")
    parts: dict[int, list] = {7: [], 8: [], 9: []}
    for r in first.filter("kind >= 7").unionByName(second).collect():  # three rows for each shard: addresses and totals
        parts[r.kind].append((r.shard, tuple(bytes(r.a).decode().split("\n")), np.frombuffer(bytes(r.b), np.int64)))
    scratch.remove("first")
    words, of = sum((x[2] for x in parts[8]), np.zeros(7, np.int64)).tolist(), sum((x[2] for x in parts[9]), np.zeros(5, np.int64)).tolist()
    files = {k: sorted(v, key=lambda x: x[0]) for k, v in parts.items()}
    return Model(tuple(x[1] for x in files[8]), tuple(x[:2] for x in files[9]), tuple(x[1] for x in files[7]), grid, words[0], words[1], tuple(of), tuple(words[2:]))




def _row(shard: int, kind: int, files: list[str], stats: np.ndarray) -> pa.RecordBatch:
    values = [pa.array([shard], pa.int32()), pa.array([kind], pa.int32()), pa.array(["\n".join(files).encode()], pa.binary()), pa.array([stats.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays([*values, *[pa.nulls(1, pa.binary())] * 3], schema=_ARROW)


@lru_cache(8)
def _firsts(files: tuple[tuple[str, ...], ...]) -> np.ndarray:
    return np.array([store.mapped(f[0])[0] for f in files], np.uint64)


def _find(files: tuple[tuple[str, ...], ...], u: np.ndarray, width: int) -> list[np.ndarray]:
    """The values of ascending hashes u, as doubles; 0 where a hash is absent."""
    out = [np.zeros(len(u)) for _ in range(width)]
    if not files:
        return out
    cut = np.append(np.searchsorted(u, _firsts(files)), len(u)).tolist()
    for own, a, b in zip(files, cut[:-1], cut[1:], strict=True):
        if a < b:
            keys = store.mapped(own[0])
            p = np.minimum(np.searchsorted(keys, u[a:b]), len(keys) - 1)
            hit = keys[p] == u[a:b]
            for k in range(width):
                out[k][a:b] = np.where(hit, store.mapped(own[k + 1])[p], 0)
    return out


def _find_pairs(model: Model, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The counts of pairs."""
    out = np.zeros(len(v))
    pair, shard = K.chain([v, w], 2), pair_shard(v, w, model.grid)
    order = np.argsort(pair)
    order = order[np.argsort(shard[order].astype(np.uint16) if model.grid < 256 else shard[order], kind="stable")]
    files = dict(model.pairs)
    first = np.flatnonzero(np.append(True, np.diff(shard[order]) != 0)) if len(order) else np.zeros(0, np.int64)
    for i, j in zip(first.tolist(), np.append(first, len(order))[1:].tolist(), strict=True):
        if own := files.get(int(shard[order[i]])):
            keys, counts = store.mapped(own[0]), store.mapped(own[1])
            u = pair[order[i:j]]
            p = np.minimum(np.searchsorted(keys, u), len(keys) - 1)
            out[order[i:j]] = np.where(keys[p] == u, counts[p], 0)
    return out


def score_tokens(model: Model, tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of each token's probability, and its count in the training text."""
    u, token, before = coded(tokens, offsets)
    count, follows = _find(model.words, u, 2)
    total, n1, n2, n3 = _find(model.contexts, u, 4)
    d, e, kinds = discounts(model.word_counts), discounts(model.pair_counts), model.word_counts
    uniform, pairs = 1.0 / (model.vocabulary + 1), model.pair_counts[4]
    if pairs:
        lower = np.maximum(follows - _discount(follows, d), 0) / pairs + (d[0] * kinds[0] + d[1] * kinds[1] + d[2] * kinds[4]) / pairs * uniform
    else:
        lower = np.full(len(u), uniform)
    key, where = distinct((before.astype(np.uint64) << np.uint64(32)) | token.astype(np.uint64))
    v, w = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    c, seen = _find_pairs(model, u[v], u[w]), total[v]
    keep = np.divide(np.maximum(c - _discount(c, e), 0), seen, out=np.zeros(len(c)), where=seen > 0)
    back = np.divide(e[0] * n1[v] + e[1] * n2[v] + e[2] * n3[v], seen, out=np.ones(len(c)), where=seen > 0)
    return np.log10(keep + back * lower[w])[where], count[token]


def _discount(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(c == 1, d[0], np.where(c == 2, d[1], np.where(c > 2, d[2], 0.0)))


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score (by counts of single tokens, 0.5 added), score and perplexity."""

    def apply(batches):
        scale = np.log10(model.tokens + 0.5 * (model.vocabulary + 1))
        for batch in batches:
            for a, b, tokens, offsets in tokens_of(batch.column(1), SCORED):
                p, count = score_tokens(model, tokens, offsets)
                n, at = np.diff(offsets), offsets[:-1]
                base, total = np.add.reduceat(np.log10(count + 0.5) - scale, at), np.add.reduceat(p, at)
                columns = [pa.array(n), pa.array(np.add.reduceat((count > 0).astype(np.int64), at)), pa.array(np.full(b - a, model.tokens)), pa.array(base), pa.array(total), pa.array(10 ** np.minimum(-total / n, 300))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("t"))
    return rows.mapInArrow(apply, f"doc_id {rows.schema[0].dataType.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
