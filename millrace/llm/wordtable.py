"""A table of the distinct pieces of a corpus and their token ids, for byte-level BPE tokenizers.

Every piece that the tokenizer encodes on its own is found in Spark, sent once per task to the
range of its hash, encoded once with the tokenizers library, and stored as sorted hash arrays in
the shared folder. Workers map these arrays and join ids back by position, so texts never move.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernels as K
from millrace.llm import store


class ByteLevel:
    """The parts of a byte-level BPE tokenizer that the table needs."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        d = json.loads(self.tokenizer.to_str())
        pre, model = d["pre_tokenizer"] or {}, d["model"]
        plain = [t for t in d["added_tokens"] if not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"])]
        if d["normalizer"] or model.get("dropout") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or len(plain) < len(d["added_tokens"]):
            raise ValueError("only byte-level BPE tokenizers without normalizer, dropout, prefix space and stripping tokens are supported")
        self.specials = [(t["content"], t["id"]) for t in plain]
        self.special_points = [np.frombuffer(c.encode("utf-32-le"), np.uint32) for c, _ in self.specials]
        self.special_ids = [np.array([i], np.uint32) for _, i in self.specials]
        self.classes = K.char_classes(self.tokenizer.pre_tokenizer.pre_tokenize_str)
        # the byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        points = np.zeros(256, np.uint32)
        points[shown] = shown
        points[sorted(set(range(256)) - set(shown))] = 256 + np.arange(256 - len(shown))
        self.alphabet = points
        self.vocab = self.tokenizer.get_vocab(with_added_tokens=True)

    def encode_pieces(self, words: list[str]) -> list[list[int]]:
        tokenize = self.tokenizer.model.tokenize
        data, offsets = K.text_buffers(pa.array(words, pa.large_string()))
        shown = self.alphabet[data].tobytes().decode("utf-32-le")
        return [[t.id for t in tokenize(shown[a:b])] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]

    @lru_cache(1)  # noqa: B019  one tokenizer per worker
    def bytes_by_id(self) -> list[bytes]:
        """The bytes that each id stands for."""
        back = {chr(c): b for b, c in enumerate(self.alphabet.tolist())}
        out = [b""] * (max(self.vocab.values()) + 1)
        special = dict(self.specials)
        for word, i in self.vocab.items():
            out[i] = word.encode() if special.get(word) == i else bytes(back[c] for c in word)
        return out


@lru_cache(4)
def byte_level(path: str) -> ByteLevel:
    return ByteLevel(path)


@dataclass(frozen=True)
class Pieces:
    """The pieces of a slice of rows: their bytes, the special token (-1: none) of each, and the first piece of each row."""

    row: int
    end: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    special: np.ndarray
    first: np.ndarray

    def hashes(self, salt: int = 0) -> np.ndarray:
        return K.span_hashes(self.data, self.starts, self.ends, salt)

    def texts(self, which: np.ndarray) -> pa.Array:
        n = self.ends[which] - self.starts[which]
        offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        return pa.StringArray.from_buffers(len(which), pa.py_buffer(offsets), pa.py_buffer(self.data[K.ranges(self.starts[which], n)]))


def split(column: pa.Array, bpe: ByteLevel) -> Iterator[Pieces]:
    data, offsets = K.text_buffers(column)
    for a, b in K.slices(offsets):
        own = data[offsets[a] : offsets[b]]
        cp, at, lead = K.code_points(own, offsets[a : b + 1] - offsets[a])
        starts, ends, special = K.bpe_pieces(cp, at, bpe.special_points, bpe.classes)
        yield Pieces(a, b, own, lead[starts], lead[ends], special, np.searchsorted(starts, at))


def shard_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Ranges of the hash: shard numbers ascend with it."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


_SEEN_BITS = 20
CHECK = 1  # the salt of the second hash, by which pieces with equal first hashes are told apart


def merge(h: np.ndarray, c: np.ndarray, words: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The distinct first hashes, ascending, a word of each, and whether different words share it. c: the second hashes."""
    order = np.lexsort((c, h))
    h, c = h[order], c[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    shared = np.append(False, (h[1:] == h[:-1]) & (c[1:] != c[:-1]))[: len(h)]
    return h[first], words.take(pa.array(order[first])), np.add.reduceat(shared, first) > 0 if len(h) else shared


def build(docs: DataFrame, text: str, path: str, scratch: store.Scratch, name: str = "words") -> list[tuple[int, str, str, str]]:
    """Makes the table; returns (shard, addresses of hashes, id offsets and ids) for each shard that has words.

    A hash that different words share is stored without ids: workers encode such words by themselves.
    """
    n = store.shards(docs, text)
    folder = scratch.folder(name)

    def distinct(batches):
        bpe = byte_level(path)
        seen, checked = np.zeros(1 << _SEEN_BITS, np.uint64), np.zeros(1 << _SEEN_BITS, np.uint32)
        for batch in batches:
            found = []
            for pieces in split(batch.column(0), bpe):
                h, c = pieces.hashes(), (pieces.hashes(CHECK) >> np.uint64(32)).astype(np.uint32)
                slot = (h & np.uint64((1 << _SEEN_BITS) - 1)).astype(np.int64)
                new = np.flatnonzero(((seen[slot] != h) | (checked[slot] != c)) & (pieces.special < 0))
                if not len(new):
                    continue
                new = new[np.lexsort((c[new], h[new]))]
                keep = np.ones(len(new), bool)
                keep[1:] = (h[new[1:]] != h[new[:-1]]) | (c[new[1:]] != c[new[:-1]])
                new = new[keep]
                seen[slot[new]], checked[slot[new]] = h[new], c[new]
                found.append((h[new], c[new], pieces.texts(new)))
            if not found:
                continue
            h, c, w = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), pa.concat_arrays([f[2] for f in found])
            shard = shard_of(h, n)
            order = np.argsort(shard, kind="stable")
            h, c, w, shard = h[order], c[order], w.take(pa.array(order)), shard[order]
            first = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
            cut = np.append(first, len(h))
            both = [pa.array([x[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary()) for x in (h, c)]
            yield pa.RecordBatch.from_arrays([pa.array(shard[first]), *both, pa.ListArray.from_arrays(pa.array(cut, pa.int32()), w)], names=["shard", "hashes", "checks", "words"])

    def encode(table: pa.Table) -> pa.Table:
        bpe = byte_level(path)
        h, c = (np.frombuffer(b"".join(table.column(x).to_pylist()), t) for x, t in (("hashes", np.uint64), ("checks", np.uint32)))
        h, words, shared = merge(h, c, pa.concat_arrays([x.flatten() for x in table.column("words").chunks]))
        ids = bpe.encode_pieces(words.to_pylist())
        ids = [[] if s else x for x, s in zip(ids, shared.tolist(), strict=True)] if shared.any() else ids
        offsets = np.zeros(len(ids) + 1, np.int64)
        np.cumsum([len(x) for x in ids], out=offsets[1:])
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(offsets[-1]))
        shard = table.column("shard")[0].as_py()
        kind = np.uint16 if len(bpe.vocab) <= 1 << 16 else np.uint32
        files = [store.save(folder, f"{shard}-{what}", x) for what, x in (("hash", h), ("at", offsets.astype(np.uint32)), ("ids", flat.astype(kind)))]
        return pa.table({"shard": pa.array([shard], pa.int32()), **{k: [v] for k, v in zip(("hash", "at", "ids"), files, strict=True)}})

    found = docs.select(F.col(text).alias("t")).mapInArrow(distinct, "shard int, hashes binary, checks binary, words array<string>")
    made = scratch.table(found.groupBy("shard").applyInArrow(encode, "shard int, hash string, at string, ids string"), f"{name}-files")
    return sorted(tuple(r) for r in made.collect())  # one row for each shard: a file list


class Lookup:
    """Token ids of pieces by hash, with a cache of the pieces that were met last."""

    BITS, MOST = 19, 1 << 24

    def __init__(self, files: list[tuple[int, str, str, str]]):
        self.files = files
        self.first = [store.mapped(f[1])[0] for f in files]
        self._clear()

    def _clear(self) -> None:
        self.key, self.at, self.n = np.zeros(1 << self.BITS, np.uint64), np.zeros(1 << self.BITS, np.int64), np.zeros(1 << self.BITS, np.int64)
        self.pool, self.used = np.zeros(1 << 20, np.uint32), 0

    def _add(self, ids: np.ndarray) -> int:
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def _find(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, n = np.zeros(len(u), np.int64), np.zeros(len(u), np.int64)
        cut = np.append(np.searchsorted(u, np.array(self.first, np.uint64)), len(u))
        if len(u) and cut[0]:
            raise KeyError("a piece is not in the table")
        for (_, hashes, offsets, ids), a, b in zip(self.files, cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if a == b:
                continue
            h, o = store.mapped(hashes), store.mapped(offsets)
            p = np.searchsorted(h, u[a:b])
            if p[-1] >= len(h) or not np.array_equal(h[p], u[a:b]):
                raise KeyError("a piece is not in the table")
            lo, size = o[p].astype(np.int64), o[p + 1].astype(np.int64) - o[p]
            n[a:b] = size
            at[a:b] = self._add(store.mapped(ids)[K.ranges(lo, size)]) + np.cumsum(size) - size
        return at, n

    def ids(self, hashes: np.ndarray, special: np.ndarray, special_ids: list[np.ndarray], encode) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each piece has. encode: the ids of the k-th piece, for a hash of several words."""
        if self.used > self.MOST:
            self._clear()
        slot = (hashes & np.uint64((1 << self.BITS) - 1)).astype(np.int64)
        at, n = self.at[slot], self.n[slot]
        plain = special < 0
        miss = np.flatnonzero((self.key[slot] != hashes) & plain)
        if len(miss):
            u = np.sort(hashes[miss])
            u = u[np.append(True, u[1:] != u[:-1])]
            ua, un = self._find(u)
            p = np.searchsorted(u, hashes[miss])
            at[miss], n[miss] = ua[p], un[p]
            s = slot[miss]
            self.key[s], self.at[s], self.n[s] = hashes[miss], ua[p], un[p]
        for k in np.flatnonzero(~plain).tolist():
            ids = special_ids[special[k]]
            at[k], n[k] = self._add(ids), len(ids)
        for k in np.flatnonzero(n == 0).tolist():
            ids = encode(k)
            at[k], n[k] = self._add(ids), len(ids)
        return self.pool[K.ranges(at, n)], n


@lru_cache(2)
def lookup(files: tuple) -> Lookup:
    return Lookup(list(files))


def encoded(column: pa.Array, path: str, files: tuple, end: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices of rows: first row, end row, the ids of all, and offsets by row; with the end id, if any, after each row."""
    bpe, table = byte_level(path), lookup(files)
    for p in split(column, bpe):
        ids, n = table.ids(p.hashes(), p.special, bpe.special_ids, lambda k, p=p: np.array(bpe.encode_pieces(p.texts(np.array([k])).to_pylist())[0], np.uint32))
        offsets = np.concatenate([[0], np.cumsum(n)])[p.first]
        if end is not None:
            ids = np.insert(ids, offsets[1:], end)
            offsets = offsets + np.arange(len(offsets))
        yield p.row, p.end, ids, offsets
