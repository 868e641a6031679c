"""Language identification with string kernels.

The kernel of two texts is the number of distinct character n-grams (lengths 2 to 4, lower case) in
both, over the geometric mean of their numbers: a blended-spectrum presence kernel. n-grams are
hashed to 2**15 places. Nystroem landmarks span the space, one-versus-rest kernel ridge regression
is solved there, and texts are scored by products of presence matrices with the landmarks.

Defined results: a null text, or one without a letter, is "und" with score 0; repeated and null ids
are kept; texts are read whole; without training rows every text is "und" with score 0; an empty
table gives an empty result; other columns are not touched.

The model is fitted from at most `sample` training texts (a parameter).
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernels as K
from millrace.llm import linear

BITS, BATCH = 15, 128


@lru_cache(1)
def _lower() -> np.ndarray:
    table = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(sys.maxunicode + 1):
        if not 0xD800 <= c < 0xE000 and len(low := chr(c).lower()) == 1:
            table[c] = ord(low)
    return table


def presence(column: pa.Array):
    """For slices of rows: first row, end row, presence matrix (rows by 2**BITS), and which rows have letters."""
    data, offsets = K.text_buffers(column)
    letters, lower = K.char_classes(), _lower()
    for a, b in K.slices(offsets):
        cp, at, _ = K.code_points(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        row = np.repeat(np.arange(b - a), np.diff(at))
        has = np.bincount(row, letters[cp] == K.LETTER, b - a) > 0
        cp = lower[cp].astype(np.uint64)
        for s in range(0, b - a, BATCH):
            e = min(b - a, s + BATCH)
            c, r = cp[at[s] : at[e]], row[at[s] : at[e]] - s
            x = np.zeros((e - s, 1 << BITS), bool)
            for k in (2, 3, 4):
                n = len(c) - k + 1
                if n > 0:
                    ok = r[:n] == r[k - 1 :]
                    h = np.full(n, k, np.uint64)
                    for j in range(k):
                        h = h * np.uint64(0x9E3779B97F4A7C15) + c[j : j + n]
                    x[r[:n][ok], (K.mix64(h[ok]) >> np.uint64(64 - BITS)).astype(np.int64)] = True
            yield a + s, a + e, x, has[s:e]


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    landmarks: np.ndarray  # packed presence
    weights: np.ndarray  # (landmarks + 1) by languages

    def matrix(self) -> tuple[np.ndarray, np.ndarray]:
        dense = np.unpackbits(self.landmarks, axis=1).astype(np.float32)
        return dense.T.copy(), np.sqrt(np.maximum(dense.sum(1), 1))


def kernel(x: np.ndarray, dense: np.ndarray, norm: np.ndarray) -> np.ndarray:
    x = x.astype(np.float32)
    return (x @ dense) / norm / np.sqrt(np.maximum(x.sum(1), 1))[:, None]


def fit(docs: DataFrame, train: Column, lang: str = "lang", id: str = "doc_id", text: str = "text", sample: int = 3000, landmarks: int = 128, ridge: float = 1e-2) -> Model:
    rows = docs.select(F.col(id).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"), F.coalesce(train, F.lit(False)).alias("use"))
    some = linear.bounded(rows.filter("use AND l IS NOT NULL AND t IS NOT NULL").select("k").distinct(), "k", sample)

    def pack(batches):
        for batch in batches:
            for a, b, x, has in presence(batch.column(0)):
                bits = [p.tobytes() for p in np.packbits(x, axis=1)]
                yield pa.RecordBatch.from_arrays([pa.array(bits, pa.binary()), batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a)], names=["x", "l", "k"]).filter(pa.array(has))

    chosen = rows.filter("use AND l IS NOT NULL").join(F.broadcast(some), "k").select("t", "l", "k")  # some: at most `sample` rows
    found = linear.bounded(chosen.mapInArrow(pack, f"x binary, l string, k {rows.schema[0].dataType.simpleString()}"), "k", sample).toArrow()
    if not found.num_rows:
        return Model((), np.zeros((0, 1 << BITS - 3), np.uint8), np.zeros((1, 0)))
    l = np.array(found.column("l").to_pylist())
    packed = np.stack([np.frombuffer(x, np.uint8) for x in found.column("x").to_pylist()])
    langs = sorted(set(l.tolist()))
    each = max(1, landmarks // len(langs))
    marks = packed[np.concatenate([np.flatnonzero(l == one)[:each] for one in langs])]
    model = Model(tuple(langs), marks, np.zeros((len(marks) + 1, len(langs))))
    dense, norm = model.matrix()
    k = np.vstack([kernel(np.unpackbits(packed[s : s + BATCH], axis=1), dense, norm) for s in range(0, len(packed), BATCH)]).astype(float)
    mm = kernel(np.unpackbits(marks, axis=1), dense, norm).astype(float)
    y = (l[:, None] == np.array(langs)[None, :]).astype(float)
    mean = y.mean(0)
    alpha = np.linalg.solve(k.T @ k + ridge * len(k) / len(marks) * (mm + 1e-6 * np.eye(len(marks))), k.T @ (y - mean))
    return Model(tuple(langs), marks, np.vstack([alpha, mean]))


def predict(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, and score: the winner's regression value, within 0 and 1."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # landmarks of 4 kB each

    def apply(batches):
        model = held.value
        dense, norm = model.matrix()
        names = np.array([*model.langs, "und"], object)
        for batch in batches:
            for a, b, x, has in presence(batch.column(1)):
                if model.langs:
                    out = kernel(x, dense, norm) @ model.weights[:-1] + model.weights[-1]
                    best = out.argmax(1)
                    top = np.where(has, np.clip(out.max(1), 0, 1), 0.0)
                    best = np.where(has, best, len(model.langs))
                else:
                    best, top = np.zeros(b - a, np.int64), np.zeros(b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(names[best].tolist(), pa.string()), pa.array(top)], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("t"))
    return rows.mapInArrow(apply, f"doc_id {rows.schema[0].dataType.simpleString()}, lang_pred string, score double")
