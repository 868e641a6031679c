"""Toxicity by a classifier chain.

The categories are predicted one after the other. Each has a logistic regression on the presence of
hashed words and word beginnings; a later one also sees the probabilities of the earlier ones, which
for its training are out-of-fold predictions. The threshold of each category is the one with the best F
measure of its out-of-fold predictions that holds precision twice as important as recall, as a false
alarm loses a clean document.

Defined results: a null text is an empty one and gets the probability of no feature; a null label
is not learned from; of repeated label rows the highest value counts; repeated and null row ids of
documents are kept; texts are read whole; without labels nothing is toxic; an empty table gives an
empty result; other columns are not touched.

The models are fitted on the driver from at most `sample` labelled documents (a parameter).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernels as K
from millrace.llm import linear

BITS = 18
_PLAIN = K._LOWER.copy()
_PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = 32


def features(column: pa.Array):
    """For slices of rows: first row, end row, distinct feature numbers and offsets by row."""
    data, offsets = K.text_buffers(column)
    for a, b in K.slices(offsets):
        part, at = _PLAIN[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        starts, ends, row = K.word_spans(part, at)
        hashes, rows = [K.span_hashes(part, starts, ends)], [row]
        for k in (4, 5):
            long = np.flatnonzero(ends - starts > k)
            hashes.append(K.span_hashes(part, starts[long], starts[long] + k) * np.uint64(2 * k + 1))
            rows.append(row[long])
        h, r = np.concatenate(hashes) >> np.uint64(64 - BITS), np.concatenate(rows)
        order = np.argsort(r, kind="stable")
        index, cut = K.distinct_in_rows(h[order], r[order], b - a)
        yield a, b, index.astype(np.int64), cut


@dataclass(frozen=True)
class Chain:
    names: tuple[str, ...]
    weights: tuple[tuple[np.ndarray, np.ndarray], ...]
    thresholds: tuple[float, ...]

    def predict(self, x: linear.Sparse) -> np.ndarray:
        out = np.zeros((len(x.offsets) - 1, len(self.names)))
        for k, (w, v) in enumerate(self.weights):
            out[:, k] = linear.sigmoid(x.dot(w) + out[:, :k] @ v[:-1] + v[-1])
        return out


def fit(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], id: str = "doc_id", text: str = "text", sample: int = 8000, folds: int = 5) -> Chain:
    known = labels.select(F.col(id).alias("k"), *[F.col(c).cast("int").alias(f"c{i}") for i, c in enumerate(categories)]).dropna()
    known = linear.bounded(known.groupBy("k").agg(*[F.max(f"c{i}").alias(f"c{i}") for i in range(len(categories))]), "k", sample)

    def extract(batches):
        for batch in batches:
            for a, b, index, cut in features(batch.column(1)):
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(index.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists, *[c.slice(a, b - a) for c in batch.columns[2:]]], names=["k", "x", *[f"c{i}" for i in range(len(categories))]])

    rows = docs.select(F.col(id).alias("k"), F.col(text).alias("t")).join(F.broadcast(known), "k")  # at most `sample` rows
    found = rows.mapInArrow(extract, ", ".join([f"k {rows.schema[0].dataType.simpleString()}, x array<int>", *[f"c{i} int" for i in range(len(categories))]]))
    table = found.dropDuplicates(["k"]).orderBy("k").toArrow().combine_chunks()  # at most `sample` rows
    if not table.num_rows:
        return Chain(categories, tuple((np.zeros(1 << BITS), np.append(np.zeros(i), -50.0)) for i in range(len(categories))), (1.0,) * len(categories))
    column = pa.concat_arrays(table.column("x").chunks)
    x = linear.Sparse(column.flatten().to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(np.diff(column.offsets.to_numpy()))]).astype(np.int64))
    y = np.column_stack([table.column(f"c{i}").to_numpy() for i in range(len(categories))]) > 0
    fold = np.empty(len(y), np.int64)  # each has its share of every combination of labels, whatever their order
    fold[np.lexsort((K.mix64(np.arange(len(y))), y @ (1 << np.arange(y.shape[1]))))] = np.arange(len(y)) % folds
    out, weights, thresholds = np.zeros(y.shape), [], []
    for k in range(len(categories)):
        for f in range(folds):
            here = fold == f
            w, v = linear.fit(x.take(~here), out[~here, :k], y[~here, k], 1 << BITS)
            out[here, k] = linear.sigmoid(x.take(here).dot(w) + out[here, :k] @ v[:-1] + v[-1])
        weights.append(linear.fit(x, out[:, :k], y[:, k], 1 << BITS))
        thresholds.append(_threshold(out[:, k], y[:, k]))
    return Chain(categories, tuple((w.astype(np.float32), v) for w, v in weights), tuple(thresholds))


def _threshold(p: np.ndarray, y: np.ndarray, beta: float = 0.5) -> float:
    """The cut of p with the best F measure, in which recall weighs beta times as much as precision."""
    if not y.any():
        return 1.0
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f = (1 + beta**2) * hit / (np.arange(1, len(y) + 1) + beta**2 * y.sum())
    f[:-1][p[order[1:]] == p[order[:-1]]] = -1  # equal values fall on one side
    k = int(np.argmax(f))
    after = p[order[k + 1]] if k + 1 < len(y) else 0.0
    return float((p[order[k]] + after) / 2)


def score(docs: DataFrame, chain: Chain, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, p_<category> of each category, is_<category> by its threshold."""
    model = docs.sparkSession.sparkContext.broadcast(chain)  # 1 MB for each category

    def apply(batches):
        chain = model.value
        for batch in batches:
            for a, b, index, cut in features(batch.column(1)):
                p = chain.predict(linear.Sparse(index, cut))
                flags = [pa.array(p[:, k] >= t) for k, t in enumerate(chain.thresholds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *[pa.array(p[:, k]) for k in range(p.shape[1])], *flags], names=names)

    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("t"))
    names = ["doc_id", *[f"p_{c}" for c in chain.names], *[f"is_{c}" for c in chain.names]]
    return rows.mapInArrow(apply, ", ".join([f"doc_id {rows.schema[0].dataType.simpleString()}", *[f"p_{c} double" for c in chain.names], *[f"is_{c} boolean" for c in chain.names]]))


def keep_clean(docs: DataFrame, chain: Chain, category: str = "toxic", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text is not in the category."""
    model, k = docs.sparkSession.sparkContext.broadcast(chain), chain.names.index(category)
    at = docs.columns.index(text)

    def apply(batches):
        chain = model.value
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for a, b, index, cut in features(batch.column(at)):
                keep[a:b] = chain.predict(linear.Sparse(index, cut))[:, k] < chain.thresholds[k]
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(apply, docs.schema)
