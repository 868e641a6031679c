"""Packing by power-of-two decomposition.

Each document's ids, with an end id, are cut into pieces whose lengths are the powers of two in
its length: as many of the longest allowed as go in, then the binary digits of the rest, longest
first. A piece is a sequence of its own in the bucket of its length, so no sequence crosses
documents, none is padded, and batches of one bucket have equal lengths.

Defined results: a null text is an empty one, whose only id is the end id; null and repeated row
ids are kept; long texts give many pieces; an empty table gives an empty result; other columns
are not touched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import store, wordtable


def pieces_of(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and length of each piece, for documents of these lengths. most: a power of two."""
    bits = most.bit_length() - 1
    counts = np.stack([lengths // most, *[(lengths >> k) & 1 for k in range(bits - 1, -1, -1)]], axis=1)
    sizes = most >> np.arange(bits + 1)
    doc, kind = np.divmod(np.repeat(np.arange(counts.size), counts.ravel()), bits + 1)
    length = sizes[kind]
    ends = np.cumsum(length)
    first = np.concatenate([[0], np.cumsum(lengths)])[doc]
    return doc, ends - length - first, length


def pack(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", end_id: int = 1, sequence_length: int = 2048) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit integers), doc_tokens, sequence_id, offset.

    sequence_id is made of the input partition, the bucket (the binary logarithm of the length)
    and a rank, so sequences of one length are adjacent when sorted within a partition.
    """
    if sequence_length < 1 or sequence_length & (sequence_length - 1):
        raise ValueError("sequence_length must be a power of two")
    files = tuple(wordtable.build(docs, text, path, store.Scratch(docs.sparkSession, "packing")))

    def apply(batches):
        part = TaskContext.get().partitionId()
        rank = np.zeros(64, np.int64)
        for batch in batches:
            for a, b, ids, offsets in wordtable.encoded(batch.column(1), path, files, end_id):
                doc, start, length = pieces_of(np.diff(offsets), sequence_length)
                bucket = np.log2(length).astype(np.int64)
                sequence = np.zeros(len(doc), np.int64)
                for k in np.unique(bucket).tolist():
                    own = np.flatnonzero(bucket == k)
                    sequence[own] = (part << 40) + (k << 34) + rank[k] + np.arange(len(own))
                    rank[k] += len(own)
                # ids lie in the order of documents and pieces, so the pieces are consecutive
                at = np.concatenate([[0], np.cumsum(length)]) * 4
                data = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(ids.astype("<u4").tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc + a)), pa.array(start), pa.array(length), data, pa.array(np.diff(offsets)[doc]), pa.array(sequence), pa.array(np.zeros(len(doc), np.int64))],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("t"))
    return rows.mapInArrow(apply, f"doc_id {rows.schema[0].dataType.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


