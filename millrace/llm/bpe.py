"""BPE encoding and decoding through a table of distinct words.

Words are split in Spark, each distinct one is encoded once (see wordtable), and ids are joined
back by position. Decoding joins the distinct ids of each block of rows with their pieces and joins
these back by position. The table of pieces is as long as the vocabulary, whatever the corpus, and
is broadcast; such a join keeps the order of its rows, so the pieces of a block reach the worker
just before its rows, without an exchange. The worker checks that none is missing.

Defined results: a null text counts as empty and gives no ids; a null or repeated id of a row is
kept, one result per input row; texts of any length are encoded whole; an empty table gives an
empty result; other columns of the input, whatever their names, are not touched. In decoding, null
ids and ids that the vocabulary lacks give nothing, bytes that are not UTF-8 are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import store, wordtable


def _encoder(docs: DataFrame, path: str, id: str, text: str) -> tuple[DataFrame, Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]]:
    """Rows of an id and a text, and what gives doc_id and ids of batches of them."""
    files = tuple(wordtable.build(docs, text, path, store.Scratch(docs.sparkSession, "bpe")))

    def apply(batches):
        for batch in batches:
            for a, b, ids, offsets in wordtable.encoded(batch.column(1), path, files):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    return docs.select(F.col(id).alias("doc_id"), F.col(text).alias("t")), apply


def encode(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every row, as the tokenizers library encodes without special tokens added."""
    rows, apply = _encoder(docs, path, id, text)
    return rows.mapInArrow(apply, f"doc_id {rows.schema[0].dataType.simpleString()}, ids array<int>")


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """token and piece: the bytes that each id of the vocabulary stands for."""
    found = wordtable.byte_level(path).bytes_by_id()
    return spark.createDataFrame(pa.table({"token": pa.array(range(len(found)), pa.int32()), "piece": pa.array(found, pa.binary())}))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows that are not null, and where those of each row begin."""
    offsets = np.append(0, np.cumsum(pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)))
    flat = column.flatten()
    if flat.null_count:
        offsets = np.append(0, np.cumsum(flat.is_valid().to_numpy(zero_copy_only=False)))[offsets]
        flat = flat.drop_null()
    return flat.to_numpy(zero_copy_only=False), offsets.astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch of doc_id and ids first its distinct ids, ascending, as token, then its rows."""
    for batch in batches:
        keys = batch.column(0)
        ids, offsets = _lists(batch.column(1))
        own = np.unique(ids)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(own), keys.type), pa.nulls(len(own), pa.list_(pa.int32())), pa.array(own, pa.int32())], names=["doc_id", "ids", "token"])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
        yield pa.RecordBatch.from_arrays([keys, lists, pa.nulls(len(keys), pa.int32())], names=["doc_id", "ids", "token"])


def joined(rows: DataFrame, path: str, apply: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] = iter) -> DataFrame:
    """doc_id, ids, token and piece: the blocks of what apply gives of the rows, each token with its piece."""
    blocks = rows.mapInArrow(lambda batches: _blocks(apply(batches)), f"doc_id {rows.schema[0].dataType.simpleString()}, ids array<int>, token int")
    return blocks.join(F.broadcast(pieces(rows.sparkSession, path)), "token", "left").select("doc_id", "ids", "token", "piece")


def _values(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of all values of a column of large_binary, one after another, and where each begins."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return memoryview(data or b""), at


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, list[bytes], list[bytes]]]:
    """For runs of rows of joined(): doc_id, the number of ids, these in decimals, and the bytes of their pieces."""
    empty = np.zeros(0, np.int32), pa.array([], pa.large_binary())
    tokens, found, block_ends = *empty, True
    for batch in batches:
        is_token = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
        turns = np.flatnonzero(is_token[1:] != is_token[:-1]) + 1
        for a, b in zip([0, *turns.tolist()], [*turns.tolist(), len(is_token)], strict=True):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            if is_token[a]:
                if block_ends:
                    tokens, found = empty
                tokens = np.append(tokens, part.column(2).to_numpy(zero_copy_only=False))
                found = pa.concat_arrays([found, part.column(3).fill_null(b"").cast(pa.large_binary())])
                block_ends = False
                continue
            block_ends = True
            ids, offsets = _lists(part.column(1))
            p = np.searchsorted(tokens, ids)
            if len(ids) and (p.max() >= len(tokens) or not np.array_equal(tokens[p], ids)):
                raise RuntimeError("the piece of an id did not come before its row")
            p = pa.array(p)
            numbers = pa.array([b"%d," % i for i in tokens.tolist()], pa.large_binary())
            out = []
            for values in (numbers, found):
                data, at = _values(values.take(p))
                at = at[offsets].tolist()
                out.append([bytes(data[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)])
            yield part.column(0), np.diff(offsets), *out


def decode(encoded: DataFrame, path: str, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and text: the pieces of all ids, joined. Null ids give an empty text."""

    def apply(batches):
        for keys, _, _, texts in _decoded(batches):
            yield pa.RecordBatch.from_arrays([keys, pa.array([x.decode("utf-8", "replace") for x in texts], pa.string())], names=["doc_id", "text"])

    rows = joined(encoded.select(F.col(id).alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")), path)
    return rows.mapInArrow(apply, f"doc_id {rows.schema[0].dataType.simpleString()}, text string")


def digests(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """encode() and decode() as digests: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def apply(batches):
        for keys, n, numbers, texts in _decoded(batches):
            yield pa.RecordBatch.from_arrays(
                [
                    keys,
                    pa.array(n, pa.int64()),
                    pa.array([hashlib.sha256(x[:-1]).hexdigest() for x in numbers]),
                    pa.array([hashlib.sha256(x.decode("utf-8", "replace").encode()).hexdigest() for x in texts]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    texts, encoder = _encoder(docs, path, id, text)
    rows = joined(texts, path, encoder)
    return rows.mapInArrow(apply, f"doc_id {rows.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
