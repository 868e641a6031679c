"""Token files: Parquet with list columns of ids, written for selective reads.

Rows lie in ascending order of doc_id, in files that continue one another. Ids are
delta-encoded (or dictionary-encoded), metadata columns dictionary-encoded; row groups hold a
bounded number of ids and every column has a page index, so a reader can fetch one column, one row
group or the pages of a few documents.

Defined results: a null text is an empty one (only the end id); a null doc_id sorts first; rows
with one doc_id are ordered by their text; an empty table gives no file and an empty result;
other columns are only carried along if named as metadata.
"""

from __future__ import annotations

import os
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_type

from millrace.llm import store, wordtable


@dataclass(frozen=True)
class Layout:
    encoding: str = "delta"  # of the ids: delta or dictionary
    group_tokens: int = 1 << 20  # ids of a row group, at most (or one document)
    page_bytes: int = 1 << 16
    compression: str = "zstd"


def _opened(uri: str, mode: str):
    if (path := store.local_path(uri)) is not None:
        return open(path, mode)  # noqa: SIM115
    files, path = store._filesystem(uri)
    return files.open_input_file(path) if mode == "rb" else files.open_output_stream(path)


def write(docs: DataFrame, folder: str, path: str, id: str = "doc_id", text: str = "text", metadata: tuple[str, ...] = (), end_id: int | None = None, layout: Layout = Layout()) -> list[tuple[str, int, int, int]]:  # noqa: B008
    """Writes all rows below folder (in shared storage); returns address, first id, rows and ids of each file, in order."""
    spark = docs.sparkSession
    scratch = store.Scratch(spark, "tokens")
    files = tuple(wordtable.build(docs, text, path, scratch))
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("t"), *[F.col(m).alias(f"m{k}") for k, m in enumerate(metadata)])
    schema = pa.schema([("doc_id", to_arrow_type(rows.schema[0].dataType)), ("n_tokens", pa.int32()), ("ids", pa.list_(pa.field("element", pa.int32()))), *[(m, to_arrow_type(f.dataType)) for m, f in zip(metadata, rows.schema.fields[2:], strict=True)]])
    wide = {"column_encoding": {"ids.list.element": "DELTA_BINARY_PACKED"}, "use_dictionary": list(metadata)} if layout.encoding == "delta" else {"use_dictionary": ["ids.list.element", *metadata]}

    def put(batches):
        first, writer, held, held_ids, n_rows, n_ids = f"{folder}/tokens-{uuid.uuid4().hex}.parquet", None, [], 0, 0, 0

        def flush():
            nonlocal held, held_ids, writer, sink
            if writer is None:
                sink = _opened(first, "wb")
                writer = pq.ParquetWriter(sink, schema, compression=layout.compression, write_page_index=True, data_page_size=layout.page_bytes, write_statistics=True, **wide)
            table = pa.Table.from_batches(held)
            writer.write_table(table, row_group_size=max(1, table.num_rows))
            held, held_ids = [], 0

        sink = None
        for batch in batches:
            for a, b, ids, offsets in wordtable.encoded(batch.column(1), path, files, end_id):
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)), type=schema.field("ids").type)
                part = [c.slice(a, b - a) for c in batch.columns]
                if held_ids and held_ids + len(ids) > layout.group_tokens:
                    flush()
                held.append(pa.RecordBatch.from_arrays([part[0], pa.array(np.diff(offsets), pa.int32()), lists, *part[2:]], schema=schema))
                held_ids, n_rows, n_ids = held_ids + len(ids), n_rows + b - a, n_ids + len(ids)
        if held:
            flush()
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([first]), pa.array([n_rows], pa.int64()), pa.array([n_ids], pa.int64())], names=["part", "file", "n_rows", "n_ids"])

    if (local := store.local_path(folder)) is not None:
        os.makedirs(local, exist_ok=True)
    ordered = rows.repartitionByRange(store.shards(docs, text), "doc_id").sortWithinPartitions("doc_id", "t")
    made = scratch.table(ordered.mapInArrow(put, "part int, file string, n_rows long, n_ids long"), "written")
    out, before = [], 0
    for r in made.orderBy("part").collect():  # one row for each file
        out.append((r.file, before, r.n_rows, r.n_ids))
        before += r.n_ids
    scratch.drop()
    return out


def read(spark: SparkSession, files: list[tuple[str, int, int, int]], columns: tuple[str, ...] = ("doc_id", "ids"), between: tuple[int, int] | None = None) -> DataFrame:
    """The named columns and start (the ids of all rows before, of all files); other columns are not read.

    between: only rows with doc_id in this closed range; row groups beyond it are skipped by their statistics.
    """
    if not files:
        raise ValueError("no files")
    kept = pq.ParquetFile(_opened(files[0][0], "rb")).schema_arrow
    schema = ", ".join([f"`{c}` {from_arrow_type(kept.field(c).type).simpleString()}" for c in columns] + ["start bigint"])
    needs = list(dict.fromkeys([*columns, "n_tokens", *(["doc_id"] if between else [])]))

    def get(batches):
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with _opened(uri, "rb") as f:
                    file = pq.ParquetFile(f)
                    for g in range(file.num_row_groups):
                        own = needs
                        if between:
                            s = file.metadata.row_group(g).column(0).statistics
                            if s is None or not s.has_min_max or s.max < between[0] or s.min > between[1]:
                                own = ["n_tokens"]
                        for part in file.iter_batches(1024, [g], own):
                            n = part.column("n_tokens").to_numpy().astype(np.int64)
                            at = start + np.cumsum(n) - n
                            start += int(n.sum())
                            if between and own == ["n_tokens"]:
                                continue
                            out = pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], pa.array(at, pa.int64())], names=[*columns, "start"])
                            if between:
                                d = part.column("doc_id")
                                out = out.filter(pc.and_(pc.greater_equal(d, between[0]), pc.less_equal(d, between[1])))
                            yield out

    return _files(spark, files).mapInArrow(get, schema)


def _files(spark: SparkSession, files: list) -> DataFrame:
    frame = spark.createDataFrame([(f[0], f[1]) for f in files], "file string, start long")
    return frame.repartitionByRange(min(len(files), 1 << 14), "start") if len(files) > 1 else frame


def digests(spark: SparkSession, files: list[tuple[str, int, int, int]]) -> DataFrame:
    """From the files: doc_id, start, n_tokens and ids_crc32 of the ids as little-endian unsigned 32-bit integers."""

    def get(batches):
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with _opened(uri, "rb") as f:
                    for part in pq.ParquetFile(f).iter_batches(1024, columns=["doc_id", "ids"]):
                        ids = part.column("ids")
                        at = ids.offsets.to_numpy().astype(np.int64)
                        data = memoryview(ids.values.to_numpy().astype("<u4").tobytes())
                        crc = [zlib.crc32(data[4 * i : 4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                        n = np.diff(at)
                        yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(start + np.cumsum(n) - n, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        start += int(n.sum())

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return _files(spark, files).mapInArrow(get, schema) if files else spark.createDataFrame([], schema)
