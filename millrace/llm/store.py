"""Arrays and tables in the folder that the driver and all executors share.

The folder is the one in ``spark.checkpoint.dir``; only where that is unset (as in tests) is a
temporary one taken. Workers write arrays under a name of their own attempt and tell it in a row,
so a repeated or lost task leaves at most a file that nobody reads. Readers memory-map local
files; from other stores they copy a file once per worker into an unlinked temporary file.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = getattr(spark, "_millrace_root", None)
        if root is None:
            made = tempfile.TemporaryDirectory(prefix="millrace-")
            atexit.register(made.cleanup)
            root = spark._millrace_root = "file://" + made.name
    if "://" not in root and not root.startswith("file:"):
        root = "file://" + root
    return root.rstrip("/")


class Scratch:
    """A folder of one run in the shared folder. drop() removes it; what it still holds goes when the session's process ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_root(spark)}/millrace/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df as Parquet and reads it back: cuts the lineage and survives lost executors."""
        df.write.parquet(to := f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(to)

    def folder(self, name: str) -> str:
        path = f"{self.path}/{name}"
        if (local := local_path(path)) is not None:
            os.makedirs(local, exist_ok=True)
        return path

    def remove(self, name: str) -> None:
        self._delete(f"{self.path}/{name}")

    def drop(self) -> None:
        self._delete(self.path)

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # at exit the session may be gone; then only a local folder can still be removed
            if (local := local_path(path)) is not None:
                import shutil

                shutil.rmtree(local, ignore_errors=True)


def local_path(uri: str) -> str | None:
    u = urlparse(uri)
    return unquote(u.path) if u.scheme in ("", "file") else None


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def save(folder: str, name: str, array: np.ndarray) -> str:
    """Writes an array under a unique name; returns its address."""
    full = f"{folder}/{name}-{uuid.uuid4().hex}.npy"
    if (path := local_path(full)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            np.save(f, array, allow_pickle=False)
    else:
        files, path = _filesystem(full)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        with files.open_output_stream(path) as f:
            np.save(f, array, allow_pickle=False)
    return full


@lru_cache(4096)
def mapped(uri: str) -> np.ndarray:
    """A memory map of an array that save() wrote."""
    if (path := local_path(uri)) is None:
        import shutil

        files, path = _filesystem(uri)
        copy = tempfile.NamedTemporaryFile()  # noqa: SIM115  the map outlives the name
        with files.open_input_stream(path) as f:
            shutil.copyfileobj(f, copy)
        copy.flush()
        path = copy.name
    out = np.load(path, mmap_mode="r")
    return out if out.size else np.asarray(out)


def keyed(df: DataFrame, scratch: Scratch, name: str = "rows") -> tuple[DataFrame, str]:
    """df, written with a key of its own for each row, and the name of that column."""
    key = "row_key"
    while key.lower() in {c.lower() for c in df.columns}:
        key += "_"
    return scratch.table(df.withColumn(key, F.monotonically_increasing_id()), name), key


def size_in_bytes(df: DataFrame, text: str | None = None) -> int:
    """What the optimizer takes as the input's size; for a file scan, the size of its files. Where it does not know, the length of the text."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= 1 << 60 and text:
        size = df.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    return size


def shards(df: DataFrame, text: str, each: int = 16 << 20) -> int:
    """How many hash ranges to cut an input into, so that a range stays within a task's memory."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), size_in_bytes(df, text) // each)
