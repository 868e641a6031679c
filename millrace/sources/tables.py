"""Readers: delimited text with null tokens and inferred types, and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.columns import infer, na_to_null, widest


class NoData(ValueError):
    """The source has no columns or no rows."""


class ShapeMismatch(ValueError):
    """Rows or names do not fit the columns."""


def _typed(raw: DataFrame, where: str) -> DataFrame:
    """Trimmed text with null tokens as nulls; each column as the widest type of its fields."""
    found = raw.agg(*[widest(infer(F.col(f"`{c}`"))).alias(c) for c in raw.columns]).first()
    if found is None or found[0] is None:
        raise NoData(where)
    kind = {"null": "string", "long": "bigint", "double": "double", "string": "string"}
    return raw.select(*[na_to_null(F.col(f"`{c}`")).try_cast(kind[found[c]]).alias(c) for c in raw.columns])


def read_csv(spark: SparkSession, path: str, header: bool = True, sep: str = ",") -> DataFrame:
    """Delimited files with trimmed names, or Column0, Column1, ... without a header line."""
    raw = spark.read.csv(path, header=header, sep=sep, inferSchema=False)
    if not raw.columns:
        raise NoData(path)
    return _typed(raw.toDF(*[c.strip() if header else f"Column{i}" for i, c in enumerate(raw.columns)]), path)


def read_lines(lines: DataFrame, names: list[str], sep: str = ",") -> DataFrame:
    """Delimited text from the one column of lines, with the given names."""
    text = lines.columns[0]
    fields = lines.select(F.from_csv(F.col(text), ", ".join(f"c{i} string" for i in range(len(names))), {"sep": sep}).alias("r"))
    return _typed(fields.select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(names)]), "lines")


def from_rows(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A table of given rows; without rows its columns are text."""
    if any(len(r) != len(names) for r in rows):
        raise ShapeMismatch(f"rows of {len(names)} cells are needed")
    return spark.createDataFrame(rows, names) if rows else spark.createDataFrame([], ", ".join(f"`{c}` string" for c in names))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
