"""What the modules of queries share: the two tables of all queries, and how to add to them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, table: str, make: Callable[[DataFrame], DataFrame], sql: str | None) -> None:
    """A query of one table, with its SQL if it has any."""
    QUERIES[name] = lambda spark, sf_dir: make(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
    if sql:
        ORACLE[name] = sql


def query_of(name: str, tables: tuple[str, ...], make: Callable[..., DataFrame], sql: str | None) -> None:
    """A query of several tables."""
    QUERIES[name] = lambda spark, sf_dir: make(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables])
    if sql:
        ORACLE[name] = sql


def r(c, digits: int = 4) -> Column:
    return F.round(c, digits)
