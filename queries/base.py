"""Registry and table access shared by the query modules."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.files import read_parquet, zoned

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_SCHEMAS: dict[str, object] = {}


def query(name: str, sql: str | None = None):
    """Register a query under an operator id."""

    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str, **options) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = zoned(spark.read.parquet(path).schema)
    return read_parquet(spark, path, schema=_SCHEMAS[path], **options)


def schema_of(spark: SparkSession, sf_dir: str, name: str):
    return table(spark, sf_dir, name).schema


def money(column, digits: int = 2) -> Column:
    """Rounded double, so both sides print the same digits."""
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


def end_sql(ts: str, seconds: int) -> str:
    """SQL for the end of the epoch-aligned tumbling window of a timestamp."""
    return f"make_timestamp((epoch_us({ts}) // {seconds * 1_000_000} + 1) * {seconds * 1_000_000})"
