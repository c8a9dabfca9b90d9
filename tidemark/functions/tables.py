"""Table functions for SQL: rows in, any number of rows out, the schema found from the arguments."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..functions.time import duration_seconds


def _text(argument: AnalyzeArgument, name: str) -> str:
    if not argument.isConstantExpression or not isinstance(argument.value, str):
        raise ValueError(f"{name} must be a constant text")
    return argument.value


def _field(schema: T.StructType, name: str) -> T.StructField:
    if name not in schema.fieldNames():
        raise ValueError(f"the table has no column {name}")
    return schema[name]


class SplitRows:
    """``split_rows(TABLE t, column, separator)``: a row per part of a text, with all columns.

    Adds ``part`` (from 0) and ``value``.  A null text gives no row, an empty one an empty part.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, column: AnalyzeArgument, separator: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument must be a table")
        if not _text(separator, "separator"):
            raise ValueError("separator must not be empty")
        _field(rows.dataType, _text(column, "column"))
        added = [T.StructField("part", T.IntegerType()), T.StructField("value", T.StringType())]
        return AnalyzeResult(schema=T.StructType([*rows.dataType.fields, *added]))

    def eval(self, rows: Row, column: str, separator: str) -> Iterator[tuple]:
        if rows[column] is not None:
            for part, value in enumerate(str(rows[column]).split(separator)):
                yield (*rows, part, value)


class Sessions:
    """``sessions(TABLE t, key, time, gap)``: a row per run of a key's rows without a longer pause.

    The function asks for the table partitioned by ``key`` and ordered by ``time`` itself.  Only
    the open session is held.  Rows without a time belong to none.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, time: AnalyzeArgument, gap: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument must be a table")
        duration_seconds(_text(gap, "gap"))
        by, at = _field(rows.dataType, _text(key, "key")), _field(rows.dataType, _text(time, "time"))
        schema = T.StructType([
            T.StructField(by.name, by.dataType), T.StructField("session", T.LongType()), T.StructField("begins", at.dataType),
            T.StructField("ends", at.dataType), T.StructField("n", T.LongType()),
        ])
        return AnalyzeResult(
            schema=schema, partitionBy=[PartitioningColumn(by.name)], orderBy=[OrderingColumn(at.name)],
        )

    def __init__(self):
        self._number, self._open = 0, None

    def eval(self, rows: Row, key: str, time: str, gap: str) -> Iterator[tuple]:
        at = rows[time]
        if at is None:
            return
        if self._open and (at - self._open[2]).total_seconds() > duration_seconds(gap):
            yield self._closed()
        if self._open:
            self._open = (*self._open[:2], at, self._open[3] + 1)
        else:
            self._open = (rows[key], at, at, 1)

    def _closed(self) -> tuple:
        key, begins, ends, n = self._open
        self._number, self._open = self._number + 1, None
        return key, self._number - 1, begins, ends, n

    def terminate(self) -> Iterator[tuple]:
        if self._open:
            yield self._closed()


def register_table_functions(spark: SparkSession) -> None:
    """Make ``split_rows`` and ``sessions`` callable from this session's SQL."""
    spark.udtf.register("split_rows", udtf(SplitRows))
    spark.udtf.register("sessions", udtf(Sessions))
