"""User-written sources: the Python Data Source API, with a calendar as the example.

A calendar has no file: its rows follow from the options alone, and so do its partitions.  As a
stream its offset is the time up to which windows were read.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..errors import SpecError
from ..functions.time import duration_seconds


def _ranges(start: int, end: int, step: int, per_partition: int) -> list[InputPartition]:
    span = step * per_partition
    return [InputPartition((begin, min(begin + span, end))) for begin in range(start, end, span)]


def _windows(partition: InputPartition, step: int):
    for begin in range(*partition.value, step):
        yield (
            dt.datetime.fromtimestamp(begin, dt.timezone.utc),
            dt.datetime.fromtimestamp(begin + step, dt.timezone.utc),
        )


class CalendarReader(DataSourceReader):
    def __init__(self, start: int, end: int, step: int, per_partition: int):
        self.start, self.end, self.step, self.per_partition = start, end, step, per_partition

    def partitions(self):
        return _ranges(self.start, self.end, self.step, self.per_partition)

    def read(self, partition: InputPartition):
        return _windows(partition, self.step)


class CalendarStreamReader(DataSourceStreamReader):
    """Windows from the last offset to ``end``; a run with a later end goes on where the last one stopped."""

    def __init__(self, start: int, end: int, step: int, per_partition: int):
        self.start, self.end, self.step, self.per_partition = start, end, step, per_partition

    def initialOffset(self) -> dict:
        return {"until": self.start}

    def latestOffset(self) -> dict:
        return {"until": self.end}

    def partitions(self, start: dict, end: dict):
        return _ranges(start["until"], end["until"], self.step, self.per_partition)

    def read(self, partition: InputPartition):
        return _windows(partition, self.step)


class Calendar(DataSource):
    """Windows aligned to the epoch that cover [start, end] (epoch seconds).

    Options: ``start``, ``end``, ``step`` (a duration), ``windows_per_partition``.
    """

    @classmethod
    def name(cls) -> str:
        return "calendar"

    def schema(self) -> str:
        return "window_start timestamp, window_end timestamp"

    def _bounds(self) -> tuple[int, int, int, int]:
        step = duration_seconds(self.options["step"])
        start, end = int(self.options["start"]), int(self.options["end"])
        if end < start:
            raise SpecError("a calendar ends after its start")
        per_partition = int(self.options.get("windows_per_partition", "10000"))
        return start // step * step, (end // step + 1) * step, step, per_partition

    def reader(self, schema) -> DataSourceReader:
        return CalendarReader(*self._bounds())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return CalendarStreamReader(*self._bounds())


def read_custom(spark: SparkSession, source: type[DataSource], schema=None, **options) -> DataFrame:
    """Register a user source class and read through it."""
    spark.dataSource.register(source)
    reader = spark.read.format(source.name()).options(**options)
    return (reader.schema(schema) if schema else reader).load()


def stream_custom(spark: SparkSession, source: type[DataSource], schema=None, **options) -> DataFrame:
    """Register a user source class and read it as a stream."""
    spark.dataSource.register(source)
    reader = spark.readStream.format(source.name()).options(**options)
    return (reader.schema(schema) if schema else reader).load()
