"""Parquet and CSV targets, partitioned by time, key or key bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SpecError

# Partition units, coarse to fine.
TIME_UNITS = ("year", "month", "day", "hour", "minute", "second")


def time_partitions(ts: str, unit: str = "hour") -> dict[str, Column]:
    """year, month, .. columns down to ``unit``."""
    if unit not in TIME_UNITS:
        raise SpecError(f"time partitioning {unit!r} is not one of {', '.join(TIME_UNITS)}")
    parts = {
        "year": F.year, "month": F.month, "day": F.day,
        "hour": F.hour, "minute": F.minute, "second": F.second,
    }
    units = TIME_UNITS[: TIME_UNITS.index(unit) + 1]
    return {u: parts[u](F.col(ts)).cast("int") for u in units}


def partition_layout(
    df: DataFrame,
    ts: str | None = None,
    unit: str | None = None,
    columns: list[str] | None = None,
    keys: list[str] | None = None,
    key_buckets: int | None = None,
) -> tuple[DataFrame, list[str]]:
    """Add partition columns; returns the frame and the partition column names.

    ``key_buckets`` 0 partitions by the key itself, N by a hash of it into N buckets.
    """
    names: list[str] = []
    if key_buckets is not None:
        if not keys or key_buckets < 0:
            raise SpecError("key buckets need keys and a number >= 0")
        if key_buckets == 0:
            names += keys
        else:
            df = df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(key_buckets)).cast("int"))
            names.append("bucket")
    names += columns or []
    if unit:
        if not ts:
            raise SpecError("partitioning by time needs a time column")
        parts = time_partitions(ts, unit)
        df = df.withColumns(parts)
        names += parts
    return df, list(dict.fromkeys(names))


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", **layout) -> str:
    """Write Parquet; layout arguments are those of ``partition_layout``.

    Rows are rebalanced by the partition columns: small partitions share tasks, and a
    partition that holds most rows is still written by many.
    """
    df, names = partition_layout(df, **layout)
    writer = (df.hint("rebalance", *names) if names else df).write.mode(mode)
    (writer.partitionBy(*names) if names else writer).parquet(path)
    return path


def csv_frame(df: DataFrame) -> DataFrame:
    """Timestamps as text with microseconds."""
    texts = {
        f.name: F.date_format(f.name, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        for f in df.schema
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))
    }
    return df.withColumns(texts) if texts else df


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    csv_frame(df).write.mode(mode).option("header", True).csv(path)
    return path


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    layout = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
    df.write.mode(mode).option("timestampFormat", layout).json(path)
    return path
