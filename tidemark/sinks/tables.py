"""Online (latest row per key) and time-series targets as Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SpecError
from ..functions.keys import composite_sort_key, static_store_key
from ..operators.joins import latest_per_key


def latest_table(df: DataFrame, keys: list[str], ts: str, aggregates_window: str | None = None) -> DataFrame:
    """Rows of a key-value target: newest row per key, decimals as doubles.

    Two or more keys give a second key column (hashed from three keys on).
    """
    if aggregates_window:
        df = df.drop(aggregates_window)
    latest = latest_per_key(df, keys, ts)
    doubles = {
        f.name: F.col(f.name).cast("double")
        for f in latest.schema
        if isinstance(f.dataType, T.DecimalType)
    }
    latest = latest.withColumns(doubles) if doubles else latest
    second = composite_sort_key(keys)
    return latest if second is None else latest.withColumn("sort_key", second)


def keyed_store_rows(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Newest row per key under a single text key for a string-keyed store."""
    return latest_per_key(df, keys, ts).withColumn("store_key", static_store_key(keys))


def merge_latest(current: DataFrame | None, batch: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Latest table after another batch; late rows never replace newer ones."""
    stacked = batch if current is None else current.unionByName(batch)
    return latest_per_key(stacked, keys, ts)


def series_rows(df: DataFrame, ts: str, labels: list[str], values: list[str]) -> DataFrame:
    """Time-indexed rows keyed by labels, with the date to partition by."""
    missing = [c for c in (ts, *labels, *values) if c not in df.columns]
    if missing:
        raise SpecError(f"columns {missing} are not in the data")
    return df.select(F.col(ts).alias("time"), *labels, *values).withColumn("date", F.to_date("time"))


def series_rollup(
    df: DataFrame, ts: str, labels: list[str], value: str, interval: str = "1 minute"
) -> DataFrame:
    """Count and average per label set and interval."""
    return (
        df.groupBy(*labels, F.window(ts, interval).alias("w"))
        .agg(F.count(value).alias("count"), F.avg(value).alias("avg"))
        .select(*labels, F.col("w.start").alias("time"), "count", "avg")
    )
