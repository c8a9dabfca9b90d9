"""Reads over monitoring series tables (time bounds are inclusive on both ends)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SpecError
from ..functions.time import duration_interval
from .filters import time_range

_FUNCS = {
    "avg": F.avg, "mean": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max,
    "stddev": F.stddev_samp, "first": None, "last": None,
}


def _aggregate(func: str, column: str, ts: str) -> Column:
    if func not in _FUNCS:
        raise SpecError(f"aggregate {func!r} is not supported")
    if func in ("first", "last"):
        return (F.min_by if func == "first" else F.max_by)(column, F.struct(ts, column))
    return _FUNCS[func](column)


def aggregate_series(
    df: DataFrame,
    ts: str,
    columns: list[str],
    funcs: list[str],
    interval: str | None = None,
    sliding: str | None = None,
    groups: list[str] | None = None,
    where: str | Column | None = None,
    start=None,
    end=None,
    limit: int | None = None,
    now=None,
) -> DataFrame:
    """Aggregate a series per group and interval: columns ``{func}_{column}``.

    Without an interval the whole range is one row per group.  ``limit`` keeps the first rows,
    by time and group.
    """
    if sliding and not interval:
        raise SpecError("a sliding step needs an interval")
    df = time_range(df, ts, start, end, now, closed_start=True)
    df = df.where(where) if where is not None else df
    groups = groups or []
    aggs = [_aggregate(f, c, ts).alias(f"{f}_{c}") for c in columns for f in funcs]
    if interval is None:
        out = df.groupBy(*groups).agg(*aggs)
        return out.orderBy(*groups).limit(limit) if limit is not None else out
    window = F.window(ts, duration_interval(interval), duration_interval(sliding or interval))
    out = (
        df.groupBy(*groups, window.alias("__w"))
        .agg(*aggs)
        .select(*groups, F.col("__w.start").alias("start"), F.col("__w.end").alias("end"),
                *[f"{f}_{c}" for c in columns for f in funcs])
    )
    return out.orderBy("start", *groups).limit(limit) if limit is not None else out


def realtime_metrics(
    df: DataFrame, endpoint: str, metrics: list[str], ts: str, start=None, end=None, now=None,
    endpoint_column: str = "endpoint_id",
) -> DataFrame:
    """(metric, time, value) rows of named metric columns of one endpoint."""
    if not metrics:
        raise SpecError("name at least one metric")
    rows = time_range(df.where(F.col(endpoint_column) == endpoint), ts, start, end, now, closed_start=True)
    return rows.unpivot(
        [ts], [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value"
    ).where(F.col("value").isNotNull()).select("metric", F.col(ts).alias("time"), "value")


def read_series(
    df: DataFrame,
    endpoint: str,
    pairs: list[tuple[str, str]],
    name_column: str,
    value_column: str,
    start=None,
    end=None,
    status_column: str | None = None,
    kind_column: str | None = None,
    now=None,
) -> DataFrame:
    """Points of requested (application, name) series; an absent pair gives one no-data row.

    Long format: one row per point, so a long series stays distributed.
    """
    if not pairs:
        raise SpecError("name at least one series")
    inside = reduce(
        lambda a, b: a | b,
        [(F.col("application_name") == a) & (F.col(name_column) == n) for a, n in pairs],
    )
    extra = [c for c in (kind_column, status_column) if c]
    points = time_range(
        df.where((F.col("endpoint_id") == endpoint) & inside), "end_infer_time", start, end, now,
        closed_start=True,
    ).select(
        "application_name",
        F.col(name_column).alias("name"),
        F.col("end_infer_time").alias("time"),
        F.col(value_column).alias("value"),
        *extra,
        F.lit(True).alias("data"),
    )
    present = points.groupBy("application_name", "name").agg(F.lit(1).alias("__one"))
    listed = df.sparkSession.createDataFrame(pairs, "application_name string, name string")
    absent = listed.join(present, ["application_name", "name"], "left_anti").withColumn("data", F.lit(False))
    return points.unionByName(absent, allowMissingColumns=True)


def read_predictions(
    df: DataFrame, endpoint: str, start=None, end=None, func: str | None = None,
    window: str | None = None, ts: str = "time", value: str = "latency", now=None,
) -> DataFrame:
    """Latency points, or their aggregate per window; function and window go together."""
    if (func is None) != (window is None):
        raise SpecError("give both an aggregate function and a window, or neither")
    rows = df.where(F.col("endpoint_id") == endpoint)
    if func is None:
        rows = time_range(rows, ts, start, end, now, closed_start=True)
        return rows.select(F.col(ts).alias("time"), F.col(value).alias("value"))
    out = aggregate_series(rows, ts, [value], [func], window, start=start, end=end, now=now)
    return out.select(F.col("start").alias("time"), F.col(f"{func}_{value}").alias("value"))


def last_request(df: DataFrame, endpoints: list[str] | None = None, ts: str = "time", value: str = "latency") -> DataFrame:
    """Time and latency of the newest request per endpoint."""
    rows = df.where(F.col("endpoint_id").isin(endpoints)) if endpoints else df
    return rows.groupBy("endpoint_id").agg(
        F.max(ts).alias("last_request"), F.max_by(value, F.struct(ts, value)).alias("last_latency")
    )


def drift_status(df: DataFrame, start="now -1d", end="now", now=None, endpoints: list[str] | None = None) -> DataFrame:
    """Worst result status per endpoint in a range, the last day by default."""
    rows = time_range(df, "end_infer_time", start, end, now, closed_start=True)
    rows = rows.where(F.col("endpoint_id").isin(endpoints)) if endpoints else rows
    return rows.groupBy("endpoint_id").agg(F.max("result_status").alias("result_status"))


def metrics_metadata(df: DataFrame) -> DataFrame:
    """Distinct (application, metric) of every endpoint."""
    return df.select("endpoint_id", "application_name", "metric_name").distinct()


def results_metadata(df: DataFrame) -> DataFrame:
    """(application, result) of every endpoint with the newest kind."""
    return df.groupBy("endpoint_id", "application_name", "result_name").agg(
        F.max_by("result_kind", F.struct("end_infer_time", "result_kind")).alias("result_kind")
    )


def error_count(df: DataFrame, ts: str, start=None, end=None, now=None) -> DataFrame:
    rows = time_range(df, ts, start, end, now, closed_start=True)
    return rows.groupBy("endpoint_id").agg(F.count("model_error").alias("error_count"))


def avg_latency(df: DataFrame, start=None, end=None, ts: str = "time", value: str = "latency", now=None) -> DataFrame:
    rows = time_range(df, ts, start, end, now, closed_start=True)
    return rows.groupBy("endpoint_id").agg(F.avg(value).alias("avg_latency"))
