"""Batch intervals, the windows of a prediction log, and result events."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .drift import RESULT_KINDS, STATUSES
from .filters import partition_bounds, time_range
from .stats import describe_numeric, histogram_on_edges

DAY = 86_400


def interval_bounds(endpoints: DataFrame, step: int, grace: int = 0) -> DataFrame:
    """Add ``start`` and ``stop`` (epoch seconds) of the range still to analyze.

    Input: first_request, last_request (timestamps) and last_analyzed (epoch seconds or
    null).  A first run looks back at most one day, or one step if that is longer.
    """
    first = F.unix_seconds("first_request")
    stop = F.unix_seconds("last_request") - grace
    fresh = F.coalesce(F.greatest(first, stop - max(DAY, step)), first)
    return endpoints.withColumns(
        {"start": F.coalesce(F.col("last_analyzed"), F.when(first.isNotNull(), fresh)), "stop": stop}
    )


def batch_intervals(endpoints: DataFrame, step: int, grace: int = 0) -> DataFrame:
    """Touching, complete intervals per row: ``start_time``, ``end_time``."""
    bounded = interval_bounds(endpoints, step, grace)
    starts = F.sequence(F.col("start"), F.col("stop") - step, F.lit(step).cast("long"))
    usable = F.when(F.col("stop") - step >= F.col("start"), starts)
    return (
        bounded.withColumn("__s", F.explode(usable))
        .withColumn("start_time", F.timestamp_seconds("__s"))
        .withColumn("end_time", F.timestamp_seconds(F.col("__s") + step))
        .drop("__s", "start", "stop")
    )


def last_analyzed(endpoints: DataFrame, step: int, grace: int = 0) -> DataFrame:
    """Mark to store after the intervals were produced."""
    bounded = interval_bounds(endpoints, step, grace)
    done = F.floor((F.col("stop") - F.col("start")) / step) * step
    mark = F.when(F.col("stop") >= F.col("start"), F.col("start") + done).otherwise(F.col("start"))
    return bounded.withColumn("last_analyzed", mark.cast("long")).drop("start", "stop")


def select_windows(
    log: DataFrame, endpoints: DataFrame, step: int, ts: str = "timestamp", grace: int = 0
) -> DataFrame:
    """Rows of the log per endpoint, application and interval ``(start, end]``.

    Intervals of one (endpoint, application) touch, so a row's interval is arithmetic on
    its time: an equi join with the endpoint list, no interval join.  Rows outside the
    open range, disabled endpoints and routers drop out; empty windows never appear.  The
    earliest start and the latest end bound the scan, by time and by the log's own time
    partitions, so an old log is not read again.
    """
    active = endpoints
    if "active" in endpoints.columns:
        active = active.where(F.coalesce("active", F.lit(True)))
    if "is_router" in endpoints.columns:
        active = active.where(~F.coalesce("is_router", F.lit(False)))
    bounds = interval_bounds(active, step, grace).select(
        "endpoint_id", "application", "start", F.floor((F.col("stop") - F.col("start")) / step).alias("__n")
    )
    span = bounds.where(F.col("__n") > 0).agg(
        F.min("start").alias("low"), F.max(F.col("start") + F.col("__n") * step).alias("high")
    ).first()
    if span["low"] is None:
        log = log.limit(0)
    else:
        low, high = (dt.datetime.fromtimestamp(span[c], dt.timezone.utc) for c in ("low", "high"))
        log = time_range(log, ts, low, high)
        pruned = partition_bounds(log.columns, low, high)
        log = log.where(pruned) if pruned is not None else log
    micros = F.unix_micros(ts) - F.col("start") * 1_000_000
    index = F.ceil(micros / (step * 1_000_000))
    return (
        log.join(bounds, "endpoint_id")
        .withColumn("__i", index)
        .where(F.col("__i").between(1, F.col("__n")))
        .withColumn("start_time", F.timestamp_seconds(F.col("start") + (F.col("__i") - 1) * step))
        .withColumn("end_time", F.timestamp_seconds(F.col("start") + F.col("__i") * step))
        .drop("start", "__n", "__i")
    )


def record_rows(rows: DataFrame, endpoint_id: str, ts: str | None = None, default_time=None) -> DataFrame:
    """Inference rows ready to append to an endpoint's log."""
    when = F.col(ts).cast("timestamp") if ts else F.lit(None).cast("timestamp")
    fallback = F.lit(default_time).cast("timestamp") if default_time else F.current_timestamp()
    return rows.withColumns(
        {"endpoint_id": F.lit(endpoint_id), "timestamp": F.coalesce(when, fallback)}
    )


def sample_set_stats(
    df: DataFrame, drop: list[str] | None = None, label_columns: list[str] | None = None,
    label_values: dict | None = None,
) -> DataFrame:
    """Reference statistics of a sample set without its dropped columns.

    Missing label columns are added as constants, existing ones kept.
    """
    df = df.drop(*(drop or []))
    missing = [c for c in label_columns or [] if c not in df.columns]
    if missing:
        df = df.withColumns({c: F.lit((label_values or {}).get(c)).cast("double") for c in missing})
    return describe_numeric(df)


def run_app(
    rows: DataFrame,
    groups: list[str],
    edges: dict[str, list[float]],
    tracking: Callable[[tuple, pd.DataFrame], pd.DataFrame],
    schema: str,
) -> DataFrame:
    """User drift function per (endpoint, window).

    ``tracking(key, features)`` gets one row per feature: count, mean, min, max and the
    counts on the reference edges.  Rows themselves stay distributed, so a window of any
    size costs its function only this small table.
    """
    names = list(edges)
    hist = (
        histogram_on_edges(rows, edges, groups)
        .groupBy(*groups, "column")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", "n"))), lambda c: c["n"]).alias("hist"))
    )
    cells = F.array(
        *[F.struct(F.lit(n).alias("column"), F.col(n).cast("double").alias("value")) for n in names]
    )
    numbers = (
        rows.select(*groups, F.inline(cells))
        .groupBy(*groups, "column")
        .agg(
            F.count("value").alias("count"),
            F.avg("value").alias("mean"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
    )
    features = numbers.join(hist, [*groups, "column"])
    out = T._parse_datatype_string(schema)
    full = T.StructType([rows.schema[g] for g in groups] + list(out))

    def call(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = tracking(key, pdf.drop(columns=groups).sort_values("column"))
        for name, value in reversed(list(zip(groups, key))):
            found.insert(0, name, value)
        return found

    return features.groupBy(*groups).applyInPandas(call, full)


# Fields of application events.
BASE_FIELDS = ("endpoint_id", "application_name", "start_infer_time", "end_infer_time")
RESULT_FIELDS = ("result_name", "result_value", "result_kind", "result_status")
METRIC_FIELDS = ("metric_name", "metric_value")

EVENT_SCHEMA = (
    "endpoint_id string, application_name string, start_infer_time timestamp, "
    "end_infer_time timestamp, event_kind string, data string"
)
DATA_SCHEMA = (
    "result_name string, result_value double, result_kind int, result_status int, "
    "result_extra_data string, metric_name string, metric_value double"
)


def normalize_results(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, metrics, bad events) from application events with a JSON ``data`` field.

    A missing kind means a result; an event without a required key is bad.
    """
    data = F.from_json("data", DATA_SCHEMA)
    rows = events.withColumn("__d", data).withColumn(
        "event_kind", F.coalesce("event_kind", F.lit("result"))
    )

    def present(fields, prefix="") -> Column:
        return reduce(lambda a, b: a & b, [F.col(f"{prefix}{f}").isNotNull() for f in fields])

    is_result = (F.col("event_kind") == "result") & present(RESULT_FIELDS, "__d.")
    is_metric = (F.col("event_kind") == "metric") & present(METRIC_FIELDS, "__d.")
    base = present(BASE_FIELDS)
    results = rows.where(base & is_result).select(
        *BASE_FIELDS, *[F.col(f"__d.{f}").alias(f) for f in RESULT_FIELDS]
    )
    metrics = rows.where(base & is_metric).select(
        *BASE_FIELDS, *[F.col(f"__d.{f}").alias(f) for f in METRIC_FIELDS]
    )
    good = F.coalesce(base & (is_result | is_metric), F.lit(False))
    return results, metrics, rows.where(~good).drop("__d")


def alert_kind(kind: Column, status: Column) -> Column:
    """``{kind}_detected`` for status 2, ``{kind}_suspected`` for 1, else null."""
    names = F.create_map(*[x for n, k in RESULT_KINDS.items() for x in (F.lit(k), F.lit(n))])
    suffix = F.when(status == STATUSES["detected"], F.lit("_detected")).when(
        status == STATUSES["potential_detection"], F.lit("_suspected")
    )
    return F.concat(F.element_at(names, kind), suffix)


def alert_events(results: DataFrame) -> DataFrame:
    """One event per result that is detected or suspected."""
    entity = F.concat_ws(".", "endpoint_id", "application_name", F.lit("result"), "result_name")
    return (
        results.withColumn("event_kind", alert_kind(F.col("result_kind"), F.col("result_status")))
        .where(F.col("event_kind").isNotNull())
        .select("event_kind", entity.alias("entity"), F.col("end_infer_time").alias("time"), "result_value")
    )
