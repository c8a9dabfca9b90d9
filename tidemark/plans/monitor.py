"""The monitoring job: prediction log to drift results, metrics and alert events.

All endpoints, applications and intervals are one grouped plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import drift
from ..operators.monitoring import alert_events, last_analyzed, select_windows

_GROUPS = ["endpoint_id", "application", "start_time", "end_time"]


@dataclass(frozen=True)
class MonitoringRun:
    features: DataFrame
    results: DataFrame
    metrics: DataFrame
    alerts: DataFrame
    marks: DataFrame


def reference_counts(reference: DataFrame, edges: DataFrame) -> DataFrame:
    """Histograms of the reference rows (endpoint_id and features) on their own edges."""
    hist = drift.histogram_per_group(reference, ["endpoint_id"], edges, ["endpoint_id"])
    return drift.counts_array(hist, ["endpoint_id"])


def drift_job(
    log: DataFrame,
    endpoints: DataFrame,
    edges: DataFrame,
    reference: DataFrame,
    features: list[str],
    step: int,
    ts: str = "timestamp",
    grace: int = 0,
    potential: float = 0.5,
    detected: float = 0.7,
) -> MonitoringRun:
    """Histogram drift of every open interval.

    ``endpoints`` lists endpoint, application, first and last request and the last analyzed
    mark; ``edges`` and ``reference`` hold one row per endpoint and feature.
    """
    windows = select_windows(log, endpoints, step, ts, grace)
    hist = drift.histogram_per_group(
        windows.select(*_GROUPS, *features), _GROUPS, edges, ["endpoint_id"]
    )
    per_feature = drift.per_feature(
        drift.counts_array(hist, _GROUPS), reference, _GROUPS, ["endpoint_id"]
    )
    general = drift.general(per_feature, _GROUPS, potential, detected)
    base = [
        "endpoint_id",
        F.col("application").alias("application_name"),
        F.col("start_time").alias("start_infer_time"),
        F.col("end_time").alias("end_infer_time"),
    ]
    results = general.select(
        *base,
        F.lit("general_drift").alias("result_name"),
        F.col("general_drift").alias("result_value"),
        F.lit(drift.RESULT_KINDS["data_drift"]).alias("result_kind"),
        F.col("status").alias("result_status"),
    )
    means = [f"{m}_mean" for m in drift.METRICS]
    metrics = general.select(*base, *means).unpivot(
        ["endpoint_id", "application_name", "start_infer_time", "end_infer_time"],
        means, "metric_name", "metric_value",
    )
    return MonitoringRun(
        per_feature, results, metrics, alert_events(results), last_analyzed(endpoints, step, grace)
    )
