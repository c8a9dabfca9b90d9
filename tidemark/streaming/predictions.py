"""The prediction stream: ids, error split, unpacking, names and live aggregates.

Every function takes and returns a frame and works on batch and streaming input alike,
except where noted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SpecError
from ..functions.endpoints import endpoint_id, versioned_model
from ..functions.names import metric_names_column
from ..functions.time import duration_interval, duration_seconds, parse_mixed_ts

EVENT_SCHEMA = (
    "function_uri string, model string, version string, class string, `when` string, "
    "microsec long, request struct<id: string, inputs: array<array<double>>>, "
    "resp struct<id: string, outputs: array<array<double>>>, error string, "
    "labels map<string, string>, metrics map<string, double>"
)

# The same with inputs and outputs as they came: nested, flat or a single value.
_RAW_SCHEMA = EVENT_SCHEMA.replace("inputs: array<array<double>>", "inputs: string").replace(
    "outputs: array<array<double>>", "outputs: string"
)

# Live aggregates: default windows and slide.
WINDOWS = ("5m", "1h")
PERIOD = "5m"


def _nested(text: Column, rows: Column | None = None) -> Column:
    """JSON values as a list of lists: nested as they are, flat or single ones wrapped.

    A flat list is one entry, or one entry per input if there are as many (``rows``).
    """
    flat = F.from_json(text, "array<double>")
    each = F.transform(flat, lambda x: F.array(x))
    wrapped = F.array(flat) if rows is None else F.when(F.size(flat) == rows, each).otherwise(F.array(flat))
    single = F.array(F.array(text.try_cast("double")))
    return (
        F.when(text.rlike(r"^\s*\[\s*\["), F.from_json(text, "array<array<double>>"))
        .when(text.rlike(r"^\s*\["), wrapped)
        .when(single[0][0].isNotNull(), single)
    )


def _once(rows: DataFrame, *columns: Column) -> DataFrame:
    """``columns`` computed once a row: the optimizer does not copy them through a generator."""
    return rows.select(F.explode(F.array(F.struct(*columns))).alias("e")).select("e.*")


def read_events(messages: DataFrame, body: str) -> DataFrame:
    """Prediction events from JSON text, with inputs and outputs in any of the accepted forms.

    A model may answer a list of lists, one list of values (one per input, or one answer of
    several values) or a single value; inputs may be one flat list.  Unreadable ones are null,
    which ``missing_field`` reports.
    """
    rows = _once(messages, F.from_json(F.col(body), _RAW_SCHEMA).alias("e")).select("e.*")
    rest = [c for c in rows.columns if c not in ("request", "resp")]
    asked = _once(rows, *[F.col(c) for c in rest], "request", "resp", _nested(F.col("request.inputs")).alias("inputs"))
    request = F.struct(F.col("request.id").alias("id"), F.col("inputs")).alias("request")
    outputs = _nested(F.col("resp.outputs"), F.size("inputs")).alias("outputs")
    answered = F.struct(F.col("resp.id").alias("id"), outputs).alias("resp")
    return _once(asked, *[F.col(c) for c in rest], request, answered).select(*rows.columns)


def with_endpoint_id(events: DataFrame) -> DataFrame:
    """Add ``endpoint_id`` and ``versioned_model``; rows without either source drop out."""
    uri, model, version = F.col("function_uri"), F.col("model"), F.col("version")
    return events.withColumns(
        {
            "endpoint_id": endpoint_id(uri, model, version),
            "versioned_model": versioned_model(model, version),
        }
    ).where(F.col("endpoint_id").isNotNull())


def split_errors(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events without error, error rows counting one each)."""
    errors = events.where(F.col("error").isNotNull()).select(
        "endpoint_id",
        parse_mixed_ts("when").alias("timestamp"),
        F.col("error").alias("model_error"),
        F.lit(1.0).alias("error_count"),
    )
    return events.where(F.col("error").isNull()), errors


def missing_field(events: DataFrame) -> Column:
    """Name of the first required field an event lacks, null for a valid event."""
    required = {
        "when": F.col("when"),
        "request.id": F.coalesce("request.id", "resp.id"),
        "microsec": F.col("microsec"),
        "request.inputs": F.col("request.inputs"),
        "resp.outputs": F.col("resp.outputs"),
    }
    return F.coalesce(*[F.when(c.isNull(), F.lit(n)) for n, c in required.items()])


def unpack(events: DataFrame) -> DataFrame:
    """One row per (inputs[i], outputs[i]) of the valid events."""
    pairs = F.arrays_zip(
        F.col("request.inputs").alias("features"), F.col("resp.outputs").alias("prediction")
    )
    size = F.least(F.size("request.inputs"), F.size("resp.outputs"))
    return (
        events.where(missing_field(events).isNull())
        .select(
            "endpoint_id",
            "function_uri",
            F.col("versioned_model").alias("model"),
            F.col("class").alias("model_class"),
            parse_mixed_ts("when").alias("timestamp"),
            F.coalesce("request.id", "resp.id").alias("request_id"),
            F.col("microsec").alias("latency"),
            "labels",
            "metrics",
            F.posexplode(F.slice(pairs, F.lit(1), size)).alias("part", "__p"),
        )
        .select("*", F.col("__p.features").alias("features"), F.col("__p.prediction").alias("prediction"))
        .drop("__p")
    )


def endpoint_summary(events: DataFrame) -> DataFrame:
    """First and last request and error count per endpoint (update or complete output).

    A checkpointed query resumes these from its own state.
    """
    when = parse_mixed_ts("when")
    faulty = F.col("error").isNotNull() | missing_field(events).isNotNull()
    counted = F.when(F.col("error").isNull(), when)
    return events.groupBy("endpoint_id").agg(
        F.min(counted).alias("first_request"),
        F.max(counted).alias("last_request"),
        F.count_if(faulty).alias("error_count"),
    )


def _generated(values: Column, prefix: str) -> Column:
    return F.transform(values, lambda _, i: F.concat(F.lit(prefix), i.cast("string")))


def _zipped(names: Column, values: Column) -> Column:
    size = F.least(F.size(names), F.size(values))
    return F.map_from_arrays(F.slice(names, F.lit(1), size), F.slice(values, F.lit(1), size))


def map_names(rows: DataFrame, endpoints: DataFrame | None = None) -> DataFrame:
    """Add ``named_features`` and ``named_predictions`` maps.

    ``endpoints``: endpoint_id, feature_names, label_names; unknown names become f0.., p0..
    """
    if endpoints is not None:
        rows = rows.join(
            endpoints.select("endpoint_id", "feature_names", "label_names"), "endpoint_id", "left"
        )
    else:
        none = F.lit(None).cast("array<string>")
        rows = rows.withColumns({"feature_names": none, "label_names": none})

    def names(column: str, values: str, prefix: str) -> Column:
        known = F.when(F.size(column) > 0, F.col(column))
        return F.coalesce(known, _generated(F.col(values), prefix))

    return rows.withColumns(
        {
            "named_features": _zipped(names("feature_names", "features", "f"), F.col("features")),
            "named_predictions": _zipped(names("label_names", "prediction", "p"), F.col("prediction")),
        }
    ).drop("feature_names", "label_names")


def live_aggregates(
    rows: DataFrame, window: str, slide: str = PERIOD, lateness: str | None = None
) -> DataFrame:
    """Prediction count and mean latency per endpoint and sliding window.

    Events are first added up per slide, once each; the windows are merged from those sums, so
    an event is one row of state however many windows it is in.  With ``lateness`` a watermark
    is set, which a streaming query needs to emit and forget windows; rows later than that are
    dropped by the engine.
    """
    if lateness:
        rows = rows.withWatermark("timestamp", duration_interval(lateness))
    if duration_seconds(window) % duration_seconds(slide):
        raise SpecError("the slide must divide the window")
    parts = rows.groupBy("endpoint_id", F.window("timestamp", duration_interval(slide)).alias("part")).agg(
        F.count("latency").alias("n"), F.sum("latency").alias("total")
    )
    span = F.window("part", duration_interval(window), duration_interval(slide))
    return (
        parts.groupBy("endpoint_id", span.alias("w"))
        .agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        .select(
            "endpoint_id", F.col("w.end").alias("timestamp"), F.col("n").alias(f"predictions_count_{window}"),
            F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias(f"latency_avg_{window}"),
        )
    )


def with_rate(rows: DataFrame, window: str = "5m") -> DataFrame:
    """Predictions per second over a window."""
    rate = F.col(f"predictions_count_{window}") / duration_seconds(window)
    return rows.withColumn("predictions_per_second", rate)


def three_records(rows: DataFrame, base: list[str]) -> DataFrame:
    """Base metrics, endpoint features and, if given, custom metrics of each event.

    One output row per record: record_type, timestamp, endpoint_id, fields.
    """
    metrics = F.map_from_arrays(
        F.array(*[F.lit(b) for b in base]), F.array(*[F.col(b).cast("double") for b in base])
    )
    named = metric_names_column(F.map_concat("named_predictions", "named_features"))

    def record(kind: str, fields: Column) -> Column:
        return F.struct(F.lit(kind).alias("record_type"), fields.alias("fields"))

    custom = F.when(F.size("metrics") > 0, record("custom_metrics", F.col("metrics")))
    records = F.array_compact(
        F.array(record("base_metrics", metrics), record("endpoint_features", named), custom)
    )
    return rows.select("timestamp", "endpoint_id", F.inline(records))


def log_rows(rows: DataFrame) -> DataFrame:
    """Inference-log rows with the partition columns endpoint, year, month, day, hour."""
    return rows.withColumns(
        {
            "key": F.col("endpoint_id"),
            "year": F.year("timestamp"),
            "month": F.month("timestamp"),
            "day": F.day("timestamp"),
            "hour": F.hour("timestamp"),
        }
    )


LOG_PARTITIONS = ["key", "year", "month", "day", "hour"]
