"""File sources: Parquet, CSV and JSON, batch or streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SpecError
from ..functions.names import normalize_columns
from ..functions.time import parse_mixed_ts
from ..operators.filters import additional_filters, partition_bounds, time_range


def zoned(schema: T.StructType) -> T.StructType:
    """The same schema with zone-less timestamps read as timestamps (UTC session)."""
    return T.StructType(
        [
            T.StructField(f.name, T.TimestampType(), f.nullable, f.metadata)
            if isinstance(f.dataType, T.TimestampNTZType)
            else f
            for f in schema
        ]
    )


def read_parquet(
    spark: SparkSession,
    path: str,
    columns: list[str] | None = None,
    time_field: str | None = None,
    start=None,
    end=None,
    filters=None,
    schema: T.StructType | None = None,
    now=None,
) -> DataFrame:
    """Parquet file or folder; columns, time range and filters reach the scan."""
    schema = schema or zoned(spark.read.parquet(path).schema)
    return _shape(spark.read.schema(schema).parquet(path), columns, time_field, start, end, filters, now)


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    parse_dates: list[str] | None = None,
    time_field: str | None = None,
    columns: list[str] | None = None,
    start=None,
    end=None,
    filters=None,
    now=None,
) -> DataFrame:
    """CSV with a header; the time field and ``parse_dates`` become timestamps.

    Without a schema Spark infers it, which reads the data twice.
    """
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = normalize_columns(reader.csv(path))
    dates = [*(parse_dates or []), *([time_field] if time_field else [])]
    for name in dict.fromkeys(dates):
        if not isinstance(df.schema[name].dataType, T.TimestampType):
            df = df.withColumn(name, parse_mixed_ts(F.col(name).cast("string")))
    return _shape(df, columns, time_field, start, end, filters, now)


def read_json(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    columns: list[str] | None = None,
    time_field: str | None = None,
    start=None,
    end=None,
    filters=None,
    now=None,
) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return _shape(reader.json(path), columns, time_field, start, end, filters, now)


def _shape(df, columns, time_field, start, end, filters, now):
    if (start is not None or end is not None) and not time_field:
        raise SpecError("a time range needs a time field")
    if time_field and (start is not None or end is not None):
        pruned = partition_bounds(df.columns, start, end, now)
        df = df if pruned is None else df.where(pruned)
        df = time_range(df, time_field, start, end, now)
    df = additional_filters(df, filters)
    return df.select(*columns) if columns else df


def stream_files(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    fmt: str = "parquet",
    max_files: int | None = None,
    **options,
) -> DataFrame:
    """Files as an event stream; streams need an explicit schema."""
    reader = spark.readStream.format(fmt).schema(zoned(schema)).options(**options)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def register_view(df: DataFrame, name: str) -> DataFrame:
    """Expose a scan under a name and return it read back through the view."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def offline_target(targets: dict[str, str]) -> tuple[str, str]:
    """(format, path) to read a set from: Parquet, else CSV, else the first target."""
    if not targets:
        raise SpecError("the feature set has no offline target")
    for fmt in ("parquet", "csv"):
        if fmt in targets:
            return fmt, targets[fmt]
    return next(iter(targets.items()))


def read_offline(spark: SparkSession, targets: dict[str, str], **options) -> DataFrame:
    fmt, path = offline_target(targets)
    readers = {"parquet": read_parquet, "csv": read_csv, "json": read_json}
    if fmt not in readers:
        raise SpecError(f"target {fmt!r} cannot be read back as a table")
    return readers[fmt](spark, path, **options)


def to_dataframe(
    feature_set,
    columns: list[str] | None = None,
    start=None,
    end=None,
    time_column: str | None = None,
    filters=None,
    now=None,
) -> DataFrame:
    """Read a feature set: entities and time column first, then the asked columns."""
    df = feature_set.frame()
    time_column = time_column or feature_set.timestamp_key
    df = _shape(df, None, time_column, start, end, filters, now)
    if not columns:
        return df
    head = [*feature_set.entities, *([feature_set.timestamp_key] if feature_set.timestamp_key else [])]
    return df.select(*dict.fromkeys([*head, *columns]))
