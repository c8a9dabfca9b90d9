"""Readers for systems outside Spark.

The option builders are plain and tested; the readers hand them to Spark's connectors.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SpecError
from ..functions.time import parse_time_expr


def time_query(table: str, time_field: str | None, start=None, end=None, now=None) -> str:
    """SQL text with the time range ``(start, end]`` inside, for pushdown."""
    text = f"SELECT * FROM {table}"
    if (start is None and end is None) or not time_field:
        return text
    terms = []
    for value, op in ((start, ">"), (end, "<=")):
        if value is not None:
            moment = parse_time_expr(value, now).astimezone(dt.timezone.utc)
            terms.append(f"{time_field} {op} '{moment:%Y-%m-%d %H:%M:%S.%f}'")
    return f"{text} WHERE {' AND '.join(terms)}"


def jdbc_options(
    url: str, table: str | None = None, query: str | None = None, time_field: str | None = None,
    start=None, end=None, partition_column: str | None = None, bounds: tuple | None = None,
    partitions: int | None = None, fetch_size: int | None = None, now=None,
) -> dict:
    """Options of ``spark.read.format("jdbc")``.

    With a partition column and bounds the read is split over ``partitions`` tasks; without
    them a JDBC read is a single task.
    """
    if bool(table) == bool(query):
        raise SpecError("give a table or a query")
    options = {"url": url}
    text = query or time_query(table, time_field, start, end, now)
    if partition_column:
        if not bounds or not partitions:
            raise SpecError("a split read needs bounds and a number of partitions")
        options |= {
            "dbtable": f"({text}) q",
            "partitionColumn": partition_column,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    else:
        options["query"] = text
    if fetch_size:
        options["fetchsize"] = str(fetch_size)
    return options


def bigquery_options(
    table: str | None = None, query: str | None = None, materialization_dataset: str | None = None,
    project: str | None = None, time_field: str | None = None, start=None, end=None,
    now=None, **options,
) -> dict:
    """Options of the BigQuery connector; a query needs a dataset to materialize in."""
    if bool(table) == bool(query):
        raise SpecError("give a table or a query")
    found = dict(options)
    if project:
        found["parentProject"] = project
    if query:
        if not materialization_dataset:
            raise SpecError("a query needs a materialization dataset")
        return found | {
            "viewsEnabled": "true", "materializationDataset": materialization_dataset, "query": query,
        }
    found["table"] = table
    where = time_query(table, time_field, start, end, now).partition(" WHERE ")[2]
    return found | ({"filter": where} if where else {})


def snowflake_options(
    url: str, user: str, password: str, database: str, schema: str, warehouse: str,
    table: str | None = None, query: str | None = None, application: str = "tidemark",
) -> dict:
    """Options of the Snowflake connector; exactly one of table and query."""
    if bool(table) == bool(query):
        raise SpecError("give a table or a query")
    return {
        "sfURL": url, "sfUser": user, "sfPassword": password, "sfDatabase": database,
        "sfSchema": schema, "sfWarehouse": warehouse, "application": application,
        **({"dbtable": table} if table else {"query": query}),
    }


def kafka_options(
    brokers: list[str] | str, topics: list[str], group: str | None = None,
    initial_offset: str = "earliest", partitions: dict[str, list[int]] | None = None,
    sasl: dict | None = None, **options,
) -> dict:
    """Options of ``spark.readStream.format("kafka")``."""
    if not brokers or not topics:
        raise SpecError("a Kafka source needs brokers and topics")
    if initial_offset not in ("earliest", "latest"):
        raise SpecError("initial offset is earliest or latest")
    found = {
        "kafka.bootstrap.servers": brokers if isinstance(brokers, str) else ",".join(brokers),
        "startingOffsets": initial_offset,
    }
    if partitions:
        found["assign"] = json.dumps(partitions)
    else:
        found["subscribe"] = ",".join(topics)
    if group:
        found["kafka.group.id"] = group
    if sasl:
        login = (
            "org.apache.kafka.common.security.plain.PlainLoginModule required "
            f'username="{sasl["user"]}" password="{sasl["password"]}";'
        )
        found |= {
            "kafka.security.protocol": "SASL_SSL" if sasl.get("tls") else "SASL_PLAINTEXT",
            "kafka.sasl.mechanism": sasl.get("mechanism", "PLAIN"),
            "kafka.sasl.jaas.config": login,
        }
    return found | {k: str(v) for k, v in options.items()}


def kafka_events(messages: DataFrame, schema: T.StructType) -> DataFrame:
    """Decode JSON message values; a body that does not parse gives a null event."""
    body = F.from_json(F.col("value").cast("string"), schema, {"mode": "PERMISSIVE"})
    return messages.select(
        F.col("key").cast("string").alias("event_key"),
        F.col("timestamp").alias("event_time"),
        body.alias("event"),
    ).select("event_key", "event_time", "event.*")


def read_kafka(spark: SparkSession, schema: T.StructType, **options) -> DataFrame:
    reader = spark.readStream.format("kafka").options(**kafka_options(**options))
    return kafka_events(reader.load(), schema)


def read_jdbc(spark: SparkSession, **options) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(**options)).load()


def read_bigquery(spark: SparkSession, **options) -> DataFrame:
    return spark.read.format("bigquery").options(**bigquery_options(**options)).load()


def read_snowflake(spark: SparkSession, **options) -> DataFrame:
    return spark.read.format("snowflake").options(**snowflake_options(**options)).load()
