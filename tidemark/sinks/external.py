"""Writers for systems outside Spark.

The option builders are plain and tested; the writers hand them to Spark's connectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SpecError
from ..sources.external import snowflake_options

_JDBC_MODES = {"append": "append", "replace": "overwrite", "fail": "errorifexists"}


def jdbc_write_options(url: str, table: str, if_exists: str = "append", **options) -> tuple[str, dict]:
    """(save mode, options) for ``df.write.format("jdbc")``."""
    if if_exists not in _JDBC_MODES:
        raise SpecError(f"if_exists must be one of {', '.join(_JDBC_MODES)}")
    if not url or not table:
        raise SpecError("a SQL target needs a url and a table")
    return _JDBC_MODES[if_exists], {"url": url, "dbtable": table, **options}


def create_table_types(df: DataFrame, primary_key: str | None = None) -> str:
    """``createTableColumnTypes`` value with the key column not null."""
    return ", ".join(
        f"{f.name} {f.dataType.simpleString()}" + (" NOT NULL" if f.name == primary_key else "")
        for f in df.schema
    )


def kafka_write_options(brokers: list[str] | str, topic: str, **producer) -> dict:
    servers = brokers if isinstance(brokers, str) else ",".join(brokers)
    if not servers or not topic:
        raise SpecError("a Kafka target needs brokers and a topic")
    return {
        "kafka.bootstrap.servers": servers,
        "topic": topic,
        **{f"kafka.{k}": str(v) for k, v in producer.items()},
    }


def kafka_rows(df: DataFrame, key: str | None = None) -> DataFrame:
    """key/value rows: the whole row as JSON text."""
    value = F.to_json(F.struct(*df.columns)).alias("value")
    return df.select(*([F.col(key).cast("string").alias("key")] if key else []), value)


def write_jdbc(df: DataFrame, url: str, table: str, if_exists: str = "append", primary_key: str | None = None, **options) -> None:
    mode, found = jdbc_write_options(url, table, if_exists, **options)
    if primary_key:
        found["createTableColumnTypes"] = create_table_types(df, primary_key)
    df.write.format("jdbc").mode(mode).options(**found).save()


def write_snowflake(df: DataFrame, mode: str = "append", **connection) -> None:
    df.write.format("snowflake").mode(mode).options(**snowflake_options(**connection)).save()


def write_kafka(df: DataFrame, brokers, topic: str, key: str | None = None, **producer) -> None:
    kafka_rows(df, key).write.format("kafka").options(**kafka_write_options(brokers, topic, **producer)).save()


def stream_kafka(stream: DataFrame, checkpoint: str, brokers, topic: str, key: str | None = None, **producer):
    """Start a query that appends a stream's rows to a topic."""
    options = kafka_write_options(brokers, topic, **producer)
    writer = kafka_rows(stream, key).writeStream.format("kafka").options(**options)
    return writer.option("checkpointLocation", checkpoint).start()
