"""Starting queries: bounded runs to a Parquet table and keyed upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.joins import latest_per_key
from ..plans.ingest import drop_versions, latest_version
from ..session import fresh_path
from ..sinks import log
from ..sinks.buckets import BUCKETS, read_buckets, upsert, vacuum
from ..sources.files import read_parquet


def start_parquet(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    partition_by: list[str] | None = None,
    available_now: bool = True,
    interval: str | None = None,
    name: str | None = None,
) -> StreamingQuery:
    """Append a stream to a Parquet folder, exactly once per checkpoint.

    Rows are dealt by the partition columns, so a partition gets a file per micro-batch and not
    one from every task; where the engine adapts, small partitions share tasks and a large one
    is split over several.
    """
    rows = stream.hint("rebalance", *partition_by) if partition_by else stream
    writer = (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .option("path", path)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if name:
        writer = writer.queryName(name)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval or "10 seconds")
    return writer.start()


def drain(
    stream: DataFrame, purpose: str, partition_by: list[str] | None = None, base: str | None = None
) -> DataFrame:
    """Run a stream over everything available and return the written table.

    With the ``base`` folder of an earlier run it goes on from that run's checkpoint.
    """
    spark = stream.sparkSession
    base = base or fresh_path(spark, purpose)
    start_parquet(stream, f"{base}/out", f"{base}/checkpoint", partition_by).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def drain_table(
    stream: DataFrame, purpose: str, mode: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame],
    base: str | None = None,
) -> DataFrame:
    """Fold every micro-batch into a table: ``merge(current, batch)`` gives the next version.

    A version folder is named after its batch, so a repeated batch overwrites itself; the two
    newest versions are kept.  With the ``base`` folder of an earlier run it goes on from that
    run's table and checkpoint.
    """
    spark = stream.sparkSession
    base = base or fresh_path(spark, purpose)
    table = f"{base}/table"

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        before = _version_before(session, table, batch_id)
        current = None if before is None else read_parquet(session, f"{table}/v={before}")
        merge(current, batch).write.mode("overwrite").parquet(f"{table}/v={batch_id}")
        drop_versions(session, table, batch_id - 1)

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{base}/checkpoint")
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return read_parquet(spark, f"{table}/v={latest_version(spark, table)}")


def drain_buckets(
    stream: DataFrame, purpose: str, mode: str, keys: list[str],
    merge: Callable[[DataFrame | None, DataFrame], DataFrame], buckets: int = BUCKETS, base: str | None = None,
) -> DataFrame:
    """Fold every micro-batch into a keyed table, rewriting the buckets it touches only.

    A repeated micro-batch is applied once; the files of the two newest versions are kept.  With
    the ``base`` folder of an earlier run it goes on from that run's table and checkpoint.
    """
    spark = stream.sparkSession
    base = base or fresh_path(spark, purpose)
    table = f"{base}/buckets"

    def write(batch: DataFrame, batch_id: int) -> None:
        upsert(batch, table, keys, merge, buckets, batch_id)
        vacuum(batch.sparkSession, table)

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{base}/checkpoint")
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return read_buckets(spark, table)


def drain_log(
    stream: DataFrame, purpose: str, partition_by: list[str], every: int = 10, target_bytes: int = log.TARGET_BYTES,
    base: str | None = None,
) -> DataFrame:
    """Append every micro-batch to a partitioned log, and merge its small files after each ``every`` batches.

    Compaction runs between micro-batches here; it may as well run in a job of its own.  With the
    ``base`` folder of an earlier run it goes on from that run's log and checkpoint.
    """
    spark = stream.sparkSession
    base = base or fresh_path(spark, purpose)
    table = f"{base}/log"

    def write(batch: DataFrame, batch_id: int) -> None:
        log.append(batch, table, partition_by, batch_id)
        if batch_id % every == every - 1:
            log.compact(batch.sparkSession, table, target_bytes)
            log.vacuum(batch.sparkSession, table)

    query = (
        stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    log.compact(spark, table, target_bytes)
    return log.read_log(spark, table)


def _version_before(spark: SparkSession, table: str, batch_id: int) -> int | None:
    newest = latest_version(spark, table)
    if newest is None or newest < batch_id:
        return newest
    return batch_id - 1 if batch_id > 0 else None


def keep_latest(keys: list[str], ts: str) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """Merge rule: newest row per key."""

    def merge(current: DataFrame | None, batch: DataFrame) -> DataFrame:
        return latest_per_key(batch if current is None else current.unionByName(batch), keys, ts)

    return merge


def replace_keys(keys: list[str]) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """Merge rule: rows of the batch replace the current rows of their keys."""

    def merge(current: DataFrame | None, batch: DataFrame) -> DataFrame:
        if current is None:
            return batch
        return current.join(batch.select(*keys), keys, "left_anti").unionByName(batch)

    return merge


def for_each(stream: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Side effect per micro-batch."""
    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(action)
        .trigger(availableNow=True)
        .start()
    )
