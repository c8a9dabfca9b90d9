"""Validators on a stream: every micro-batch is counted while it is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation

from ..operators.validate import Validator, tallies
from ..session import fresh_path

REPORT = "feature string, severity string, violations long, example string"


def drain_validated(
    stream: DataFrame, validators: dict[str, Validator], purpose: str, base: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Run a stream over everything available: (rows, reports per micro-batch).

    The counts are observed on the rows as they are written, without a second pass; a report
    has the columns of ``validate.report`` and the micro-batch.  Folders are named after the
    micro-batch, so one that runs again replaces itself.  With the ``base`` folder of an earlier
    run it goes on from that run's checkpoint.
    """
    spark = stream.sparkSession
    base = base or fresh_path(spark, purpose)

    def write(batch: DataFrame, batch_id: int) -> None:
        seen = Observation(f"violations-{batch_id}")
        batch.observe(seen, *tallies(batch, validators)).write.mode("overwrite").parquet(f"{base}/rows/micro_batch={batch_id}")
        counts = seen.get
        rows = [(n, v.severity, counts[f"__n{i}"], counts[f"__e{i}"]) for i, (n, v) in enumerate(validators.items())]
        report = batch.sparkSession.createDataFrame(rows, REPORT).coalesce(1)
        report.write.mode("overwrite").parquet(f"{base}/reports/micro_batch={batch_id}")

    query = (
        stream.writeStream.option("checkpointLocation", f"{base}/checkpoint")
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    rows = spark.read.schema(f"{names}, micro_batch long").parquet(f"{base}/rows")
    return rows, spark.read.schema(f"{REPORT}, micro_batch long").parquet(f"{base}/reports")
