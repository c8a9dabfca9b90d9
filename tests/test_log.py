"""The partitioned log: appends, compaction, readers of older versions."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.errors import SpecError
from tidemark.session import fresh_path
from tidemark.sinks import buckets, log
from tidemark.streaming import run

BY = ["model", "hour"]


def part(spark, at, n=8):
    return spark.range(n).select(
        (F.col("id") + at * 100).alias("id"), F.concat(F.lit("a b/{"), (F.col("id") % 2).cast("string")).alias("model"),
        (F.col("id") % 4).cast("int").alias("hour"),
    )


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def stored(path):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")}


def test_compaction_merges_and_readers_keep_their_version(spark):
    path = fresh_path(spark, "log")
    for i in range(6):
        log.append(part(spark, i), path, BY, i)
    everything = ids(log.read_log(spark, path))
    assert everything == sorted(i * 100 + k for i in range(6) for k in range(8))
    assert set(log.file_counts(spark, path).values()) == {6}
    old, version = log.read_log(spark, path), buckets.manifest(spark, path)["version"]
    assert log.compact(spark, path) == 4
    assert set(log.file_counts(spark, path).values()) == {1}
    assert ids(log.read_log(spark, path)) == everything == ids(old) == ids(log.read_log(spark, path, version))
    # Nothing is left to merge; a batch that runs again is not added.
    assert log.compact(spark, path) == 0
    log.append(part(spark, 5), path, BY, 5)
    assert ids(log.read_log(spark, path)) == everything
    # Only the partitions with small files are written again.
    before = stored(path)
    log.append(part(spark, 9).where("hour = 1"), path, BY, 9)
    assert log.compact(spark, path) == 1
    assert len(stored(path) - before) == 2
    assert log.vacuum(spark, path, 1) > 0
    assert len(stored(path)) == 4 and ids(log.read_log(spark, path)) == sorted(everything + [901, 905])


def test_large_files_stay_and_large_partitions_are_split(spark):
    path = fresh_path(spark, "log")
    for i in range(3):
        log.append(spark.range(i * 50_000, (i + 1) * 50_000).select("id", F.lit(1).alias("hour")), path, ["hour"], i)
    size = buckets.manifest(spark, path)["parts"]["hour=1"][0]["bytes"]
    # Larger than half the target: none is small.
    assert log.compact(spark, path, target_bytes=size) == 0
    assert log.compact(spark, path, target_bytes=size * 20) == 1
    assert log.file_counts(spark, path)["hour=1"] <= 2
    assert log.read_log(spark, path).agg(F.sum("id")).first()[0] == sum(range(150_000))


def test_writers_meet(spark, monkeypatch):
    """An append during a compaction stays; the later of two compactions changes nothing."""
    path = fresh_path(spark, "log")
    for i in range(3):
        log.append(part(spark, i), path, BY, i)
    held, inner = log._held, []

    def other(*args):
        found = held(*args)
        if not inner:
            inner.append(1)
            log.append(part(spark, 7), path, BY, 7)
            inner.append(log.compact(spark, path))
        return found

    monkeypatch.setattr(log, "_held", other)
    first = log.compact(spark, path)
    monkeypatch.undo()
    assert (first, inner[1]) == (0, 4)
    assert ids(log.read_log(spark, path)) == sorted(i * 100 + k for i in (0, 1, 2, 7) for k in range(8))
    # Two writers have batch numbers of their own.
    log.append(part(spark, 8), path, BY, 0, writer="other")
    assert len(ids(log.read_log(spark, path))) == 40


def test_pruning_nulls_and_refusals(spark):
    path = fresh_path(spark, "log")
    rows = spark.createDataFrame([(1, None, 1), (2, "x", None), (3, "", 2)], "id long, model string, hour int")
    log.append(rows, path, BY, 0)
    found = log.read_log(spark, path)
    # An empty text is a null partition value, as in every partitioned table.
    assert sorted(map(tuple, found.collect()), key=repr) == [(1, None, 1), (2, "x", None), (3, None, 2)]
    only = log.read_log(spark, path, where=lambda v: v["model"] == "x")
    assert [r["id"] for r in only.collect()] == [2] and len(only.inputFiles()) == 1
    assert ids(log.read_log(spark, path, where=lambda v: False)) == []
    plan = found.where("hour = 2")._jdf.queryExecution().executedPlan().toString()
    assert "hour" in plan.split("PartitionFilters: [")[1].split("]")[0]
    log.append(rows.where("false"), path, BY, 1)
    assert ids(log.read_log(spark, path)) == [1, 2, 3]
    for bad in (lambda: log.append(rows, path, ["hour"], 2), lambda: log.append(rows.withColumn("z", F.lit(1)), path, BY, 2),
                lambda: log.append(rows, path + "x", []), lambda: log.read_log(spark, path + "y"), lambda: log.vacuum(spark, path, 0),
                lambda: log.compact(spark, path, max_files=0)):
        with pytest.raises(SpecError):
            bad()


def test_fifty_micro_batches_leave_two_files_a_partition_at_most(spark):
    source, base = fresh_path(spark, "in"), fresh_path(spark, "run")
    spark.range(50 * 8).select("id", F.concat(F.lit("m"), (F.col("id") % 2).cast("string")).alias("model"), (F.col("id") % 4).cast("int").alias("hour")) \
        .repartition(50).write.parquet(source)
    stream = spark.readStream.schema("id long, model string, hour int").option("maxFilesPerTrigger", 1).parquet(source)
    out = run.drain_log(stream, "log", BY, every=20, base=base)
    assert buckets.manifest(spark, f"{base}/log")["batches"][""] == 49
    assert ids(out) == list(range(400))
    assert max(log.file_counts(spark, f"{base}/log").values()) <= 2
    # A run with nothing new changes nothing.
    assert ids(run.drain_log(stream, "log", BY, every=20, base=base)) == list(range(400))
