import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import SpecError
from tidemark.plans.ingest import Target, check_append, check_targets
from tidemark.session import fresh_path
from tidemark.sinks import custom as committed
from tidemark.sinks import external as sinks
from tidemark.sinks import files as sink_files
from tidemark.sinks import tables
from tidemark.sources import custom, external, files
from tidemark.specs import FeatureSet
from tidemark.types import integer_bounds, spark_type, value_type

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def hours(spark):
    rows = [(i, T0 + dt.timedelta(hours=i), f"k{i % 3}") for i in range(24 * 70)]
    return spark.createDataFrame(rows, "id int, ts timestamp, k string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_time_partitions_are_pruned(spark, hours):
    path = sink_files.write_parquet(hours, fresh_path(spark, "p"), ts="ts", unit="day")
    got = files.read_parquet(spark, path, time_field="ts", start="2024-01-31T05:00:00", end="2024-03-01T02:00:00", columns=["id", "ts"])
    assert "PartitionFilters: [((year" in plan(got) or "PartitionFilters: [(((year" in plan(got)
    assert "PushedFilters: [IsNotNull(ts)" in plan(got)
    want = hours.where((F.col("ts") > F.lit(dt.datetime(2024, 1, 31, 5))) & (F.col("ts") <= F.lit(dt.datetime(2024, 3, 1, 2))))
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in want.collect())


def test_columns_and_filters_reach_the_scan(spark, hours):
    path = sink_files.write_parquet(hours, fresh_path(spark, "p"))
    text = plan(files.read_parquet(spark, path, columns=["id"], filters=[("k", "=", "k1")]))
    assert "EqualTo(k,k1)" in text and "ReadSchema: struct<id:int,k:string>" in text


def test_csv_json_round_trip(spark, hours):
    path = sink_files.write_csv(hours, fresh_path(spark, "c"))
    back = files.read_csv(spark, path, "id int, ts string, k string", time_field="ts")
    assert back.exceptAll(hours).count() == 0 and isinstance(back.schema["ts"].dataType, T.TimestampType)
    jpath = sink_files.write_json(hours, fresh_path(spark, "j"))
    assert files.read_json(spark, jpath, hours.schema).exceptAll(hours).count() == 0
    with pytest.raises(SpecError):
        files.read_json(spark, jpath, hours.schema, start="2024-01-01")


def test_external_options():
    end = "2024-01-02T00:00:00"
    jdbc = external.jdbc_options("jdbc:x", table="t", time_field="ts", start="2024-01-01", end=end)
    assert jdbc["query"] == "SELECT * FROM t WHERE ts > '2024-01-01 00:00:00.000000' AND ts <= '2024-01-02 00:00:00.000000'"
    split = external.jdbc_options("jdbc:x", table="t", partition_column="id", bounds=(0, 10), partitions=4)
    assert split["dbtable"] == "(SELECT * FROM t) q" and split["numPartitions"] == "4"
    assert external.bigquery_options(query="q", materialization_dataset="d")["viewsEnabled"] == "true"
    assert external.bigquery_options(table="t", time_field="ts", end=end)["filter"].startswith("ts <= ")
    kafka = external.kafka_options(["a:1", "b:2"], ["t"], "g", sasl={"user": "u", "password": "p"})
    assert kafka["kafka.bootstrap.servers"] == "a:1,b:2" and kafka["subscribe"] == "t" and "u" in kafka["kafka.sasl.jaas.config"]
    snow = external.snowflake_options("u", "me", "pw", "db", "s", "w", table="t")
    assert snow["dbtable"] == "t" and "query" not in snow
    assert sinks.jdbc_write_options("jdbc:x", "t", "replace")[0] == "overwrite"
    assert sinks.kafka_write_options(["a"], "t", acks=1) == {"kafka.bootstrap.servers": "a", "topic": "t", "kafka.acks": "1"}
    for call in (
        lambda: external.jdbc_options("u"), lambda: external.kafka_options([], ["t"]), lambda: external.bigquery_options(query="q"),
        lambda: sinks.jdbc_write_options("u", "t", "maybe"), lambda: external.snowflake_options("u", "m", "p", "d", "s", "w"),
        lambda: external.jdbc_options("u", table="t", partition_column="id"),
    ):
        with pytest.raises(SpecError):
            call()


def test_create_table_types(spark, hours):
    assert sinks.create_table_types(hours, "id") == "id int NOT NULL, ts timestamp, k string"


def test_kafka_bodies(spark):
    rows = spark.createDataFrame([("k", T0, '{"a": 1}'), ("k", T0, "broken")], "key string, timestamp timestamp, value string")
    got = external.kafka_events(rows, T.StructType([T.StructField("a", T.IntegerType())])).collect()
    assert sorted((r["a"] for r in got), key=str) == [1, None]


def test_custom_source(spark):
    start = int(T0.replace(tzinfo=dt.timezone.utc).timestamp())
    got = custom.read_custom(spark, custom.Calendar, start=start + 70, end=start + 3600, step="1m", windows_per_partition=7)
    rows = got.orderBy("window_start").collect()
    assert len(rows) == 60 and got.rdd.getNumPartitions() == 9
    assert all(r["window_end"] - r["window_start"] == dt.timedelta(minutes=1) for r in rows)
    one = custom.read_custom(spark, custom.Calendar, start=start, end=start, step="1h").collect()
    assert len(one) == 1


def test_custom_stream_goes_on_from_its_offset(spark):
    from tidemark.streaming import run

    start = int(T0.replace(tzinfo=dt.timezone.utc).timestamp())
    base = fresh_path(spark, "calendar")
    sizes = []
    for end in (start + 3599, start + 3599, start + 7000, start + 9000):
        stream = custom.stream_custom(spark, custom.Calendar, start=start, end=end, step="1m", windows_per_partition=25)
        got = run.drain(stream, "calendar", base=base)
        sizes.append(got.count())
    assert sizes == [60, 60, 117, 151]
    assert got.select("window_start").distinct().count() == 151


def test_committed_target(spark):
    path = fresh_path(spark, "committed")
    rows = spark.range(100, numPartitions=4).select("id", F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("s"))
    assert committed.read_committed(spark, path, rows.schema).count() == 0
    committed.write_committed(rows, path)
    committed.write_committed(rows.limit(0), path)
    committed.write_committed(rows.where("id < 10"), path)
    back = committed.read_committed(spark, path, rows.schema)
    assert committed.committed_rows(path) == back.count() == 110
    assert back.exceptAll(rows.unionByName(rows.where("id < 10"))).count() == 0
    # One task fails after the others wrote theirs: nothing of the write is seen.
    broken = rows.withColumn("s", F.when(F.col("id") == 99, F.raise_error(F.lit("broken"))).otherwise(F.col("s")))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="broken"):
            committed.write_committed(broken, path, mode)
        assert committed.read_committed(spark, path, rows.schema).count() == 110
    committed.write_committed(rows.where("id = 7"), path, "overwrite")
    assert [tuple(r) for r in committed.read_committed(spark, path, rows.schema).collect()] == [(7, "7")]
    assert back.count() == 110
    with pytest.raises(SpecError):
        committed.write_committed(rows, path, "ignore")


def test_targets_and_special_columns(spark):
    with pytest.raises(SpecError):
        check_targets([])
    with pytest.raises(SpecError):
        check_targets([Target("a", "parquet", "/x/f.parquet")])
    with pytest.raises(SpecError):
        check_targets([Target("a", "parquet", "/x/f.parquet", unit="day", single_file=True)])
    with pytest.raises(SpecError):
        check_targets([Target("a", "odd", "/x")])
    with pytest.raises(SpecError):
        check_append([Target("a", "csv", "/x")])
    with pytest.raises(SpecError):
        FeatureSet("f", ("id",), "ts").check_special_columns(["id", "TS"])
    with pytest.raises(SpecError):
        FeatureSet("f", ("ts",), "ts")


def test_latest_rows_and_rollup(spark):
    rows = [("a", 1, T0, 1), ("a", 1, T0 + dt.timedelta(seconds=1), 2), ("b", 1, T0, 3)]
    df = spark.createDataFrame(rows, "k string, j int, ts timestamp, v int").withColumn("d", F.col("v").cast("decimal(10,2)"))
    got = tables.latest_table(df, ["k", "j"], "ts")
    assert sorted((r["k"], r["v"], r["sort_key"], r["d"]) for r in got.collect()) == [("a", 2, "1", 2.0), ("b", 3, "1", 3.0)]
    rollup = tables.series_rollup(df, "ts", ["k"], "v").collect()
    assert sorted((r["k"], r["count"], r["avg"]) for r in rollup) == [("a", 2, 1.5), ("b", 1, 3.0)]


def test_types():
    assert integer_bounds("int8") == (-128, 127) and integer_bounds("uint16") == (0, 65535)
    assert value_type(spark_type("uint64")) == "decimal" and value_type(spark_type("int32")) == "int"
    with pytest.raises(SpecError):
        spark_type("odd")
