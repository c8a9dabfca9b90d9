import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.endpoints import endpoint_id
from tidemark.session import fresh_path
from tidemark.sources.files import stream_files
from tidemark.streaming import predictions as pred
from tidemark.streaming import run, stateful

T0 = dt.datetime(2024, 1, 1)


def feed(spark, rows, schema, files=3):
    """Write rows as several small files and open them as a stream, one file per batch."""
    path = fresh_path(spark, "feed")
    df = spark.createDataFrame(rows, schema)
    size = -(-len(rows) // files)
    for i in range(files):
        part = spark.createDataFrame(rows[i * size : (i + 1) * size], schema)
        part.coalesce(1).write.mode("append").parquet(path)
    return df, stream_files(spark, path, df.schema, max_files=1)


@pytest.fixture(scope="module")
def events(spark):
    rows = [(i, "hot" if i % 3 else f"k{i % 2}", T0 + dt.timedelta(minutes=i), float(i)) for i in range(90)]
    return feed(spark, rows, "id long, k string, ts timestamp, v double")


def test_batch_equals_stream_for_windows(events):
    batch, stream = events
    out = run.drain(stateful.late_windows(stream, ["k"], "ts", "20m", "10m", "5m", "v"), "w").collect()
    span = F.window("ts", "20 minutes", "10 minutes")
    want = batch.groupBy("k", span.alias("w")).agg(F.count("*").alias("n"), F.sum("v").alias("total")).where(
        F.col("w.end") <= F.lit(T0 + dt.timedelta(minutes=84)))
    want = {(r["k"], r["w"]["start"], r["n"], r["total"]) for r in want.collect()}
    assert {(r["k"], r["window_start"], r["n"], r["total"]) for r in out} == want


def test_state_runs_over_batches(events):
    _, stream = events

    def count(key, rows, state):
        total = state[0] + rows["v"].sum()
        return pd.DataFrame({"k": [key[0]], "total": [total]}), (total,)

    out = run.drain(stateful.map_with_state(stream, ["k"], count, "k string, total double", "total double", (0.0,)), "s")
    got = {r["k"]: r["t"] for r in out.groupBy("k").agg(F.max("total").alias("t")).collect()}
    assert got["hot"] == sum(i for i in range(90) if i % 3)
    kept = run.drain(stateful.sample_every(stream, ["k"], 7), "x").where("k = 'hot'").collect()
    assert sorted(r["id"] for r in kept) == [i for i in range(90) if i % 3][::7]


def test_merge_and_alerts(events):
    _, stream = events
    merged = run.drain(stateful.merge_parts(stream, "k", "id", 20, "ts", "1d"), "m").collect()
    hot = [i for i in range(90) if i % 3]
    assert sorted(r["parts"] for r in merged if r["k"] == "hot") == [hot[:20], hot[20:40], hot[40:]]
    fired = run.drain(stateful.fire_alerts(stream, ["k"], "ts", 5, "10m"), "a").collect()
    assert sorted(r["id"] for r in fired if r["k"] == "hot") == hot[4::5] and all(r["k"] == "hot" for r in fired)
    once = run.drain(stateful.fire_alerts(stream, ["k"], "ts", 5, "10m", "manual"), "b").collect()
    assert [r["id"] for r in once] == [hot[4]]
    late = run.drain(stateful.count_late(stream, ["k"], "ts"), "l").agg(F.sum("late")).first()[0]
    assert late == 0


def test_incomplete_parts_expire(spark):
    rows = [(0, "a", T0), (1, "b", T0 + dt.timedelta(minutes=1)), (2, "b", T0 + dt.timedelta(hours=5)), (3, "c", T0 + dt.timedelta(hours=9)),
            (4, "c", T0 + dt.timedelta(hours=9)), (5, "d", T0 + dt.timedelta(hours=20))]
    _, stream = feed(spark, rows, "id long, k string, ts timestamp", files=6)
    merged = run.drain(stateful.merge_parts(stream, "k", "id", 2, "ts", "1h"), "m").collect()
    assert sorted((r["k"], r["parts"]) for r in merged) == [("b", [1, 2]), ("c", [3, 4])]


def test_latest_table_and_upserts(events):
    batch, stream = events
    latest = run.drain_table(stream, "kv", "append", run.keep_latest(["k"], "ts"))
    want = {r["k"]: r["i"] for r in batch.groupBy("k").agg(F.max("id").alias("i")).collect()}
    assert {r["k"]: r["id"] for r in latest.collect()} == want
    counts = run.drain_table(stream.groupBy("k").agg(F.count("*").alias("n")), "n", "update", run.replace_keys(["k"]))
    assert {r["k"]: r["n"] for r in counts.collect()}["hot"] == 60


def test_prediction_events(spark):
    import hashlib

    def event(**over):
        base = dict(function_uri="p/f:t", model="m", version=None, **{"class": "C"}, when="2024-01-01 00:00:01", microsec=5,
                    request=("1", [[1.0, 2.0], [3.0, 4.0]]), resp=("1", [[0.0], [1.0]]), error=None, labels={}, metrics={"9a-b": 1.0})
        base.update(over)
        return tuple(base[k] for k in ("function_uri", "model", "version", "class", "when", "microsec", "request", "resp", "error", "labels", "metrics"))

    rows = [event(), event(error="x"), event(function_uri=None), event(microsec=None), event(version="v1", request=(None, [[9.0, 8.0]]), resp=("7", [[2.0]]))]
    df = pred.with_endpoint_id(spark.createDataFrame(rows, pred.EVENT_SCHEMA))
    assert df.count() == 4
    assert df.first()["endpoint_id"] == hashlib.sha1(b"p_f_t_m_latest").hexdigest() and df.first()["versioned_model"] == "m:latest"
    good, errors = pred.split_errors(df)
    assert errors.count() == 1 and good.count() == 3
    unpacked = pred.unpack(good)
    assert sorted((r["request_id"], r["part"], tuple(r["features"])) for r in unpacked.collect()) == [
        ("1", 0, (1.0, 2.0)), ("1", 1, (3.0, 4.0)), ("7", 0, (9.0, 8.0))]
    named = pred.map_names(unpacked).first()
    assert named["named_features"] == {"f0": 1.0, "f1": 2.0} and named["named_predictions"] == {"p0": 0.0}
    records = pred.three_records(pred.map_names(unpacked), ["latency"]).groupBy("record_type").count().collect()
    assert {r["record_type"]: r["count"] for r in records} == {"base_metrics": 3, "endpoint_features": 3, "custom_metrics": 3}
    summary = {r["endpoint_id"]: r["error_count"] for r in pred.endpoint_summary(df).collect()}
    assert sorted(summary.values()) == [0, 2]
    ids = spark.createDataFrame([("p/f@h",), ("p/f",), ("f",)], "u string").select(endpoint_id(F.col("u"), F.lit("m"), F.lit("")).alias("e"))
    assert [r["e"] for r in ids.collect()] == [hashlib.sha1(b"p_f_h_m_latest").hexdigest(), hashlib.sha1(b"p_f_N/A_m_latest").hexdigest(), None]


def test_stream_violations_equal_the_batch_report(spark):
    from pyspark.sql import functions as F

    from tidemark.operators import validate
    from tidemark.session import fresh_path
    from tidemark.sources.files import stream_files
    from tidemark.streaming.checks import drain_validated

    checks = {"v": validate.MinMax("float", low=3, high=40), "k": validate.Regex(pattern="a|b", severity="warn")}
    df = spark.range(60).select(F.col("id").cast("double").alias("v"), F.element_at(F.array(*map(F.lit, "abc")), (F.col("id") % 3 + 1).cast("int")).alias("k"))
    base = fresh_path(spark, "checked")
    for part in range(3):
        # Files that arrive later are later micro-batches; the checkpoint goes on.
        df.where(f"v >= {part * 20} and v < {part * 20 + 20}").coalesce(1).write.mode("append").parquet(f"{base}/in")
        rows, reports = drain_validated(stream_files(spark, f"{base}/in", df.schema), checks, "checked", f"{base}/run")
    assert rows.drop("micro_batch").exceptAll(df).count() == 0 and rows.count() == 60
    assert reports.select("micro_batch").distinct().count() == 3
    for batch in range(3):
        want = {tuple(r) for r in validate.report(rows.where(f"micro_batch = {batch}"), checks).collect()}
        assert {tuple(r)[:4] for r in reports.where(f"micro_batch = {batch}").collect()} == want


def test_partitions_get_one_file_per_micro_batch(spark):
    import glob

    base = fresh_path(spark, "dealt")
    rows = spark.range(4000).select("id", (F.col("id") % 5).alias("part"))
    rows.repartition(6).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 6).parquet(f"{base}/in")
    with_files = run.drain(stream.repartition(6), "dealt", ["part"], f"{base}/run")
    assert with_files.agg(F.sum("id"), F.count("id")).first() == rows.agg(F.sum("id"), F.count("id")).first()
    assert len(glob.glob(f"{base}/run/out/part=*/*.parquet")) == 5
