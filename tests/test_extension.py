"""Bucketed tables, user code as UDFs, table functions, parsed events."""

import json
import os

import pandas as pd
import pytest
from pyspark.errors import AnalysisException, PythonException
from pyspark.sql import functions as F

from tidemark.errors import SpecError
from tidemark.functions.tables import register_table_functions
from tidemark.operators import scoring
from tidemark.session import fresh_path
from tidemark.sinks import buckets
from tidemark.streaming import predictions

KEYS = ["k"]


def rows(spark, items):
    return spark.createDataFrame(items, "k string, t long, v string")


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")}


def test_upsert_rewrites_touched_buckets_only(spark):
    path, merge = fresh_path(spark, "buckets"), buckets.keep_newest(KEYS, "t")
    many = [(f"k{i}", 1, "a") for i in range(200)] + [(None, 1, "null")]
    first = buckets.upsert(rows(spark, many), path, KEYS, merge, 16, 0)
    before = files(path)
    assert len(first["folders"]) == 16 and len(before) == 16
    second = buckets.upsert(rows(spark, [("k3", 2, "b"), ("k3", 0, "old"), ("new", 5, "n")]), path, KEYS, merge, 16, 1)
    touched = {b for b in second["folders"] if second["folders"][b] != first["folders"].get(b)}
    assert 1 <= len(touched) <= 2 and len(files(path) - before) == len(touched)
    got = {r["k"]: (r["t"], r["v"]) for r in buckets.read_buckets(spark, path).collect()}
    assert got == {k: (t, v) for k, t, v in many} | {"k3": (2, "b"), "new": (5, "n")}
    old = buckets.read_buckets(spark, path, 0)
    # A batch that runs again, or an empty one, changes nothing.
    assert buckets.upsert(rows(spark, [("k3", 9, "again")]), path, KEYS, merge, 16, 1) == second
    assert buckets.upsert(rows(spark, []), path, KEYS, merge, 16, 2) == second
    assert old.where("k = 'k3'").first()["v"] == "a" and old.count() == 201
    third = buckets.upsert(rows(spark, [("k3", 7, "c")]), path, KEYS, merge, 16)
    assert buckets.vacuum(spark, path, 1) >= 1 and third["batch"] == 1
    assert buckets.read_buckets(spark, path).where("k = 'k3'").first()["v"] == "c"
    assert buckets.read_buckets(spark, path).count() == 202
    with pytest.raises(SpecError):
        buckets.read_buckets(spark, path, 0)
    with pytest.raises(SpecError):
        buckets.upsert(rows(spark, many), path, KEYS, merge, 8)
    with pytest.raises(SpecError):
        buckets.upsert(rows(spark, [("k1", 1, "x")]), path, KEYS, lambda current, batch: rows(spark, many), 16)
    with pytest.raises(SpecError):
        buckets.read_buckets(spark, fresh_path(spark, "nothing"))


def test_failed_merge_leaves_the_table_as_it_was(spark):
    path, merge = fresh_path(spark, "buckets"), buckets.keep_newest(KEYS, "t")
    buckets.upsert(rows(spark, [("a", 1, "x")]), path, KEYS, merge, 4, 0)
    boom = F.udf(lambda v: json.loads("{"), "string")
    with pytest.raises(Exception):
        buckets.upsert(rows(spark, [("a", 2, "y")]), path, KEYS, lambda c, b: b.withColumn("v", boom("v")), 4, 1)
    assert buckets.read_buckets(spark, path).collect() == [("a", 1, "x")]
    buckets.upsert(rows(spark, [("a", 2, "y")]), path, KEYS, merge, 4, 1)
    assert buckets.read_buckets(spark, path).collect() == [("a", 2, "y")]


def test_two_writers_of_one_version(spark):
    path = fresh_path(spark, "buckets")
    found = buckets.upsert(rows(spark, [("a", 1, "x")]), path, KEYS, buckets.keep_newest(KEYS, "t"), 4)
    with pytest.raises(SpecError):
        buckets._publish(spark, path, found)


def test_vote_aggregate_runs_user_code(spark):
    df = spark.createDataFrame(
        [(1, "a", 2.0), (1, "b", 5.0), (1, "c", 9.0), (2, "a", None), (3, "b", 1.0), (3, "a", 4.0), (None, "a", 7.0)],
        "s long, m string, p double",
    )
    spread = scoring.vote_aggregate(df, ["s"], "m", "p", lambda votes, weights: max(votes) - min(votes))
    assert {r["s"]: r["vote"] for r in spread.collect()} == {1: 7.0, 2: None, 3: 3.0, None: 0.0}
    first = scoring.vote_aggregate(df, ["s"], "m", "p", lambda votes, weights: votes[0] * weights[0], {"a": 2.0})
    assert {r["s"]: r["vote"] for r in first.collect()} == {1: 4.0, 2: None, 3: 8.0, None: 14.0}
    assert "ArrowAggregatePython" in spread._jdf.queryExecution().toString()
    assert scoring.vote_aggregate(df.where("false"), ["s"], "m", "p", max).count() == 0


def test_handlers_and_scores(spark):
    df = spark.createDataFrame([(i, float(i), "wide") for i in range(50)], "k long, x double, rest string")
    two = scoring.apply_handler(df, lambda: lambda k, x: k + x, ["k", "x"], "s", "double")
    assert [r["s"] for r in two.orderBy("k").collect()] == [2.0 * i for i in range(50)]
    one = scoring.apply_handler(df, lambda: lambda x: x * x, ["x"], "s", "double")
    assert [r["s"] for r in one.orderBy("k").collect()] == [float(i * i) for i in range(50)]
    with pytest.raises(PythonException):
        scoring.apply_handler(df, lambda: lambda x: x[:-1], ["x"], "s", "double").collect()
    with pytest.raises(SpecError):
        scoring.apply_handler(df, lambda: None, [], "s", "double")

    class Model:
        def predict(self, frame):
            assert list(frame.columns) == ["x"]  # the other columns never reach Python
            return pd.DataFrame({"p": frame["x"] + 1, "q": frame["x"] - 1})

    scored = scoring.score(df, Model, ["x"], ["p", "q"])
    assert scored.columns == ["k", "x", "rest", "p", "q"]
    assert all((r["p"], r["q"]) == (r["x"] + 1, r["x"] - 1) for r in scored.collect())
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython [") == 1


def test_table_functions_in_sql(spark):
    register_table_functions(spark)
    spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], "k long, t string").createOrReplaceTempView("texts")
    found = spark.sql("SELECT * FROM split_rows(TABLE(SELECT * FROM texts), 't', ' ')")
    assert found.columns == ["k", "t", "part", "value"]
    assert sorted((r["k"], r["part"], r["value"]) for r in found.collect()) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "")]
    times = [("x", 0), ("x", 10), ("x", 100), ("y", 5), (None, 1), ("x", None)]
    spark.createDataFrame(times, "u string, s long").selectExpr("u", "timestamp_seconds(s) AS at").createOrReplaceTempView("times")
    found = spark.sql("SELECT u, session, n, unix_seconds(ends) AS e FROM sessions(TABLE(SELECT u, at FROM times), 'u', 'at', '30s')")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([("x", 0, 2, 10), ("x", 1, 1, 100), ("y", 0, 1, 5), (None, 0, 1, 1)], key=repr)
    for bad in ("'missing', ' '", "'t', ''"):
        with pytest.raises(AnalysisException):
            spark.sql(f"SELECT * FROM split_rows(TABLE(SELECT * FROM texts), {bad})").collect()


def test_events_are_parsed_once(spark):
    body = '{"request":{"id":"1","inputs":[[1,2],[3,4]]},"resp":{"id":"1","outputs":[5,6]},"when":"2024-01-01 00:00:00","microsec":7,"model":"m","function_uri":"p/f"}'
    messages = spark.createDataFrame([(body,), ("not json",), (None,)], "body string")
    events = predictions.read_events(messages, "body")
    good, _ = predictions.split_errors(predictions.with_endpoint_id(events))
    unpacked = predictions.unpack(good)
    assert unpacked._jdf.queryExecution().optimizedPlan().toString().count("from_json") <= 10
    assert [(r["features"], r["prediction"]) for r in unpacked.orderBy("part").collect()] == [([1.0, 2.0], [5.0]), ([3.0, 4.0], [6.0])]
    assert events.count() == 3


def test_vote_aggregate_calls_python_per_slot(spark, monkeypatch):
    """Samples share the calls of the grouped aggregate, and each keeps its own votes."""
    monkeypatch.setattr(scoring, "SLOTS", 3)
    monkeypatch.setattr(scoring, "SAMPLES", 7)
    df = spark.range(200).selectExpr("id % 50 AS s", "if(id % 50 = 3, null, 'x') AS t", "cast(id AS STRING) AS m", "cast(id AS DOUBLE) AS p")
    found = scoring.vote_aggregate(df, ["s", "t"], "m", "p", lambda votes, weights: sum(votes))
    assert {(r["s"], r["t"]): r["vote"] for r in found.collect()} == {(s, None if s == 3 else "x"): 4.0 * s + 300 for s in range(50)}
    assert "collect_list" in found._jdf.queryExecution().toString()
