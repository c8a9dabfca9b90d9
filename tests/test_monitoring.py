import datetime as dt
import json
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.errors import SpecError
from tidemark.operators import alerts, drift, evaluation, monitoring, runs, scoring, series, stats, vectors
from tidemark.operators.documents import chunk, html_text, mask_pii

T0 = dt.datetime(2021, 1, 1, 12)


def distances(spark, p, q, **kw):
    df = spark.createDataFrame([(p, q)], "p array<double>, q array<double>")
    return df.select(drift.tvd(F.col("p"), F.col("q")).alias("t"),
                     drift.hellinger(F.col("p"), F.col("q")).alias("h"), drift.kld(F.col("p"), F.col("q"), **kw).alias("k")).first()


def test_distance_golden(spark):
    p = [0, 1 / 6, 1 / 3, 1 / 2]
    got = distances(spark, [float(x) for x in p], [float(x) for x in p[::-1]])
    assert (got["t"], got["h"], got["k"]) == pytest.approx((0.666666, 0.727045, 8.748242), abs=1e-5)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=3, max_size=6))
def test_distance_properties(spark, values):
    total = sum(values)
    p = [v / total for v in values] if total else [1 / len(values)] * len(values)
    same = distances(spark, p, p)
    assert same["t"] == pytest.approx(0) and same["h"] == pytest.approx(0, abs=1e-6) and same["k"] == pytest.approx(0)
    a, b = distances(spark, p, p[::-1]), distances(spark, p[::-1], p)
    assert a["t"] == pytest.approx(b["t"]) and a["h"] == pytest.approx(b["h"]) and a["k"] == pytest.approx(b["k"])


def test_intervals(spark):
    df = spark.createDataFrame(
        [("a", "x", T0, dt.datetime(2021, 1, 1, 13, 1), None), ("b", "x", T0, T0 + dt.timedelta(seconds=10), None),
         ("c", "x", dt.datetime(2020, 12, 1), T0, None), ("d", "x", None, None, None),
         ("e", "x", T0, dt.datetime(2021, 1, 1, 13, 1), int(dt.datetime(2021, 1, 1, 12, 50, tzinfo=dt.timezone.utc).timestamp()))],
        "endpoint_id string, application string, first_request timestamp, last_request timestamp, last_analyzed long")
    got = {}
    for r in monitoring.batch_intervals(df, 360).collect():
        got.setdefault(r["endpoint_id"], []).append((r["start_time"], r["end_time"]))
    a = sorted(got["a"])
    assert [x[0] for x in a] == [T0 + dt.timedelta(minutes=6 * i) for i in range(10)]
    assert all(x[1] == y[0] for x, y in zip(a, a[1:])) and a[-1][1] == dt.datetime(2021, 1, 1, 13)
    assert "b" not in got and "d" not in got and min(got["c"])[0] == T0 - dt.timedelta(days=1)
    assert got["e"] == [(dt.datetime(2021, 1, 1, 12, 50), dt.datetime(2021, 1, 1, 12, 56))]
    marks = {r["endpoint_id"]: r["last_analyzed"] for r in monitoring.last_analyzed(df, 360).collect()}
    assert marks["a"] == int(dt.datetime(2021, 1, 1, 13, tzinfo=dt.timezone.utc).timestamp())
    log = spark.createDataFrame([("a", T0), ("a", T0 + dt.timedelta(minutes=6)), ("a", T0 + dt.timedelta(minutes=6, seconds=1)),
                                 ("a", dt.datetime(2021, 1, 1, 13, 0, 30))], "endpoint_id string, timestamp timestamp")
    rows = sorted((r["timestamp"], r["start_time"]) for r in monitoring.select_windows(log, df, 360).collect())
    assert rows == [(T0 + dt.timedelta(minutes=6), T0), (T0 + dt.timedelta(minutes=6, seconds=1), T0 + dt.timedelta(minutes=6))]


@pytest.mark.parametrize("max_rows,chunk_size", [(None, 10**6), (10, 7), (10, 1000)])
@pytest.mark.parametrize("period", ["1m", "5m", None])
def test_alerts_brute_force(spark, period, max_rows, chunk_size):
    rng = random.Random(5)
    rows = [(i, "hot" if rng.random() < 0.7 else "cold", T0 + dt.timedelta(seconds=rng.randrange(1500))) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, k string, ts timestamp")
    want = {"auto": [], "manual": [], None: []}
    for key in ("hot", "cold"):
        for mode in want:
            seen, active = [], False
            for i, _, ts in sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0])):
                if active:
                    break
                seen.append(ts)
                if period:
                    seen = [t for t in seen if t > ts - dt.timedelta(minutes=int(period[:-1]))]
                if len(seen) >= 5:
                    want[mode].append(i)
                    if mode:
                        seen, active = [], mode == "manual"
    for mode, ids in want.items():
        got = alerts.fire(df, ["k"], "ts", "id", 5, period, mode, max_rows, chunk_size)
        assert sorted(r["id"] for r in got.collect()) == sorted(ids)


def test_drift_over_endpoints(spark):
    rng = np.random.default_rng(0)
    ref = pd.DataFrame({"endpoint_id": ["a"] * 500 + ["b"] * 500, "x": rng.normal(0, 1, 1000), "y": rng.normal(5, 2, 1000)})
    cur = pd.DataFrame({"endpoint_id": ["a"] * 300 + ["b"] * 300, "x": np.r_[rng.normal(0, 1, 300), rng.normal(9, 1, 300)], "y": rng.normal(5, 2, 600)})
    rdf, cdf = spark.createDataFrame(ref), spark.createDataFrame(cur)
    parts = [stats.value_edges(rdf.where(F.col("endpoint_id") == e), ["x", "y"]).withColumn("endpoint_id", F.lit(e)) for e in "ab"]
    edges = parts[0].unionByName(parts[1]).withColumn("edges", stats.pad_edges(F.col("edges")))
    reference = drift.counts_array(drift.histogram_per_group(rdf, ["endpoint_id"], edges, ["endpoint_id"]), ["endpoint_id"])
    sample = drift.counts_array(drift.histogram_per_group(cdf, ["endpoint_id"], edges, ["endpoint_id"]), ["endpoint_id"])
    features = drift.per_feature(sample, reference, ["endpoint_id"], ["endpoint_id"])
    for r in features.collect():
        x, c = (ref[ref.endpoint_id == r["endpoint_id"]][r["column"]], cur[cur.endpoint_id == r["endpoint_id"]][r["column"]])
        e = np.histogram_bin_edges(x, 20)
        e = np.r_[-np.inf, e, np.inf]
        p, q = np.histogram(c, e)[0] / len(c), np.histogram(x, e)[0] / len(x)
        assert r["tvd"] == pytest.approx(np.abs(p - q).sum() / 2, abs=0.01)
    status = {r["endpoint_id"]: r["status"] for r in drift.general(features, ["endpoint_id"]).collect()}
    assert status["a"] == 0
    with pytest.raises(SpecError):
        drift.check_thresholds(0.7, 0.5)


def test_monitoring_job(spark):
    from tidemark.plans.monitor import drift_job, reference_counts

    rows = [(e, T0 + dt.timedelta(minutes=i), float(i % 10) + (30.0 if e == "b" and i >= 120 else 0.0), 1.0)
            for e in "ab" for i in range(240)]
    rows.append(("a", T0 + dt.timedelta(minutes=130), float("inf"), 1.0))
    log = spark.createDataFrame(rows, "endpoint_id string, timestamp timestamp, x double, c double")
    half = T0 + dt.timedelta(minutes=120)
    ref = log.where(F.col("timestamp") < F.lit(half)).drop("timestamp")
    edges = stats.edges_by_group(ref, ["endpoint_id"], ["x", "c"], padded=True)
    ends = spark.createDataFrame([(e, "app", T0, T0 + dt.timedelta(minutes=240), None) for e in "ab"],
                                 "endpoint_id string, application string, first_request timestamp, last_request timestamp, last_analyzed long")
    run = drift_job(log, ends, edges, reference_counts(ref, edges), ["x", "c"], 3600, potential=0.2, detected=0.4)
    got = {(r["endpoint_id"], r["end_infer_time"].hour): r["result_status"] for r in run.results.collect()}
    assert got == {("a", 13): 0, ("a", 14): 0, ("a", 15): 0, ("a", 16): 0, ("b", 13): 0, ("b", 14): 0, ("b", 15): 2, ("b", 16): 2}
    assert run.metrics.count() == 24 and {r["event_kind"] for r in run.alerts.collect()} == {"data_drift_detected"}
    assert {r["last_analyzed"] for r in run.marks.collect()} == {int((T0 + dt.timedelta(hours=4)).replace(tzinfo=dt.timezone.utc).timestamp())}


def test_scores_without_both_classes(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, s double")
    assert evaluation.auc(df, "y", "s").first()["auc"] is None
    assert evaluation.roc_curve(df, "y", "s").count() == 3


def test_custom_app_gets_feature_table(spark):
    df = spark.createDataFrame([("a", 1, float(i % 5)) for i in range(50)] + [("b", 1, 2.0)], "endpoint_id string, w int, x double")

    def tracking(key, features):
        row = features.iloc[0]
        assert sum(row["hist"]) == row["count"]
        return pd.DataFrame({"name": ["n"], "value": [float(row["count"])]})

    got = monitoring.run_app(df, ["endpoint_id", "w"], {"x": [0.0, 2.0, 4.0]}, tracking, "name string, value double")
    assert sorted(map(tuple, got.collect())) == [("a", 1, "n", 50.0), ("b", 1, "n", 1.0)]


def test_results_and_alert_events(spark):
    base = ("e", "app", T0, T0 + dt.timedelta(hours=1))
    good = json.dumps({"result_name": "drift", "result_value": 0.8, "result_kind": 0, "result_status": 2})
    metric = json.dumps({"metric_name": "m", "metric_value": 1.5})
    df = spark.createDataFrame([(*base, None, good), (*base, "metric", metric), (*base, "result", metric), (*base, "x", good)], monitoring.EVENT_SCHEMA)
    results, metrics, bad = monitoring.normalize_results(df)
    assert (results.count(), metrics.count(), bad.count()) == (1, 1, 2)
    event = monitoring.alert_events(results).first()
    assert event["event_kind"] == "data_drift_detected" and event["entity"] == "e.app.result.drift"


def test_votes_and_scores(spark):
    df = spark.createDataFrame([(0, 1, 2, 0.5), (1, 1, 0, 1.5), (2, 0, 2, 2.5)], "a int, b int, c int, y double")
    assert [r["vote"] for r in scoring.vote(df, ["a", "b", "c"]).collect()] == [0, 1, 2]
    weighted = scoring.vote(df, ["a", "b", "c"], {"a": 0.1, "b": 0.6, "c": 0.1})
    assert [r["vote"] for r in weighted.collect()] == [1, 1, 0]
    assert scoring.vote_weights(["a", "b"], {"a": 0.5}) == {"a": 1.0, "b": 0.0}
    assert scoring.vote_kind(df, ["a", "y"]) == "regression"

    class Model:
        def predict(self, frame):
            return frame[["a"]] * 2 + 1

    assert [r["p"] for r in scoring.score(df, Model, ["a"], ["p"]).collect()] == [1.0, 3.0, 5.0]
    both = scoring.parallel_merge(df, [lambda d: {"s": F.col("a") + 1}, lambda d: {"s": F.col("b"), "t": F.lit(1)}])
    assert [r["s"] for r in both.collect()] == [1, 1, 0]


@pytest.mark.parametrize("max_rows", [None, 20])
def test_roc_and_metrics(spark, max_rows):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 300)
    s = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1), 2)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "s": s}))
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert evaluation.auc(df, "y", "s", max_rows).first()["auc"] == pytest.approx(want)
    curve = evaluation.roc_curve(df, "y", "s", max_rows).orderBy(F.col("threshold").desc()).collect()
    assert (curve[0]["tpr"], curve[-1]["tpr"], curve[-1]["fpr"]) == (0, 1, 1)
    hard = df.withColumn("p", (F.col("s") > 0.5).cast("long"))
    got = evaluation.classification_scores(hard, "y", "p").first()
    p = (s > 0.5).astype(int)
    assert got["accuracy"] == pytest.approx((p == y).mean()) and got["recall"] == pytest.approx(p[y == 1].mean())
    cells = {(r["truth"], r["predicted"]): r["value"] for r in evaluation.confusion(hard, "y", "p", normalize="true").collect()}
    assert cells[1, 1] == pytest.approx(p[y == 1].mean()) and len(cells) == 4
    assert sum(r["n"] for r in evaluation.calibration(df, "y", "s", strategy="quantile").collect()) == 300
    r2 = evaluation.regression_scores(df, "y", "s").first()["r2"]
    assert r2 == pytest.approx(1 - ((y - s) ** 2).sum() / ((y - y.mean()) ** 2).sum())


def test_runs(spark):
    rows = [(1, "completed", {"acc": "-0.5"}), (2, "error", {"acc": "9"}), (3, "completed", {"acc": "-0.2"}), (4, "completed", {"acc": "-0.2"}), (5, "completed", {"acc": "x"})]
    df = spark.createDataFrame(rows, "iter int, state string, results map<string,string>")
    value = F.try_element_at("results", F.lit("acc"))
    assert runs.best_run(df, "max.acc", value).first()["iter"] == 3 and runs.best_run(df, "min.acc", value).first()["iter"] == 1
    flat = runs.flatten_maps(df, {"results": ("output.", runs.map_keys_of(df, "results"))})
    assert flat.columns == ["iter", "state", "output.acc"]


def test_top_k(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(200, 8))
    q = rng.normal(size=(5, 8))
    vdf = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<double>").repartition(5)
    qdf = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(q)], "q int, qv array<double>")
    got = {(r["q"], r["rank"]): r["id"] for r in vectors.top_k(vdf, qdf, "id", "v", "q", "qv", 4).collect()}
    sims = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T
    for i in range(5):
        assert [got[i, k] for k in (1, 2, 3, 4)] == list(np.argsort(-sims[i])[:4])


def test_top_k_takes_any_number_of_queries(spark):
    """More queries than one block, ties to the smaller id."""
    n = 25_000
    qdf = spark.range(n).select(F.col("id").alias("q"), F.array(F.cos(F.col("id")), F.sin(F.col("id"))).alias("qv"))
    vdf = spark.range(40).select("id", F.array(F.cos(F.col("id") % 20), F.sin(F.col("id") % 20)).alias("v"))
    got = vectors.top_k(vdf, qdf, "id", "v", "q", "qv", 2)
    assert got.count() == 2 * n
    near = {(r["q"], r["rank"]): r["id"] for r in got.where("q < 20").collect()}
    assert all(near[q, 1] == q and near[q, 2] == q + 20 for q in range(20))


def test_documents(spark):
    df = spark.createDataFrame([("abcdefghij",), ("abc",), ("",)], "t string")
    assert [r["chunk"] for r in chunk(df, "t", 4, 1).collect()] == ["abcd", "defg", "ghij", "abc"]


@pytest.mark.parametrize("size,overlap", [(1, 0), (4, 0), (10, 8), (7, 3), (500, 100)])
def test_chunks_cover_any_text(spark, size, overlap):
    texts = ["", None, "a", "x" * size, "xy" * size, "\U0001f600b\nc\r" * 211, "z" * (3 * size + overlap)]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "i int, t string, chunk_no int")
    step, want = size - overlap, []
    for i, t in enumerate(texts):
        n = max(-(-(len(t) - overlap) // step), 1) if t else 0
        want += [(i, k, t[k * step : k * step + size]) for k in range(n)]
    got = chunk(df, "t", size, overlap).select("i", "chunk_no", "chunk").orderBy("i", "chunk_no").collect()
    assert [tuple(r) for r in got] == want


def test_key_lists_are_bounded(spark):
    df = spark.range(30).select(F.create_map(F.col("id").cast("string"), F.lit(1)).alias("m"))
    assert len(runs.map_keys_of(df, "m")) == 30
    with pytest.raises(SpecError, match="30 different keys"):
        runs.map_keys_of(df, "m", most=20)
    page = spark.createDataFrame([("<html><style>x{}</style><b>A</b>&amp;B <!-- c --> <script>1</script></html>",)], "h string")
    assert page.select(html_text(F.col("h"))).first()[0] == "A &B"
    pii = spark.createDataFrame([("mail a.b@c.org or call 555 123 4567 now",)], "t string")
    got = mask_pii(pii, "t").first()
    assert got["t"] == "mail john_doe@email.com or call 123456789 now" and (got["n_emails"], got["n_phones"]) == (1, 1)


def test_series(spark):
    df = spark.createDataFrame([("a", T0 + dt.timedelta(minutes=i), float(i)) for i in range(10)], "endpoint_id string, time timestamp, latency double")
    got = series.read_predictions(df, "a", T0, T0 + dt.timedelta(minutes=9), "avg", "5m").orderBy("time").collect()
    assert [r["value"] for r in got] == [2.0, 7.0]
    with pytest.raises(SpecError):
        series.read_predictions(df, "a", func="avg")
    res = spark.createDataFrame([("a", "app", "r", T0, 0.5, 1)], "endpoint_id string, application_name string, result_name string, end_infer_time timestamp, result_value double, result_status int")
    read = series.read_series(res, "a", [("app", "r"), ("app", "z")], "result_name", "result_value", status_column="result_status").collect()
    assert sorted((r["name"], r["data"]) for r in read) == [("r", True), ("z", False)]


def test_rows_without_a_prediction_count_as_wrong(spark):
    df = spark.createDataFrame([(1, 1), (0, 0), (1, None), (0, None), (None, 1)], "t int, p int")
    got = evaluation.classification_scores(df, "t", "p").first()
    assert (got["accuracy"], got["precision"], got["recall"]) == (0.5, 1.0, 0.5)
    cells = {(r["truth"], r["predicted"]): r["value"] for r in evaluation.confusion(df, "t", "p").collect()}
    assert len(cells) == 9 and sum(cells.values()) == 5 and cells[1, None] == 1 and cells[None, 1] == 1


def test_many_labels_need_no_grid(spark):
    df = spark.range(20_000).select((F.col("id") % 7000).alias("t"), (F.col("id") % 7001).alias("p"))
    assert evaluation.classification_scores(df, "t", "p", "macro").first()["accuracy"] == pytest.approx(7000 / 20_000)


def test_scores_on_an_edge_belong_to_the_lower_bin(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 0.2), (1, 0.21), (0, 0.6000000000000001), (1, 1.0)], "y int, s double")
    bins = {r["bin"]: r["n"] for r in evaluation.calibration(df, "y", "s").collect()}
    assert bins == {0: 2, 1: 1, 2: 1, 4: 1}


def test_alerts_with_a_null_key(spark):
    rows = [(None, T0 + dt.timedelta(seconds=i), i) for i in range(23)] + [(7, T0 + dt.timedelta(seconds=i), 100 + i) for i in range(23)]
    df = spark.createDataFrame(rows, "k int, ts timestamp, id long")
    for chunk_size in (2, 6, 1000):
        got = alerts.fire(df, ["k"], "ts", "id", 4, "1h", "auto", chunk=chunk_size).collect()
        fired = {k: sorted(r["id"] % 100 for r in got if r["k"] == k) for k in (None, 7)}
        assert fired[None] == fired[7] == [3, 7, 11, 15, 19]
    # A chunk smaller than the window grows to it.
    assert alerts.fire(df, ["k"], "ts", "id", 20, "1h", None, chunk=3).count() == 8


def test_masking_keeps_every_other_character(spark):
    texts = ["\uffff a@b.co \uffff", "a@b.co, c@d.org 555-123-4567.", "none", "", None, "(12) 345 6789 x@y.zz"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r) for r in mask_pii(df, "t", "E", "P").collect()]
    assert got == [("\uffff E \uffff", 1, 0), ("E, E P.", 2, 1), ("none", 0, 0), ("", 0, 0), (None, None, None), ("P E", 1, 1)]


def test_series_limit_without_interval(spark):
    df = spark.createDataFrame([(f"e{i}", T0, float(i)) for i in range(5)], "e string, time timestamp, v double")
    got = series.aggregate_series(df, "time", ["v"], ["sum"], groups=["e"], limit=2).collect()
    assert [r["e"] for r in got] == ["e0", "e1"]


def test_rounding_is_no_drift_error(spark):
    df = spark.createDataFrame([(1.0000000000000004,), (-1e-16,)], "v double")
    assert [r[0] for r in df.select(drift.classify(F.col("v"))).collect()] == [2, 0]
    with pytest.raises(Exception):
        spark.createDataFrame([(1.01,)], "v double").select(drift.classify(F.col("v"))).collect()


def test_endpoints_of_unknown_state_are_active(spark):
    log = spark.createDataFrame([("a", T0 + dt.timedelta(seconds=30)), ("b", T0 + dt.timedelta(seconds=30))], "endpoint_id string, timestamp timestamp")
    ends = spark.createDataFrame(
        [("a", "app", T0, T0 + dt.timedelta(seconds=60), None, None, None), ("b", "app", T0, T0 + dt.timedelta(seconds=60), None, False, None)],
        "endpoint_id string, application string, first_request timestamp, last_request timestamp, last_analyzed long, active boolean, is_router boolean")
    assert [r["endpoint_id"] for r in monitoring.select_windows(log, ends, 60).collect()] == ["a"]


def test_windows_prune_the_log(spark, tmp_path):
    """The scan is bounded by time and by the log's partition columns."""
    path = str(tmp_path / "log")
    rows = spark.range(60 * 24).select(
        F.lit("a").alias("key"), F.timestamp_seconds(F.col("id") * 3600 + int(T0.timestamp())).alias("timestamp"), F.col("id").alias("v"))
    rows.withColumns({"year": F.year("timestamp"), "month": F.month("timestamp"), "day": F.day("timestamp"), "endpoint_id": F.col("key")}) \
        .write.partitionBy("key", "year", "month", "day").parquet(path)
    last = T0 + dt.timedelta(days=50)
    ends = spark.createDataFrame([("a", "app", T0, last, int((last - dt.timedelta(days=1)).timestamp()))],
                                 "endpoint_id string, application string, first_request timestamp, last_request timestamp, last_analyzed long")
    got = monitoring.select_windows(spark.read.parquet(path), ends, 3600)
    assert got.count() == 24
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "year" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThan(timestamp" in plan


def test_drift_counts_are_shuffled_not_rows(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(1000).select((F.col("id") % 2).alias("e"), F.rand(1).alias("x"), F.rand(2).alias("y"))
        edges = spark.createDataFrame([(e, c, [0.0, 0.5, 1.0]) for e in (0, 1) for c in ("x", "y")], "e long, column string, edges array<double>")
        got = drift.histogram_per_group(df, ["e"], edges, ["e"])
        assert got.agg(F.sum("n")).first()[0] == 2000 and got.count() == 8
        plan = got._jdf.queryExecution().executedPlan().toString()
        lines = plan.splitlines()
        # The lowest split into features is counted before anything is shuffled.
        split = max(i for i, line in enumerate(lines) if "Generate inline" in line)
        above = next(line for line in reversed(lines[:split]) if "Exchange" in line or "HashAggregate" in line)
        assert "HashAggregate" in above
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
