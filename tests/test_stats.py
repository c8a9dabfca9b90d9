import random
import statistics

import numpy as np
import pytest

from tidemark.errors import SpecError
from tidemark.operators import increments, stats


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(3)
    rows = [(rng.gauss(0, 1), rng.choice([1, 1, 1, 2, 50]), None if i % 9 == 0 else float(i), rng.choice("abb"))
            for i in range(1500)]
    rows[5] = (float("nan"), *rows[5][1:])
    return rows, spark.createDataFrame(rows, "x double, t int, g double, s string").cache()


@pytest.mark.parametrize("limit", [10, 10**6])
def test_exact_quantiles(frame, limit):
    rows, df = frame
    exprs = {n: stats.as_number(df, n) for n in ("x", "t", "g")}
    probabilities = [0.01, 0.25, 0.5, 0.75, 0.999]
    got = stats.exact_quantiles(df, exprs, probabilities, limit=limit)
    for i, n in enumerate(exprs):
        values = [r[i] for r in rows if r[i] is not None and r[i] == r[i]]
        assert got[n] == pytest.approx(list(np.quantile(values, probabilities)), rel=1e-9)


def test_quantiles_from_samples_stay_exact(frame, monkeypatch):
    rows, df = frame
    monkeypatch.setattr(stats, "_SAMPLE", 60)
    monkeypatch.setattr(stats, "_ACCURACY", 20)
    got = stats.exact_quantiles(df, {"x": stats.as_number(df, "x")}, [0.1, 0.5, 0.93], limit=40)
    values = [r[0] for r in rows if r[0] == r[0]]
    assert got["x"] == pytest.approx(list(np.quantile(values, [0.1, 0.5, 0.93])), rel=1e-9)


def test_describe(frame):
    rows, df = frame
    got = {r["column"]: r for r in stats.describe_numeric(df, ["x", "t"]).collect()}
    t = [r[1] for r in rows]
    assert got["t"]["count"] == 1500 and got["t"]["mean"] == pytest.approx(statistics.mean(t))
    assert got["t"]["std"] == pytest.approx(statistics.stdev(t)) and got["x"]["count"] == 1499
    top = stats.describe_categorical(df, ["s", "t"]).collect()
    assert {r["column"]: r["top"] for r in top} == {"s": "b", "t": "1"}


def test_histogram_matches_numpy(frame):
    rows, df = frame
    hist = stats.histogram(df, ["x", "t", "g"])
    for i, n in ((0, "x"), (1, "t"), (2, "g")):
        values = [r[i] for r in rows if r[i] is not None and r[i] == r[i]]
        counts, edges = np.histogram(values, bins=20)
        got = sorted((r["bin"], r["n"], r["lo"], r["hi"]) for r in hist.collect() if r["column"] == n)
        assert [g[1] for g in got] == list(counts)
        assert [g[2] for g in got] == pytest.approx(list(edges[:-1]))


def test_padded_edges(frame, spark):
    rows, df = frame
    edges = {"x": [-stats.MAX_FLOAT, -1.0, 0.0, 1.0, stats.MAX_FLOAT], "t": [0.0, 1.5, 10.0]}
    hist = {(r["column"], r["bin"]): r["n"] for r in stats.histogram_on_edges(df, edges).collect()}
    x = [r[0] for r in rows if r[0] == r[0]]
    assert hist["x", 0] == sum(v < -1 for v in x)
    assert hist["x", 1] == sum(-1 <= v < 0 for v in x)
    assert hist["x", 2] == sum(0 <= v <= 1 for v in x)
    assert hist["x", 3] == sum(v > 1 for v in x)
    assert hist["t", 0] == sum(r[1] == 1 for r in rows) and hist["t", 1] == sum(r[1] == 2 for r in rows)
    padded = stats.pad_histogram(stats.histogram(df, ["t"], 4))
    assert [r["n"] for r in padded.orderBy("bin").collect()][0] == 0 and padded.count() == 6
    assert stats.pad_histogram(padded).count() == 6


def test_constant_and_empty_column(spark):
    df = spark.createDataFrame([(2.0, None), (2.0, None)], "c double, e double")
    hist = stats.histogram(df, ["c", "e"]).collect()
    assert sum(r["n"] for r in hist) == 2 and min(r["lo"] for r in hist) == 1.5
    got = {r["column"]: r for r in stats.describe_numeric(df).collect()}
    assert got["e"]["count"] == 0 and got["c"]["p50"] == 2.0


def test_ties_end_the_search(spark, monkeypatch):
    """A heavy tie next to the wanted rank, and a column of few values."""
    jobs = []
    plain = stats._narrow
    monkeypatch.setattr(stats, "_narrow", lambda *a: jobs.append(1) or plain(*a))
    df = spark.range(50_000).selectExpr("CAST(CASE WHEN id % 2 = 0 THEN 0.5 ELSE id / 50000.0 END AS double) AS x", "CAST(id % 50 AS double) AS few")
    probabilities = [0.25, 0.5, 0.74, 0.76]
    exprs = {n: stats.as_number(df, n) for n in ("x", "few")}
    got = stats.exact_quantiles(df, exprs, probabilities, limit=500)
    assert len(jobs) <= 3
    pdf = df.toPandas()
    for n in exprs:
        assert got[n] == pytest.approx(list(np.quantile(pdf[n], probabilities)), rel=1e-9)
    jobs.clear()
    stats.exact_quantiles(df, {"few": exprs["few"]}, probabilities, limit=500)
    assert not jobs


def test_hash_sample_is_stable(spark):
    df = spark.range(10_000)
    first = {r[0] for r in stats.sample_by_hash(df, ["id"], 0.2, "a").collect()}
    assert first == {r[0] for r in stats.sample_by_hash(df.repartition(7), ["id"], 0.2, "a").collect()}
    assert 1800 < len(first) < 2200 and stats.sample_by_hash(df, ["id"], 0.0).count() == 0


def test_merged_increments_equal_one_pass(spark):
    rng = random.Random(8)
    rows = [(1e9 + rng.gauss(0, 1), rng.choice([None, float("nan"), 2.0, 5.0]), rng.random() < 0.3, i % 3) for i in range(4000)]
    df = spark.createDataFrame(rows, "x double, y double, b boolean, part int")
    columns = ["x", "y", "b"]
    parts = [increments.summarize(df.where(f"part = {k}"), columns) for k in range(3)] + [increments.summarize(df.limit(0), columns)]
    left = increments.merge(parts[0].unionByName(parts[3]))
    both = increments.merge(left.unionByName(parts[1]).unionByName(parts[2]))
    got = {r["column"]: r for r in increments.describe(both).collect()}
    want = {r["column"]: r for r in increments.describe(increments.summarize(df, columns)).collect()}
    for c in columns:
        for part in ("rows", "count", "min", "max"):
            assert got[c][part] == want[c][part]
        assert got[c]["distinct"] == pytest.approx(want[c]["distinct"], rel=increments.DISTINCT_ERROR)
        assert got[c]["mean"] == pytest.approx(want[c]["mean"], rel=1e-12)
        assert got[c]["std"] == pytest.approx(want[c]["std"], rel=1e-6)
    xs = sorted(r[0] for r in rows)
    assert got["x"]["std"] == pytest.approx(statistics.stdev(xs), rel=1e-6)
    for name, p in increments.QUANTILES.items():
        at = sum(x <= got["x"][name] for x in xs) / len(xs)
        assert abs(at - p) <= increments.RANK_ERROR + 1 / len(xs)
    assert abs(got["x"]["distinct"] - len(set(xs))) <= increments.DISTINCT_ERROR * len(xs)
    empty = increments.describe(increments.merge(parts[3])).collect()
    assert all(r["count"] == 0 and r["mean"] is None and r["p50"] is None and r["distinct"] == 0 for r in empty)
    with pytest.raises(SpecError):
        increments.summarize(df, ["none"])


def test_random_sample_agrees_with_its_rerun(spark):
    df = spark.range(20_000).repartition(4, "id")
    picked = [sorted(r[0] for r in stats.sample_rows(df, 0.1, seed).collect()) for seed in (42, 42, 43)]
    assert picked[0] == picked[1] != picked[2]
    assert len(set(picked[0])) == len(picked[0]) and abs(len(picked[0]) - 2000) < 250
    assert stats.sample_rows(df, 0.0).count() == 0 and stats.sample_rows(df, 1.0).count() == 20_000
