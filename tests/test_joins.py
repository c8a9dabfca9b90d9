import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.errors import SpecError
from tidemark.operators import joins

T0 = dt.datetime(2021, 1, 1)


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(1)

    def rows(n, wide):
        return [(rng.choice(["hot"] * 4 + ["a", "b", None]), T0 + dt.timedelta(minutes=rng.randrange(wide)),
                 i if rng.random() < 0.8 else None) for i in range(n)]

    left, right = rows(200, 300), rows(150, 300)
    return (left, right, spark.createDataFrame(left, "k string, ts timestamp, l int").cache(),
            spark.createDataFrame(right, "k string, rts timestamp, r int").cache())


@pytest.mark.parametrize("max_rows", [None, 15, 10**6])
def test_asof_brute_force(sides, max_rows):
    left, right, ldf, rdf = sides
    got = joins.asof_join(ldf, rdf, ["k"], "ts", "rts", keep_right_ts="at", max_rows=max_rows).collect()
    assert len(got) == len(left)

    def want(k, ts):
        found = [(rts, r is not None, r or 0, r) for k2, rts, r in right if k is not None and k2 == k and rts <= ts]
        return max(found)[3] if found else None

    key = lambda t: tuple(str(x) for x in t)
    assert sorted([(r["k"], r["ts"], r["l"], r["r"]) for r in got], key=key) == sorted(
        [(k, ts, l, want(k, ts)) for k, ts, l in left], key=key)


def test_asof_equals_rank_plan(sides):
    _, _, ldf, rdf = sides
    a = joins.asof_join(ldf, rdf, ["k"], "ts", "rts")
    b = joins.asof_join_ranked(ldf, rdf, ["k"], "ts", "rts")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_outer_join_and_clashes(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "p"), (3, "q")], "kk int, w string")
    got = {(r["k"], r["v"], r["w"]) for r in joins.equi_join(a, b, ["k"], ["kk"], "outer").collect()}
    assert got == {(1, "x", None), (2, "y", "p"), (3, None, "q")}
    right = {(r["k"], r["v"], r["w"]) for r in joins.equi_join(a, b, ["k"], ["kk"], "right").collect()}
    assert right == {(2, "y", "p"), (3, None, "q")}
    with pytest.raises(SpecError):
        joins.equi_join(a, a, ["k"])


@pytest.mark.parametrize("max_rows", [None, 3])
def test_merge_by_key(spark, max_rows):
    rows = [(1, "a", 10), (2, "b", 20), (3, "a", 11), (4, "a", 12), (5, "a", 13), (6, "a", 14), (7, "c", 5)]
    df = spark.createDataFrame(rows, "seq int, k string, v int")
    got = joins.merge_by_key(df, "k", ["seq"], F.col("v"), 2, max_rows=max_rows).collect()
    assert sorted((r["k"], r["parts"]) for r in got) == [("a", [10, 11]), ("a", [12, 13])]


def test_fixed_window_lookup(spark):
    w = spark.createDataFrame([("a", T0 + dt.timedelta(hours=h), h) for h in (1, 2, 3)], "k string, end timestamp, n int")
    req = spark.createDataFrame([("a", T0 + dt.timedelta(minutes=130)), ("b", T0)], "k string, ts timestamp")
    closed = joins.lookup_fixed_window(req, w, ["k"], "ts", "end", "1h").collect()
    assert {(r["k"], r["n"]) for r in closed} == {("a", 2), ("b", None)}
    now = joins.lookup_fixed_window(req, w, ["k"], "ts", "end", "1h", "current_open").collect()
    assert {(r["k"], r["n"]) for r in now} == {("a", 3), ("b", None)}


@pytest.mark.parametrize("max_rows", [None, 15])
def test_many_sets_in_one_pass_equal_a_chain(sides, max_rows):
    _, _, ldf, rdf = sides
    other = rdf.select(F.col("k").alias("key"), (F.col("rts") + F.expr("INTERVAL 7 MINUTES")).alias("at"), (F.col("r") * 2).alias("o"))
    chain = joins.asof_join(joins.asof_join(ldf, rdf, ["k"], "ts", "rts"), other, ["k"], "ts", "at", ["key"], "seen", None)
    one = joins.asof_join_many(
        ldf, [joins.AsOf(rdf, ("k",), "rts"), joins.AsOf(other, ("key",), "at", "seen")], ["k"], "ts", max_rows)
    assert one.columns == chain.columns
    assert one.exceptAll(chain).count() == 0 and chain.exceptAll(one).count() == 0


def test_map_columns_are_carried(spark):
    rows = [("a", T0, 1, {"x": 1}), ("a", T0 + dt.timedelta(hours=1), 2, {"x": 2}), ("a", T0 + dt.timedelta(hours=1), 1, {"x": 3})]
    right = spark.createDataFrame(rows, "k string, rts timestamp, v int, m map<string,int>")
    left = spark.createDataFrame([("a", T0 + dt.timedelta(hours=2))], "k string, ts timestamp")
    assert joins.asof_join(left, right, ["k"], "ts", "rts").first()["m"] == {"x": 2}
    assert joins.latest_per_key(right, ["k"], "rts").first()["m"] == {"x": 2}
