import datetime as dt
import random
import statistics as st

import pytest
from pyspark.sql import functions as F

from tidemark.errors import SpecError
from tidemark.operators import ordered
from tidemark.operators.windows import aggregate_every_event, aggregate_windows
from tidemark.specs import Aggregation

T0 = dt.datetime(2020, 7, 21, 21, 40)


def minutes(n):
    return T0 + dt.timedelta(minutes=n)


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(7)
    rows = [
        (i, "hot" if rng.random() < 0.6 else f"k{rng.randrange(4)}",
         minutes(rng.randrange(0, 600) + rng.random()), round(1e6 + rng.random() * 10, 3))
        for i in range(400)
    ]
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp, v double").cache()
    return rows, df


# Input rows and expected results of the two golden tests.
def test_sliding_golden(spark):
    rows = [
        (T0, "moshe", "cohen", 2000, "bad"),
        (minutes(1), "yosi", "levi", 10, "good"),
        (minutes(2), "yosi", "levi", 11, "bad"),
        (minutes(3), "moshe", "cohen", 12, "good"),
        (minutes(4), "yosi", "levi", 16, "good"),
    ]
    df = spark.createDataFrame(
        rows, "time timestamp, first_name string, last_name string, bid int, mood string"
    )
    agg = Aggregation("bid", ("sum", "max", "sqr", "stdvar"), "1h", "10m")
    out = aggregate_windows(df, ["first_name", "last_name"], "time", [agg])
    got = out.orderBy("first_name", "time").collect()
    assert len(got) == 12
    assert [r["time"] for r in got[:6]] == [minutes(10 * i) for i in range(1, 7)]
    for r in got:
        expected = (
            (12, 2000, 4000144, 1976072.0, 2012) if r["first_name"] == "moshe"
            else (16, 16, 477, pytest.approx(10.333333333), 37)
        )
        assert (r["bid"], r["bid_max_1h"], r["bid_sqr_1h"], r["bid_stdvar_1h"], r["bid_sum_1h"]) == expected
        assert r["mood"] == "good" and r["time_window"] == "1h"


def test_every_event_golden(spark):
    rows = [
        (T0, "Moshe", "Cohen", 2000), (minutes(20), "Yossi", "Levi", 10),
        (minutes(60), "Moshe", "Cohen", 12), (minutes(79), "Yossi", "Levi", 16),
        (minutes(81), "Yossi", "Levi", 8),
    ]
    df = spark.createDataFrame(rows, "time timestamp, first_name string, last_name string, bid int")
    agg = Aggregation("bid", ("sum", "max", "count", "sqr", "stdvar"), "2h", "10m")
    got = aggregate_every_event(df, ["first_name", "last_name"], "time", [agg]).orderBy("time").collect()
    assert [r["bid_sum_2h"] for r in got] == [2000, 10, 2012, 26, 34]
    assert [r["bid_max_2h"] for r in got] == [2000, 10, 2000, 16, 16]
    assert [r["bid_count_2h"] for r in got] == [1, 1, 2, 2, 3]
    assert [r["bid_sqr_2h"] for r in got] == [4000000, 100, 4000144, 356, 420]
    assert [r["bid_stdvar_2h"] for r in got] == [None, None, 1976072.0, 18.0, pytest.approx(52 / 3)]


def _brute(rows, window, period):
    out = {}
    for i, k, ts, v in rows:
        e = (ts - dt.datetime(1970, 1, 1)).total_seconds()
        start = e // period * period + period - window
        vs = sorted(
            (t2, i2, v2) for i2, k2, t2, v2 in rows
            if k2 == k and start <= (t2 - dt.datetime(1970, 1, 1)).total_seconds() and t2 <= ts
        )
        x = [v2 for _, _, v2 in vs]
        out[i] = (len(x), sum(x), min(x), max(x), x[0], x[-1], st.variance(x) if len(x) > 1 else None)
    return out


@pytest.mark.parametrize("max_rows", [None, 20, 1_000_000])
def test_every_event_brute_force(events, max_rows):
    rows, df = events
    ops = ("count", "sum", "min", "max", "first", "last", "stdvar")
    aggs = [Aggregation("v", ops, ("1h", "2h"), "10m"), Aggregation("v", ops, "1d", name="day")]
    got = aggregate_every_event(df, ["k"], "ts", aggs, max_rows=max_rows).collect()
    assert len(got) == len(rows)
    for prefix, label, window, period in (
        ("v", "1h", 3600, 600), ("v", "2h", 7200, 600), ("day", "1d", 86400, 86400),
    ):
        want = _brute(rows, window, period)
        for r in got:
            have = [r[f"{prefix}_{op}_{label}"] for op in ops]
            assert have[0] == want[r["id"]][0]
            for a, b in zip(have[1:], want[r["id"]][1:]):
                assert a is None and b is None or a == pytest.approx(b, rel=1e-7, abs=1e-9)


def test_multi_window_rows_have_own_aggregates(events):
    rows, df = events
    agg = Aggregation("v", ("count", "avg", "stddev"), ("1h", "1d"))
    out = aggregate_windows(df, ["k"], "ts", [agg], carry_last=False).collect()
    for label, other in (("1h", "1d"), ("1d", "1h")):
        part = [r for r in out if r["ts_window"] == label]
        assert sum(r[f"v_count_{label}"] for r in part) == len(rows)
        assert all(r[f"v_count_{other}"] is None for r in part)


@pytest.mark.parametrize("max_rows", [None, 10, 1_000_000])
def test_running_brute_force(events, max_rows):
    rows, df = events
    got = ordered.running(
        df, ["k"], ["ts", "id"],
        {"c": ("count", F.col("v")), "s": ("sum", F.col("v")), "m": ("max", F.col("v")),
         "f": ("first", F.col("id")), "l": ("last", F.when(F.col("id") % 3 == 0, F.col("id")))},
        max_rows=max_rows,
    ).collect()
    assert len(got) == len(rows)
    by_key = {}
    for i, k, ts, v in sorted(rows, key=lambda r: (r[2], r[0])):
        by_key.setdefault(k, []).append((i, v))
    for r in got:
        seq = by_key[r["k"]]
        at = [i for i, _ in seq].index(r["id"])
        seen = seq[: at + 1]
        threes = [i for i, _ in seen if i % 3 == 0]
        assert r["c"] == at + 1 and r["m"] == max(v for _, v in seen)
        assert r["s"] == pytest.approx(sum(v for _, v in seen))
        assert r["f"] == seq[0][0] and r["l"] == (threes[-1] if threes else None)


@pytest.mark.parametrize("max_rows", [None, 10])
def test_sample_batches_and_order_flags(events, max_rows):
    rows, df = events
    sampled = ordered.sample_every(df, ["k"], ["ts", "id"], 10, max_rows).count()
    sizes = {}
    for _, k, _, _ in rows:
        sizes[k] = sizes.get(k, 0) + 1
    assert sampled == sum(-(-n // 10) for n in sizes.values())
    batches = ordered.batch_of(df, ["k"], ["ts", "id"], 7, max_rows=max_rows)
    assert max(r["count"] for r in batches.groupBy("k", "batch").count().collect()) == 7
    flags = {r["id"]: r["out_of_order"] for r in ordered.flag_out_of_order(df, ["k"], ["id"], "ts", max_rows=max_rows).collect()}
    newest = {}
    for i, k, ts, _ in rows:
        assert flags[i] == (k in newest and ts < newest[k])
        newest[k] = max(ts, newest.get(k, ts))


def test_global_running_order(events):
    rows, df = events
    got = ordered.running(df, [], ["v", "id"], {"c": ("count", F.lit(1))}, max_rows=25).collect()
    assert sorted(r["c"] for r in got) == list(range(1, len(rows) + 1))


def test_period_must_divide_window():
    with pytest.raises(SpecError):
        Aggregation("v", "sum", "1h", "7m")


def test_results_do_not_depend_on_partitions(spark, events):
    _, df = events
    agg = Aggregation("v", ("count", "max", "last"), "2h", "10m")
    found = []
    for partitions in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        out = aggregate_every_event(df.repartition(partitions), ["k"], "ts", [agg], max_rows=30)
        found.append(sorted(map(tuple, out.collect())))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert found[0] == found[1]


@pytest.mark.parametrize("times", ["burst", "equal"])
def test_hot_keys_are_cut_by_rows(spark, times):
    # 2,000 rows within 20 ms (or at one time) and one a year later.
    rows = [(i, "hot", i % 20 / 1000 if times == "burst" else 0.0) for i in range(2000)]
    rows += [(2000, "hot", 365 * 86400.0), *[(3000 + i, f"k{i % 5}", float(i)) for i in range(50)]]
    df = spark.createDataFrame(rows, "id long, k string, t double").withColumn("ts", F.timestamp_seconds("t"))
    placed, hot = ordered.with_slice(df, ["k"], ["ts", "id"], 200)
    sizes = {(r["k"], r["__slice"]): r["count"] for r in placed.groupBy("k", "__slice").count().collect()}
    assert sum(sizes.values()) == len(rows) and hot.count() == 2001
    assert max(sizes.values()) <= 200
    assert all((part == -1) == (k != "hot") for k, part in sizes)
    got = ordered.running(df, ["k"], ["ts", "id"], {"n": ("count", F.lit(1)), "f": ("first", F.col("id"))}, max_rows=200)
    want = ordered.running(df, ["k"], ["ts", "id"], {"n": ("count", F.lit(1)), "f": ("first", F.col("id"))}, max_rows=None)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_windows_of_far_steps_share_no_fine_merge(events):
    rows, df = events
    agg = [Aggregation("v", ("count", "sum", "max", "last", "stddev"), "1m"), Aggregation("v", ("count", "sum", "max", "last", "stddev"), ("12h", "1d"), "6h")]
    out = aggregate_windows(df, ["k"], "ts", agg).collect()
    for label, seconds, step in (("1m", 60, 60), ("12h", 43200, 21600), ("1d", 86400, 21600)):
        want = {}
        for i, k, ts, v in rows:
            at = int(ts.replace(tzinfo=dt.timezone.utc).timestamp())
            first = at // step * step + step
            for end in range(first, first + seconds - step + 1, step):
                want.setdefault((k, end), []).append((ts, i, v))
        part = {(r["k"], int(r["ts"].replace(tzinfo=dt.timezone.utc).timestamp())): r for r in out if r["ts_window"] == label}
        assert part.keys() == want.keys()
        for key, values in want.items():
            row = part[key]
            assert row[f"v_count_{label}"] == len([v for *_, v in values if v is not None])
            assert row[f"v_sum_{label}"] == pytest.approx(sum(v for *_, v in values if v is not None))
            assert row[f"v_max_{label}"] == max(v for *_, v in values)
