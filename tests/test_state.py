"""Processors with seeded, list and map state; batches by count or time in both forms."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.errors import SpecError
from tidemark.operators import cuts
from tidemark.session import fresh_path
from tidemark.sources.files import stream_files
from tidemark.streaming import processors, run, stateful


def greedy(rows, n, span):
    """Batch numbers of (time, tie) rows of one key."""
    found, start, number = {}, 0, 0
    rows = sorted(rows)
    for i, (at, tie) in enumerate(rows):
        if i - start == n or at >= rows[start][0] + span:
            start, number = i, number + 1
        found[(at, tie)] = number
    return found


def events(seed, keys=3, most=60):
    rng = random.Random(seed)
    return [
        (k, e, rng.randint(0, 100) * (1 if rng.random() < 0.9 else 50))
        for k in [*range(keys), None]
        for e in range(rng.randint(1, most))
    ]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, e long, s long").select("k", "e", F.timestamp_seconds(F.col("s") + 100_000).alias("t"))


@pytest.mark.parametrize("n,span,chunk,max_rows", [(3, 10, 1000, None), (4, 7, 5, None), (7, 30, 3, 20), (1, 5, 4, 10), (50, 20, 6, 9), (5, 10_000, 2, None)])
def test_batches_by_count_or_time(spark, n, span, chunk, max_rows):
    rows = events(n)
    found = cuts.batch_by_time(frame(spark, rows), ["k"], "t", n, f"{span}s", ["e"], chunk=chunk, max_rows=max_rows)
    have = {(r["k"], r["e"]): r["batch"] for r in found.withColumn("s", F.unix_seconds("t")).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        for (_, e), number in greedy([(s, e) for k, e, s in rows if k == key], n, span).items():
            want[(key, e)] = number
    assert have == want


def test_summaries_hold_what_a_chunk_can_meet():
    times = np.sort(np.random.default_rng(0).integers(0, 1000, 500))
    last, starts = cuts.summarize(times, 8, 20)
    assert len(last) == len(starts) == 8  # a batch of eight ends within the first eight rows of a chunk
    assert (np.diff(last) >= 0).all()


def test_closed_batches_and_bad_arguments(spark):
    df = frame(spark, [(1, i, i) for i in range(7)] + [(2, 0, 0), (2, 1, 100), (None, 5, 3)])
    found = cuts.closed_batches(cuts.batch_by_time(df, ["k"], "t", 3, "1m", ["e"]), ["k"], "t", 3, [F.sum("e").alias("total")])
    rows = {(r["k"], r["batch"]): (r["n"], r["total"], r["closed_by"]) for r in found.collect()}
    assert rows == {
        (1, 0): (3, 3, "count"), (1, 1): (3, 12, "count"), (1, 2): (1, 6, "open"),
        (2, 0): (1, 0, "time"), (2, 1): (1, 1, "open"), (None, 0): (1, 5, "open"),
    }
    assert cuts.batch_by_time(df.where("false"), ["k"], "t", 3, "1m").count() == 0
    for n, timeout in ((0, "1m"), (3, "0s")):
        with pytest.raises(SpecError):
            cuts.batch_by_time(df, ["k"], "t", n, timeout)


def in_runs(spark, parts, build):
    """The table written after each part has arrived, every run going on from the last."""
    base, seen = fresh_path(spark, "runs"), []
    for part in parts:
        part.write.mode("append").parquet(f"{base}/in")
        with processors.state_store(spark):
            out = run.drain(build(stream_files(spark, f"{base}/in", part.schema)), "out", base=f"{base}/run")
        seen.append(sorted(map(tuple, out.collect()), key=repr))
    return seen


def test_state_starts_from_a_table(spark):
    seed = spark.createDataFrame([("a", 11), ("a", 7), ("b", 22), (None, 100), ("z", 1)], "k string, total long")

    def add(_key, rows: pd.DataFrame, state):
        total = state[0] + rows["x"].cumsum()
        return rows[["k", "x"]].assign(total=total), (int(total.iloc[-1]),)

    parts = [
        spark.createDataFrame([("a", 2), ("a", 3), ("b", 4), ("c", 5), (None, 6)], "k string, x long"),
        spark.createDataFrame([("a", 10), ("c", 1)], "k string, x long"),
    ]
    first, second = in_runs(
        spark, parts, lambda s: processors.map_with_table(s, ["k"], add, "k string, x long, total long", "total long", (0,), seed, ["x"])
    )
    want = [("a", 2, 13), ("a", 3, 16), ("b", 4, 26), ("c", 5, 5), (None, 6, 106)]
    assert first == sorted(want, key=repr)
    assert second == sorted([*want, ("a", 10, 26), ("c", 1, 6)], key=repr)
    with pytest.raises(SpecError):
        processors.map_with_table(parts[0], ["k"], add, "k string", "total long, more long", (0, 0), seed)


def test_map_state_counts_values(spark):
    parts = [
        spark.createDataFrame([(1, "x", i) for i in range(3)] + [(1, None, 3), (2, "x", 4)], "k long, v string, e long"),
        spark.createDataFrame([(1, "x", 5), (1, None, 6), (1, "y", 7)], "k long, v string, e long"),
    ]
    *_, last = in_runs(spark, parts, lambda s: processors.count_values(s, ["k"], "v", "n", ["e"]))
    assert {r[2]: r[3] for r in last} == {0: 1, 1: 2, 2: 3, 3: 1, 4: 1, 5: 4, 6: 2, 7: 1}


def test_stream_batches_equal_the_batch_form(spark):
    """Equal on the same rows, but for batches whose deadline the watermark has not reached."""
    rows = [(k, e, s) for k, e, s in events(5, keys=2, most=40)] + [(7, 0, 10_000)]
    whole = frame(spark, rows)
    cutoffs = [60, 2000, 20_000]
    at = F.unix_seconds("t") - 100_000
    parts = [whole.where(at.between(low, high - 1)) for low, high in zip([0, *cutoffs], cutoffs)]
    *_, last = in_runs(spark, parts, lambda s: processors.batch_rows(s, ["k"], 4, "25s", "t", "1s", ["e"]))
    have = {(r[0], r[1]): (r[3], r[4]) for r in last}
    batched = cuts.batch_by_time(whole, ["k"], "t", 4, "25s", ["e"])
    closed = cuts.closed_batches(batched, ["k"], "t", 4, []).select("k", "batch", "closed_by", (F.unix_seconds("first_time") - 100_000).alias("first"))
    reason = {(r["k"], r["batch"]): (r["closed_by"], r["first"]) for r in closed.collect()}
    want = {}
    for r in batched.collect():
        kind, first = reason[(r["k"], r["batch"])]
        if kind != "open" or first + 25 <= 10_000 - 1:
            want[(r["k"], r["e"])] = (r["batch"], "time" if kind == "open" else kind)
    assert have == want and {"count", "time"} == {v[1] for v in want.values()} and len(want) < len(rows)


def test_state_store_setting_comes_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    with processors.state_store(spark):
        assert "RocksDB" in spark.conf.get(name)
    assert spark.conf.get(name) == before


def test_late_rows_per_micro_batch(spark):
    parts = [frame(spark, [(1, 0, 10), (1, 1, 5), (2, 2, 1), (None, 3, 4)]), frame(spark, [(1, 4, 7), (1, 5, 12), (2, 6, 1)])]
    *_, last = in_runs(spark, parts, lambda s: stateful.late_per_batch(s, ["k"], "t"))
    assert sorted(last, key=repr) == sorted([(1, 2, 0), (2, 1, 0), (None, 1, 0), (1, 2, 1), (2, 1, 0)], key=repr)


@pytest.mark.parametrize("order", [["e"], None])
def test_keys_that_share_a_slot_keep_their_own_state(spark, order):
    """Twenty keys in two slots, a null key among them; every run goes on from the last."""
    keys = [*range(19), None]
    seed = spark.createDataFrame([(k, 1000 * (k or 0) + 7) for k in keys if k is None or k % 2] + [(99, 1)], "k long, total long")

    def add(key, rows: pd.DataFrame, state):
        assert rows["k"].dropna().nunique() <= 1 and list(rows.index) == list(range(len(rows)))
        total = state[0] + rows["e"].cumsum()
        return pd.DataFrame({"k": [key[0]] * len(rows), "e": rows["e"], "total": total}), (int(total.iloc[-1]),)

    parts = [spark.createDataFrame([(k, e) for e in es for k in keys], "k long, e long").coalesce(1) for es in ((1, 2, 3), (4,), (5, 6))]
    *_, last = in_runs(
        spark, parts, lambda s: processors.map_with_table(s, ["k"], add, "k long, e long, total long", "total long", (0,), seed, order, slots=2)
    )
    start = {k: 1000 * (k or 0) + 7 if k is None or k % 2 else 0 for k in keys}
    want = [(k, e, start[k] + e * (e + 1) // 2) for k in keys for e in range(1, 7)]
    assert last == sorted(want, key=repr)


def test_counts_of_keys_that_share_a_slot(spark):
    rng = random.Random(3)
    rows = [(rng.choice([*range(15), None]), rng.choice(["x", "y", None]), e) for e in range(300)]
    parts = [spark.createDataFrame(rows[at : at + 100], "k long, v string, e long") for at in (0, 100, 200)]
    *_, last = in_runs(spark, parts, lambda s: processors.count_values(s, ["k"], "v", "n", ["e"], slots=2))
    seen, want = {}, []
    for k, v, e in rows:
        seen[(k, v)] = seen.get((k, v), 0) + 1
        want.append((k, v, e, seen[(k, v)]))
    assert last == sorted(want, key=repr)


def test_counts_of_times(spark):
    """Values that are no text, number or truth value."""
    parts = [spark.createDataFrame([(1, i % 2, i) for i in some], "k long, s long, e long").select("k", F.timestamp_seconds("s").alias("v"), "e") for some in (range(5), range(5, 8))]
    *_, last = in_runs(spark, parts, lambda s: processors.count_values(s, ["k"], "v", "n", ["e"], slots=1))
    assert {r[2]: r[3] for r in last} == {e: e // 2 + 1 for e in range(8)}


def test_a_slots_timer_closes_the_batches_that_are_due(spark):
    """Silent keys of one slot: those past their deadline close, the others stay and close later."""
    first = frame(spark, [(k, k, 10 * k) for k in range(6)])
    parts = [first, frame(spark, [(9, 90, 60)]), frame(spark, [(9, 91, 100)])]
    *seen, last = in_runs(spark, parts, lambda s: processors.batch_rows(s, ["k"], 3, "25s", "t", "1s", ["e"], slots=1))
    closed = [{r[0] for r in run} for run in (*seen, last)]
    assert closed == [{k for k in range(6) if 10 * k + 25 <= top - 1} | ({9} if top == 100 else set()) for top in (50, 60, 100)]
    assert {(r[3], r[4]) for r in last} == {(0, "time")}


def test_late_rows_of_keys_that_share_a_slot(spark):
    rng = random.Random(4)
    rows = [[(rng.choice([*range(12), None]), e, rng.randint(0, 50)) for e in range(80)] for _ in range(3)]
    *_, last = in_runs(spark, [frame(spark, r) for r in rows], lambda s: stateful.late_per_batch(s, ["k"], "t", slots=2))
    newest, want = {}, []
    for part in rows:
        for k in {r[0] for r in part}:
            mine = [s for key, _, s in part if key == k]
            want.append((k, len(mine), sum(s < newest.get(k, -1) for s in mine)))
        for k, _, s in part:
            newest[k] = max(newest.get(k, -1), s)
    assert sorted(last, key=repr) == sorted(want, key=repr)
