import random
import re
from collections import defaultdict

import pytest

from tidemark.llm import mix
from helpers import frame, got, row, awkward, SCHEMA, words


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, full = sum(sizes.values()), {}, set()
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in order if s not in full)
        target = {s: cap * sizes[s] if s in full else left * weight[s] / open_weight for s in order}
        above = {s for s in order if s not in full and target[s] > cap * sizes[s]}
        if not above:
            return target
        full |= above


def size(text):
    return len([w for w in re.split(r"[\x20\x09-\x0d]+", text or "") if w])


def test_targets_and_cut(spark):
    rows = awkward()
    taken = mix.mix(frame(spark, rows)).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
    want = brute_targets(sizes)
    per = defaultdict(int)
    assert len(taken) == len(rows)
    for r in taken:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        per[r["source"]] += r["taken"]
    for source, words_taken in per.items():
        # Two equal rows may share the cut.
        assert abs(words_taken - want[source]) <= 2


def test_reruns_and_partitions_agree(spark):
    df = frame(spark, awkward())
    first = got(mix.mix(df), "doc_id", "size", "taken")
    assert got(mix.mix(df.repartition(7)), "doc_id", "size", "taken") == first


def test_many_rows_over_several_ranges(spark):
    rng = random.Random(1)
    rows = [row(i, words(rng, rng.randint(0, 9)), source="hot" if i % 3 else f"s{i % 7}") for i in range(15_000)]
    taken = mix.mix(frame(spark, rows)).groupBy("source", "target").sum("taken").collect()
    assert all(abs(r["target"] - r["sum(taken)"]) <= 0.5 for r in taken)


def test_mixed_follows_the_plan(spark):
    df = frame(spark, awkward())
    out = mix.mixed(df)
    assert out.columns == df.columns
    plan = defaultdict(int)
    for r in mix.mix(df).collect():
        plan[r["doc_id"]] += r["taken"]
    have = defaultdict(int)
    for r in out.collect():
        have[r["doc_id"]] += size(r["text"])
        if r["text"] is not None:
            assert r["n_chars"] == len(r["text"])
        assert r["copies"] in (9, None)
    assert {k: v for k, v in have.items() if v} == {k: v for k, v in plan.items() if v}


@pytest.mark.parametrize("rows", [[], [row(1, None)], [row(1, ""), row(2, " ")]])
def test_nothing_to_take(spark, rows):
    assert [r["taken"] for r in mix.mix(frame(spark, rows, SCHEMA)).collect()] == [0] * len(rows)
    assert all(not size(r["text"]) for r in mix.mixed(frame(spark, rows, SCHEMA)).collect())
