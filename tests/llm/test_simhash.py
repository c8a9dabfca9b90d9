import random

import numpy as np
import xxhash

from tidemark.llm import simhash
from tidemark.llm.components import components, forest
from helpers import SCHEMA, awkward, frame, got, row, words


def brute_mark(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = low.encode().split()
    if not found:
        return 0
    k = min(k, len(found))
    hashes = [xxhash.xxh64_intdigest(b" ".join(found[i : i + k]), 42) for i in range(len(found) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(marks, max_bits=2):
    parent = list(range(len(marks)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(marks):
        for j in range(i):
            if (a ^ marks[j]).bit_count() <= max_bits:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(marks))]


def test_whole_operator(spark):
    rng = random.Random(3)
    rows = awkward()
    base = words(rng, 400).split()
    for i in range(200, 230):
        near = list(base)
        near[rng.randrange(len(near))] = "other"
        rows.append(row(i, " ".join(near)))
    out = simhash.near_duplicates(frame(spark, rows)).collect()
    marks = [brute_mark(r[1]) for r in rows]
    parts = brute_components(marks)
    least = {p: min((r[0] for r, q in zip(rows, parts) if q == p and r[0] is not None), default=None) for p in parts}
    want = [(r[0], m, least[p]) for r, m, p in zip(rows, marks, parts)]
    have = [(r["doc_id"], r["fingerprint"] % 2**64, r["component_id"]) for r in out]
    assert sorted(have, key=repr) == sorted(want, key=repr)


def test_every_close_pair_shares_a_block():
    rng = random.Random(0)
    masks = simhash.block_masks(2)
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        assert any((a ^ b) & m == 0 for m in masks)


def test_long_runs_match_short_runs(spark, monkeypatch):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    marks = {centre}
    while len(marks) < 300:
        marks.add(rng.choice(sorted(marks)) ^ (1 << rng.randrange(30)) ^ (1 << rng.randrange(30)))
    marks |= {rng.getrandbits(64) for _ in range(50)}
    signed = [(m - 2**64 if m >> 63 else m,) for m in marks]
    df = spark.createDataFrame(signed, "fingerprint long").repartition(3)

    def parts():
        pairs = components(simhash.links(df)).collect()
        return sorted(map(tuple, pairs))

    short = parts()
    monkeypatch.setattr(simhash, "SHORT_RUN", 4)
    assert parts() == short
    of = dict(short)
    order = [m for (m,) in signed]
    brute = brute_components([m % 2**64 for m in order])
    groups = {}
    for m, p in zip(order, brute):
        groups.setdefault(p, set()).add(m)
    for group in groups.values():
        assert len({of.get(m, m) for m in group}) == 1


def test_forest_and_chain(spark):
    node, low = forest(np.array([5, 3, 9]), np.array([3, 1, 8]))
    assert dict(zip(node.tolist(), low.tolist())) == {3: 1, 5: 1, 9: 8}
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(7, 7), (None, 3)], "a long, b long").repartition(9)
    found = dict(map(tuple, components(chain).collect()))
    assert found == {i: 0 for i in range(301)}
    assert components(chain.limit(0)).count() == 0


def test_empty(spark):
    assert simhash.near_duplicates(frame(spark, [], SCHEMA)).count() == 0
    assert got(simhash.near_duplicates(frame(spark, [row(None, None), row(None, "")])), "component_id") == [(None,), (None,)]
