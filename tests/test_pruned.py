"""Pruned similarity search against the search that reads everything."""

import numpy as np
import pytest

from tidemark.errors import SpecError
from tidemark.operators import pruned
from tidemark.operators.vectors import top_k

VECTORS = "vec_id long, v array<double>"
QUERIES = "qid long, q array<double>"


def table(df):
    return sorted((r["qid"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in df.collect())


def both(spark, vectors, queries, k, **sizes):
    v, q = spark.createDataFrame(vectors, VECTORS).repartition(4), spark.createDataFrame(queries, QUERIES)
    names = ("vec_id", "v", "qid", "q", k)
    return table(pruned.pruned_top_k(v, q, *names, **sizes)), table(top_k(v, q, *names))


def clustered(rng, n, groups, dims=8):
    centres = rng.normal(size=(groups, dims))
    return [(i, (centres[i % groups] + 0.02 * rng.normal(size=dims)).tolist()) for i in range(n)]


@pytest.mark.parametrize("k,pivots,rows", [(1, 1, 1), (3, 20, 7), (5, 64, 50), (40, 8, 16)])
def test_equals_the_whole_search(spark, k, pivots, rows):
    rng = np.random.default_rng(k)
    vectors = clustered(rng, 300, 12) + [(1000 + i, rng.normal(size=8).tolist()) for i in range(60)]
    queries = [(i, v) for i, v in vectors[::17]] + [(5000 + i, rng.normal(size=8).tolist()) for i in range(9)]
    got, want = both(spark, vectors, queries, k, pivots=pivots, tile_rows=rows)
    assert got == want and len(got) == k * len(queries)


def test_ties_copies_nulls_zeros_lengths(spark):
    copies = [(i, [1.0, 2.0]) for i in range(200)]
    others = [(300, [0.0, 0.0]), (301, None), (302, [2.0, 4.0]), (303, [1.0, 0.0, 0.0]), (304, [-1.0, 1.0]), (305, [-1.0, -2.0])]
    queries = [(1, [3.0, 6.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0, 1.0]), (5, [1.0]), (6, [-1.0, -2.0])]
    got, want = both(spark, copies + others, queries, 4, pivots=3, tile_rows=16)
    assert got == want
    assert [r[2] for r in got if r[0] == 1] == [0, 1, 2, 3] and [r[2] for r in got if r[0] == 4] == [303]


def test_nothing(spark):
    assert both(spark, [], [(1, [1.0])], 2) == ([], [])
    assert both(spark, [(1, [1.0])], [], 2) == ([], [])
    with pytest.raises(SpecError):
        both(spark, [(1, [1.0])], [(1, [1.0])], 0)


def test_far_tiles_are_not_visited(spark):
    rng = np.random.default_rng(3)
    vectors = spark.createDataFrame(clustered(rng, 2000, 40, 16), VECTORS)
    held = pruned.tiles(vectors, "vec_id", "v", 200, 32)
    found = pruned._queries(vectors.where("vec_id % 50 = 0").selectExpr("vec_id as qid", "v as q"), "qid", "q")
    visited = pruned.visits(found, held, 3, vectors.schema["vec_id"].dataType)
    every = held.count() * found.count()
    assert held.agg({"n": "sum"}).first()[0] == 2000
    assert visited.count() == visited.distinct().count() < every / 8


def test_a_hot_cell_is_cut_into_tiles(spark):
    vectors = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(500)] + [(900, [0.0, 1.0])], VECTORS)
    held = pruned.tiles(vectors, "vec_id", "v", 4, 64)
    assert max(r["n"] for r in held.select("n").collect()) <= 64 and held.count() >= 9
