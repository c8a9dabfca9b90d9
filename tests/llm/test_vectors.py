import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hash_forest, vector_dedup
from tidemark.llm.prefix import numbered

SCHEMA = "vec_id long, embedding array<float>, label int, cid long, tile long, code string, low long"


def rows_of(vectors, first=0):
    return [(first + i, v, None, 1, 2, "c", 3) for i, v in enumerate(vectors)]


def clustered(n, dims=64, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 8, dims))
    picks = centres[rng.integers(len(centres), size=n)] + rng.normal(0, 0.25, (n, dims))
    loose = rng.standard_normal((n // 2, dims))
    return np.concatenate([picks, loose, picks[:5] * 3]).astype("float32")


AWKWARD = [
    None, [0.0] * 64, [float("nan")] * 64, [None] + [1.0] * 63, [float("inf")] + [1.0] * 63, [1e-30] * 64, [1e30] * 64, [], [1.0, 0.0], [2.0, 0.0],
]


def brute(rows, threshold=0.9):
    ok = {
        i: np.asarray(v, "float64") / np.abs(np.asarray(v, "float64")).max()
        for i, v in enumerate(r[1] for r in rows)
        if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) and rows[i][0] is not None
    }
    links = {i: set() for i in range(len(rows))}
    for i in ok:
        for j in ok:
            if i != j and len(ok[i]) == len(ok[j]):
                a, b = ok[i], ok[j]
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                    links[i].add(j)
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((r[0], len(links[i]), least, r[0] is not None and r[0] == least))
    return sorted(out, key=repr)


@pytest.mark.parametrize("tile", [16384, 40])
def test_near_duplicates(spark, monkeypatch, tile):
    monkeypatch.setattr(vector_dedup, "TILE_ROWS", tile)
    vectors = [list(map(float, v)) for v in clustered(240)]
    rows = rows_of(vectors + vectors[:3]) + rows_of(AWKWARD, 1000) + [(None, vectors[0], 1, 1, 1, "", 1), (5, vectors[5], 1, 1, 1, "", 1)]
    found = vector_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    have = sorted(map(tuple, found.select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)
    assert have == brute(rows)


def test_hot_cell_is_sliced(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "TILE_ROWS", 25)
    monkeypatch.setattr(vector_dedup, "MAX_CELLS", 2)
    rng = np.random.default_rng(2)
    near = rng.standard_normal(32) + rng.normal(0, 0.1, (150, 32))
    rows = rows_of([list(map(float, v)) for v in near])
    found = vector_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert sorted(map(tuple, found.collect()), key=repr) == brute([(r[0], [float(np.float32(x)) for x in r[1]]) for r in rows])


def test_sql_agrees(spark):
    vectors = clustered(80)
    pdf = spark.createDataFrame(rows_of([list(map(float, v)) for v in vectors]), SCHEMA)
    con = duckdb.connect()
    con.register("raw", pdf.select("vec_id", "embedding").toPandas())
    con.execute("CREATE VIEW embeddings AS SELECT * FROM raw")
    assert sorted(con.execute(vector_dedup.SQL).fetchall()) == sorted(map(tuple, vector_dedup.near_duplicates(pdf).collect()))


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert vector_dedup.near_duplicates(none).count() == 0
    assert hash_forest.search(none, F.col("vec_id") % 20 == 0).count() == 0


def exact(rows, k, query):
    good = {}
    for r in rows:
        v = r[1]
        if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) and r[0] is not None:
            good[r[0]] = np.asarray(v, "float32").astype("float64")
    out = {}
    for q, a in good.items():
        if query(q):
            scored = [(-float(np.dot(a, b)), i) for i, b in good.items() if i != q and len(a) == len(b)]
            out[q] = [i for _, i in sorted(scored)[:k]]
    return out


def test_search_is_exact_on_small_tables(spark):
    vectors = [list(map(float, v)) for v in clustered(200)]
    rows = rows_of(vectors) + rows_of(AWKWARD[:5] + AWKWARD[7:], 1000) + [(None, vectors[0], 1, 1, 1, "", 1), (7, vectors[7], 0, 0, 0, "", 0)]
    found = hash_forest.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, k=6).collect()
    have = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        have.setdefault(r["query_id"], []).append(r["vec_id"])
    want = {q: ids for q, ids in exact(rows, 6, lambda q: q % 20 == 0).items() if ids}
    assert have == want


def test_ties_go_to_the_smaller_id(spark):
    rows = rows_of([[1.0, 0.0]] * 30 + [[0.5, 0.5]])
    found = hash_forest.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0, k=4).orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == [1, 2, 3, 4] and [r["rank"] for r in found] == [1, 2, 3, 4]


def test_recall_when_trees_prune(spark, monkeypatch):
    monkeypatch.setattr(hash_forest, "BLOCK_ROWS", 128)
    monkeypatch.setattr(hash_forest, "BLOCK_QUERIES", 8)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((60, 64))
    vectors = centres[rng.integers(60, size=3000)] + rng.normal(0, 0.6, (3000, 64))
    rows = rows_of([list(map(float, v)) for v in vectors])
    found = hash_forest.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, k=20, min_candidates=600)
    have = {(r["query_id"], r["vec_id"]) for r in found.collect()}
    want = {(q, i) for q, ids in exact(rows, 20, lambda q: q % 20 == 0).items() for i in ids}
    assert len(have) == len(want) and len(have & want) / len(want) >= 0.9


def answers(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


def test_many_copies_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(hash_forest, "BLOCK_ROWS", 128)
    vectors = clustered(160)
    # Copies under ids in no order, and near copies that 8 bits do not tell apart.
    ids = np.random.default_rng(5).permutation(6000)
    rows = [(int(i), list(map(float, vectors[0])), None, 1, 2, "c", 3) for i in ids[:4000]]
    close = (vectors[1] + np.random.default_rng(6).normal(0, 1e-5, (300, 64))).astype("float32")
    rows += [(int(i), list(map(float, v)), None, 1, 2, "c", 3) for i, v in zip(ids[4000:], [*close, *vectors[2:]])]
    asks = {int(i) for i in [*ids[:5], *ids[4000:4010], *ids[4290:4320], ids[:4000].min()]}
    found = hash_forest.search(spark.createDataFrame(rows, SCHEMA).repartition(6), F.col("vec_id").isin(asks), k=20)
    assert answers(found) == exact(rows, 20, lambda q: q in asks)


@pytest.mark.parametrize("n", [4000, 30_000])
def test_goal_grows_with_the_table(n):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((n, 64)) + rng.standard_normal((10, 64))[rng.integers(10, size=n)] * 0.5
    symbols, k, picks = hash_forest.symbols_for(n, 40), 20, rng.choice(n, 80, replace=False)
    scores = (u := x / np.linalg.norm(x, axis=1, keepdims=True))[picks] @ u.T
    scores[np.arange(80), picks] = -9
    true = np.argpartition(-scores, k, axis=1)[:, :k]
    sums, depth = np.zeros((80, symbols + 1)), np.zeros((80, n), "int64")
    sums[:, 0] = n
    for codes in hash_forest._codes(x, 40, symbols, 11):
        same = np.stack([np.cumprod(codes == codes[q], axis=1).sum(axis=1) for q in picks])
        sums[:, 1:] += [[(row >= level).sum() for level in range(1, symbols + 1)] for row in same]
        depth = np.maximum(depth, same)
    met = np.take_along_axis(depth, true, 1)
    # The goal of half of the queries holds for the other half.
    goal = hash_forest.goal_for(sums[:40], np.repeat(np.arange(40), k), met[:40].ravel(), 0.96, 100)
    level = hash_forest.levels_for(sums[40:], goal)
    assert (met[40:] >= level[:, None]).mean() >= 0.93
    assert goal > 0.1 * n and (met[40:] >= hash_forest.levels_for(sums[40:], 5120 * n / 1e6)[:, None]).mean() < 0.9
    # Steps are fine: a level holds no less than a third of the one above it.
    mean = sums.mean(axis=0)
    assert (mean[1:4] > mean[:3] / 3).all()


def test_one_id_with_several_vectors(spark):
    """Every row is a candidate; a query is not answered with its own id."""
    rows = [(1, [0.9, 0.1]), (1, [0.0, 1.0]), (20, [1.0, 0.0]), (20, [0.0, 2.0]), (2, [0.5, 0.5]), (3, [0.9, 0.1]), (1, [0.9, 0.1])]
    df = spark.createDataFrame([(i, v, 0, 0, 0, "", 0) for i, v in rows], SCHEMA)
    found = hash_forest.search(df, F.col("vec_id") == 20, k=3).collect()
    have = sorted((r["rank"], r["vec_id"], round(r["score"], 6)) for r in found)
    want = [(1, 1, 0.9), (2, 3, 0.9), (3, 2, 0.5)] + [(1, 1, 2.0), (2, 2, 1.0), (3, 1, 0.2)]
    assert have == sorted(want)


def broadcasts(df):
    """What the plan sends to the driver to broadcast it: the columns of each such side."""
    todo, sides = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        plan = todo.pop()
        if plan.nodeName() == "AdaptiveSparkPlan":
            plan = plan.initialPlan()
        if plan.nodeName() == "BroadcastExchange":
            sides.append({f.name() for f in plan.schema().fields()})
        below = plan.children()
        todo += [below.apply(i) for i in range(below.size())]
    return sides


def test_what_grows_with_the_table_is_not_broadcast(spark, monkeypatch):
    """Files of codes and vectors are small, their rows are not: the driver's memory ended at 200,000 rows."""
    seen = {}
    real = hash_forest.cut

    def watched(df, purpose):
        seen[purpose] = broadcasts(df)
        return real(df, purpose)

    monkeypatch.setattr(hash_forest, "cut", watched)
    rows = rows_of([list(map(float, v)) for v in clustered(80)])
    seen["result"] = broadcasts(hash_forest.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, k=4))
    assert {"forest-ranges", "forest-probes", "forest-asks", "result"} <= set(seen)
    columns = set().union(*(side for sides in seen.values() for side in sides))
    assert not columns & {"code", "prefix", "packed", "embedding", "__q", "list", "ids"}


def test_levels_of_neighbours_are_found_by_tasks():
    rng = np.random.default_rng(3)
    asked = {7: rng.standard_normal(8).tolist(), 9: rng.standard_normal(5).tolist()}
    pairs = [(q, (np.asarray(asked[q]) + rng.normal(0, s, len(asked[q]))).tolist()) for s in (0.0, 0.05, 0.5, 3.0) for q in asked]
    pdf = pd.DataFrame(pairs, columns=["query_id", "embedding"])
    found = pd.concat(hash_forest._met(asked, 4, 6, 11)(iter([pdf])))
    want = [int(hash_forest._depths(np.asarray([asked[q]]), np.asarray([v]), 4, 6, 11)[0]) for q, v in pairs]
    assert sorted(zip(found["query_id"], found["depth"])) == sorted(zip(pdf["query_id"], want))
    assert max(want) == 6 and min(want) < 6


def test_numbers_of_rows_dealt_by_their_first_column(spark, monkeypatch):
    ids = np.random.default_rng(9).integers(0, 12, 300)
    rows = [(int(i), [float(n % 7), float(n)]) for n, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    dealt = []
    real = type(df).repartitionByRange
    monkeypatch.setattr(type(df), "repartitionByRange", lambda self, *by: dealt.append(by) or real(self, *by))
    found = numbered(df, ["vec_id", "embedding"], "no", leading=1).orderBy("no").collect()
    assert dealt == [("vec_id",)]
    assert [r["no"] for r in found] == list(range(300)) and [(r["vec_id"], r["embedding"]) for r in found] == sorted(rows)


@pytest.mark.parametrize("at_once", [3, 256])
def test_tasks_return_what_reaches_a_known_score(monkeypatch, at_once):
    """Every task used to return the best of its own rows, however far from the best of all."""
    monkeypatch.setattr(hash_forest, "SCORED_QUERIES", at_once)
    rng, k = np.random.default_rng(12), 5
    vectors = rng.standard_normal((310, 64))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    sides = {kind: next(hash_forest._strings(1, 3, 11, kind)(iter([pd.DataFrame({"vec_id": range(310), "embedding": list(vectors)})]))) for kind in ("int8", "float32")}

    def task(rows, least, **how):
        index, asks = sides["int8"].iloc[rows], sides["float32"].iloc[:10]
        both = [index.assign(kind=0, id=index["vec_id"], low=index["vec_id"], high=index["vec_id"], least=-np.inf)]
        both.append(asks.assign(kind=1, id=asks["vec_id"], low=0, high=310, least=least))
        return pd.concat(hash_forest._scan(k, **how)(iter([pd.concat(both).assign(block=0, slice=0)])), ignore_index=True)

    halves = slice(0, 155), slice(155, 310)
    scores = vectors[:10] @ vectors.T
    scores[np.arange(10), np.arange(10)] = -np.inf
    best = {(q, int(c)) for q in range(10) for c in np.argsort(-scores[q])[:k]}
    pairs = [pd.concat([task(half, least) for half in halves]) for least in (-np.inf, np.sort(scores, axis=1)[:, -k] - 0.01)]
    free, bound = ({(int(q), int(c)) for q, c in zip(f["query_id"], f["vec_id"])} for f in pairs)
    assert best <= bound < free and len(free) >= 2 * k * 10 and len(bound) < 1.6 * k * 10
    for f in pairs:
        true = scores[f["query_id"], f["vec_id"]]
        assert (f["low"] <= true).all() and (true <= f["high"]).all()
    lows = pd.concat([task(half, -np.inf, lows=True) for half in halves])
    assert (lows.groupby("query_id").size() == 2 * k).all()
    known = lows.groupby("query_id")["low"].nlargest(k).groupby(level=0).min()
    assert (known.to_numpy() <= np.sort(scores, axis=1)[:, -k]).all() and best <= {(int(q), int(c)) for q, c in zip(lows["query_id"], lows["vec_id"])} | bound
