import datetime as dt

import pytest

from tidemark.errors import SpecError
from tidemark.plans.ingest import Target, check_targets, ingest, ingest_increment, preview_ingest, read_latest
from tidemark.plans.vector import offline_features
from tidemark.session import fresh_path
from tidemark.specs import FeatureSet, FeatureVector, JoinGraph

T0 = dt.datetime(2021, 1, 1)


@pytest.fixture(scope="module")
def company(spark):
    employees = spark.createDataFrame(
        [(100, "employee100", 1), (200, "employee200", 2), (300, "employee300", 3), (400, "employee400", 9)],
        "id int, name string, department_id int")
    departments = spark.createDataFrame(
        [(i, f"dept{i}", i * 10) for i in (1, 2, 3, 4)], "d_id int, name string, manager_id int")
    managers = spark.createDataFrame([(10, "manager10"), (20, "manager20")], "m_id int, name string")
    return {
        "employees": FeatureSet("employees", ("id",), relations={"department_id": "d_id"}, df=employees),
        "departments": FeatureSet("departments", ("d_id",), relations={"manager_id": "m_id"}, df=departments),
        "managers": FeatureSet("managers", ("m_id",), df=managers),
    }


def test_relations_chain(company):
    vector = FeatureVector(("employees.name", "departments.name as dept", "managers.name as boss"))
    got = offline_features(vector, company)
    assert got.columns == ["name", "dept", "boss"]
    assert sorted(map(tuple, got.collect())) == [
        ("employee100", "dept1", "manager10"), ("employee200", "dept2", "manager20")]


def test_order_of_sets_is_found(company):
    vector = FeatureVector(("managers.name as boss", "departments.name as dept", "employees.name"))
    assert offline_features(vector, company).count() == 2


@pytest.mark.parametrize("how,rows", [("inner", 3), ("left", 4), ("right", 4), ("outer", 5)])
def test_join_graph(company, how, rows):
    graph = getattr(JoinGraph("employees"), how)("departments")
    vector = FeatureVector(("employees.name", "departments.name"), join_graph=graph)
    got = offline_features(vector, company, order_by="name")
    assert got.columns == ["name", "name_departments"] and got.count() == rows


def test_indexes_filters_label(company):
    vector = FeatureVector(("employees.*",), label="departments.manager_id", with_indexes=True)
    got = offline_features(vector, company, query="manager_id >= 20", order_by=["manager_id"])
    assert "id" in got.columns and [r["manager_id"] for r in got.collect()] == [20, 30]
    with pytest.raises(SpecError):
        offline_features(vector, company, order_by="nope")
    with pytest.raises(SpecError):
        offline_features(vector, company, start=T0)
    with pytest.raises(SpecError):
        offline_features(FeatureVector(("managers.name", "employees.name")), company)


def test_asof_and_entity_rows(spark):
    left = spark.createDataFrame([("a", T0 + dt.timedelta(hours=2), 1), ("b", T0, 2)], "ent string, ts timestamp, f1 int")
    right = spark.createDataFrame(
        [("a", T0 + dt.timedelta(hours=h), h) for h in (0, 1, 3)], "ent string, other timestamp, f2 int")
    sets = {"l": FeatureSet("l", ("ent",), "ts", df=left), "r": FeatureSet("r", ("ent",), "other", df=right)}
    vector = FeatureVector(("l.f1", "r.f2"))
    assert sorted(map(tuple, offline_features(vector, sets).collect()), key=str) == [(1, 1), (2, None)]
    rows = spark.createDataFrame([("a", T0 + dt.timedelta(hours=5)), ("a", T0)], "ent string, at timestamp")
    got = offline_features(vector, sets, entity_rows=rows, entity_timestamp="at", with_indexes=True)
    assert sorted((r["at"].hour, r["f1"], r["f2"]) for r in got.collect()) == [(0, None, 0), (5, 1, 3)]


def test_ingest_modes(spark):
    fs = FeatureSet("m", ("name",), "time")
    df = spark.createDataFrame([(T0, "a", 1), (T0 + dt.timedelta(hours=1), "a", 2)], "time timestamp, name string, data int")
    base = fresh_path(spark, "test-ingest")
    targets = [Target("p", "parquet", f"{base}/p", unit="day"), Target("o", "latest", f"{base}/o")]
    first = ingest(fs, df, targets, with_stats=True)
    assert spark.read.parquet(first.paths["p"]).count() == 2
    assert [tuple(r)[2] for r in read_latest(spark, first.paths["o"]).select("time", "name", "data").collect()] == [2]
    more = df.unionByName(spark.createDataFrame([(T0 + dt.timedelta(hours=2), "b", 3)], df.schema))
    second = ingest_increment(fs, more, targets, first, T0.replace(tzinfo=dt.timezone.utc) + dt.timedelta(days=1))
    assert second.run_id == first.run_id and spark.read.parquet(first.paths["p"]).count() == 3
    assert read_latest(spark, first.paths["o"]).count() == 2
    third = ingest_increment(fs, more, targets, second, T0.replace(tzinfo=dt.timezone.utc) + dt.timedelta(days=2))
    assert third.skipped and third.last_written == second.last_written
    with pytest.raises(SpecError):
        check_targets([targets[0], targets[0]])


def test_a_callers_column_is_never_taken_for_a_feature(spark):
    orders = spark.createDataFrame([(1, 10.0)], "c int, price double")
    sets = {"orders": FeatureSet("orders", ("c",), df=orders)}
    rows = spark.createDataFrame([(1, -1.0)], "c int, price_orders double")
    got = offline_features(FeatureVector(("orders.price",)), sets, rows).first()
    assert (got["price_orders"], got["price"]) == (-1.0, 10.0)
    with pytest.raises(SpecError):
        offline_features(FeatureVector(("orders.price",)), sets, rows.withColumnRenamed("price_orders", "price"))


def test_overwrite_removes_the_former_run(spark):
    base = fresh_path(spark, "purge")
    fs = FeatureSet("t", ("k",), "ts")
    df = spark.createDataFrame([(1, T0)], "k int, ts timestamp")
    targets = [Target("p", "parquet", f"{base}/p"), Target("l", "latest", f"{base}/l"), Target("s", "series", f"{base}/s")]
    first = ingest(fs, df, targets)
    second = ingest(fs, df, targets, first)
    import os

    assert all(os.listdir(f"{base}/{n}") == [second.run_id] for n in "pls")
    status = second
    for day in (2, 3, 4):
        more = spark.createDataFrame([(day, T0 + dt.timedelta(days=day))], "k int, ts timestamp")
        status = ingest_increment(fs, more, targets, status, T0 + dt.timedelta(days=10))
    assert read_latest(spark, status.paths["l"]).count() == 4
    assert len([f for f in os.listdir(status.paths["l"]) if f.startswith("v=")]) == 2
    assert spark.read.parquet(status.paths["s"]).count() == 4


def test_preview_writes_nothing_and_is_bounded(spark):
    df = spark.range(5000).selectExpr("id AS k", "timestamp_seconds(id) AS ts", "id * 2 AS v")
    fs = FeatureSet("t", ("k",), "ts", steps=(lambda d: d.withColumn("w", d.v + 1),))
    rows, status = preview_ingest(fs, df, rows=100)
    assert rows.count() == 100 and status.stats is None and [c["name"] for c in status.schema] == ["k", "ts", "v", "w"]
    rows, status = preview_ingest(fs, df, rows=100, with_stats=True)
    assert rows.count() == 5000 and {r["column"]: r["count"] for r in status.stats.collect()}["w"] == 5000
    assert 400 < preview_ingest(fs, df, sample=0.1)[0].count() < 600


def test_search_pairs_are_spread(spark):
    import numpy as np

    from tidemark.operators.vectors import top_k

    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4 + i % 2).tolist()) for i in range(60)]
    vectors = spark.createDataFrame(rows, "vec_id int, v array<double>")
    asked = vectors.where("vec_id % 3 = 0").toDF("qid", "q")
    found = top_k(vectors, asked, "vec_id", "v", "qid", "q", 4)
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert "tile_group" in text and "Cross" not in text
    got = {}
    for r in found.orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["vec_id"])
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    for i in range(0, 60, 3):
        near = sorted((j for j in unit if len(unit[j]) == len(unit[i])), key=lambda j: (-float(unit[i] @ unit[j]), j))
        assert got[i] == near[:4]
