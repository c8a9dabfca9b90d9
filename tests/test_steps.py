import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.errors import SpecError
from tidemark.functions import keys, names, time
from tidemark.operators import filters, steps, validate
from tidemark.specs import FeatureSet


@pytest.fixture(scope="module")
def people(spark):
    rows = [("dina", 10, 3.5, "IT"), ("amit", 20, float("nan"), "RD"), ("ella", 30, None, "RD"), (None, None, 1.0, "Mark et")]
    return spark.createDataFrame(rows, "name string, age int, score double, department string")


def col(df, name):
    return [r[name] for r in df.collect()]


def test_map_values(people):
    mapped = steps.map_values(people, {"age": {"ranges": {"child": [0, 20], "adult": [20, "inf"]}}, "department": {"IT": "x"}}, True)
    assert col(mapped, "age_mapped") == ["child", "adult", "adult", None]
    assert col(mapped, "department_mapped") == ["x", "RD", "RD", "Mark et"]
    inplace = steps.map_values(people, {"age": {"ranges": {"child": [0, 20]}}})
    assert inplace.columns == ["age"] and col(inplace, "age") == ["child", "20", "30", None]
    typed = steps.map_values(people, {"age": {10: "a", 20: "b", 30: "c"}})
    assert col(typed, "age") == ["a", "b", "c", None]
    with pytest.raises(Exception, match="no mapping"):
        steps.map_values(people, {"age": {10: "a"}}).collect()


def test_impute_one_hot_drop(people, spark):
    filled = steps.impute(people, {"score": 0.5}, default=-1)
    assert col(filled, "score") == [3.5, 0.5, 0.5, 1.0] and col(filled, "age")[-1] == -1
    stats = spark.createDataFrame([("score", 2.25, 1.0)], "column string, mean double, min double")
    assert col(steps.impute_with_stats(people, {"score": "$mean", "*": 0}, stats, ["score", "age"]), "score") == [3.5, 2.25, 2.25, 1.0]
    hot = steps.one_hot(people, {"department": ["IT", "RD", "Mark et"]})
    assert hot.columns == ["name", "age", "score", "department_IT", "department_RD", "department_Mark_et"]
    assert col(hot, "department_RD") == [0, 1, 1, 0]
    with pytest.raises(SpecError):
        steps.one_hot(people, {"department": ["a b", "a-b"]})
    fs = FeatureSet("p", ("name",), label_column="score")
    with pytest.raises(SpecError):
        steps.drop_features(people, ["name"], fs)
    assert "age" not in steps.drop_features(people, ["age"], fs).columns


def test_validators(people):
    checks = {
        "age": validate.MinMax("int8", low=15, high=25),
        "score": validate.MinMax(high=3),
        "name": validate.MinMaxLen(low=4, high=4),
        "department": validate.Regex(pattern="[A-Z]{2}"),
    }
    got = {r["feature"]: r["violations"] for r in validate.report(people, checks).collect()}
    assert got == {"age": 3, "score": 2, "name": 1, "department": 1}
    assert col(validate.flag(people, checks), "violated")[1] == []


def test_type_validator(spark):
    df = spark.createDataFrame([("12",), ("300",), ("x",), (None,)], "v string")
    for kind, bad in (("int8", 2), ("int", 1), ("float", 1), ("uint128", 1), ("str", 0)):
        assert validate.report(df, {"v": validate.Validator(kind)}).first()["violations"] == bad


def test_filters(people):
    def ages(items):
        return col(filters.additional_filters(people, items), "age")

    assert ages([("age", ">=", 20), ("department", "=", "RD")]) == [20, 30]
    assert ages([("age", "in", [10, None])]) == [10, None]
    assert ages([("score", "in", [None])]) == [20, 30]
    assert ages([("score", "not in", [3.5, None])]) == [None]
    assert ages([("age", "not in", [10])]) == [20, 30]
    with pytest.raises(SpecError):
        ages([("age", "like", 1)])


def test_time_exprs(spark):
    now = dt.datetime(2024, 5, 6, 7, 8, 9, tzinfo=dt.timezone.utc)
    assert time.parse_time_expr("now", now) == now
    assert time.parse_time_expr("now -1d2h", now) == dt.datetime(2024, 5, 5, 5, 8, 9, tzinfo=dt.timezone.utc)
    assert time.parse_time_expr("now -1d floor 1H", now) == dt.datetime(2024, 5, 5, 7, tzinfo=dt.timezone.utc)
    with pytest.raises(SpecError):
        time.duration_seconds("5w")
    df = spark.createDataFrame([("2020-01-01T00:00:01",), ("2020-01-01 00:00:01.5",), ("2020-01-01 00:00:01+00:00",), ("bad",)], "t string")
    got = col(df.select(time.parse_mixed_ts("t").alias("t")), "t")
    assert [g and g.microsecond for g in got] == [0, 500000, 0, None]


def test_date_parts_match_pandas(spark):
    days = pd.date_range("2019-12-29 01:02:03", periods=420, freq="1D")
    df = spark.createDataFrame([(d.to_pydatetime(),) for d in days], "ts timestamp")
    parts = ["day_of_week", "dayofyear", "days_in_month", "is_leap_year", "is_month_start", "is_month_end",
             "is_quarter_start", "is_quarter_end", "is_year_start", "is_year_end", "quarter", "year", "month", "day", "hour", "minute", "second"]
    got = time.with_date_parts(df, "ts", [*parts, "weekofyear", "asm8", "tz"]).collect()
    for r, d in zip(got, days):
        assert [r[f"ts_{p}"] for p in parts] == [getattr(d, p) for p in parts]
        assert r["ts_weekofyear"] == d.isocalendar().week
    with pytest.raises(SpecError):
        time.with_date_parts(df, "ts", ["freqstr"])


def test_names_and_keys(spark):
    df = spark.createDataFrame([("a", 1, 2)], ["city of (birth)", "x", "y"])
    assert names.normalize_columns(df).columns == ["city_of_birth", "x", "y"]
    with pytest.raises(SpecError):
        names.normalize_columns(spark.createDataFrame([(1, 2)], ["a b", "a_b"]))
    assert names.parse_feature("prj/my.set.f as g") == ("prj", "my.set", "f", "g")
    assert names.metric_name("9-a") == "_9_a"
    got = df.select(keys.static_store_key(["x"]).alias("a"), keys.static_store_key(["x", "y"]).alias("b"),
                    keys.static_store_key(["x", "y", "x"]).alias("c")).first()
    import hashlib
    assert (got["a"], got["b"], got["c"]) == ("1}:static", "1.2}:static", "1." + hashlib.sha1(b"21").hexdigest() + "}:static")


def test_split_errors_and_choice(spark):
    df = spark.createDataFrame([("1",), ("x",)], "v string")
    good, bad = steps.split_errors(df, {"n": F.expr("try_cast(v as int)")})
    assert good.collect()[0]["n"] == 1 and bad.collect()[0]["error"] == "n"
    assert col(steps.choice(df, {"one": F.col("v") == "1"}, "rest"), "branch") == ["one", "rest"]
