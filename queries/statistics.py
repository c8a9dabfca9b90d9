"""Statistics, histograms, schema and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import increments, stats
from tidemark.session import cut

from .base import money, query, table

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_shipdate"]


def _stats_sql(table_name: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{n}' AS column, count(x) AS count, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, min(x) AS min,
      round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.75), 6) AS p75, max(x) AS max
    FROM (SELECT ({e})::DOUBLE AS x FROM {table_name})"""
        for n, e in columns.items()
    )


def _rounded(df):
    digits = {"mean": 4, "std": 4, "p25": 6, "p50": 6, "p75": 6}
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query(
    "stats_numeric",
    _stats_sql("lineitem", {n: n for n in NUMERIC[:-1]} | {"l_shipdate": "epoch_us(l_shipdate) / 1e6"}),
)
def stats_numeric(spark, sf_dir):
    return _rounded(stats.describe_numeric(table(spark, sf_dir, "lineitem"), NUMERIC))


@query(
    "stats_categorical",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column, sum(n)::BIGINT AS count, count(*) AS unique, arg_min(v, (-n, v)) AS top, max(n) AS freq
    FROM (SELECT {c}::VARCHAR AS v, count(*) AS n FROM lineitem WHERE {c} IS NOT NULL GROUP BY 1)"""
        for c in ("l_returnflag", "l_linestatus", "l_suppkey")
    ),
)
def stats_categorical(spark, sf_dir):
    return stats.describe_categorical(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_suppkey"])


HIST_SQL = """SELECT '{c}' AS column, bin, round(lo, 6) AS lo, round(hi, 6) AS hi, count(x) AS n FROM
    (SELECT b AS bin, mn + (mx - mn) * b / {k} AS lo, CASE WHEN b = {k} - 1 THEN mx ELSE mn + (mx - mn) * (b + 1) / {k} END AS hi, b = {k} - 1 AS final
     FROM (SELECT min({c})::DOUBLE AS mn, max({c})::DOUBLE AS mx FROM {t}), (SELECT unnest(range({k}))::INT AS b))
    LEFT JOIN (SELECT {c}::DOUBLE AS x FROM {t}) ON x >= lo AND (x < hi OR (final AND x <= hi)) GROUP BY ALL"""


@query(
    "stats_histogram",
    " UNION ALL ".join("(" + HIST_SQL.format(c=c, t=t, k=20) + ")" for c, t in
                       (("l_quantity", "lineitem"), ("l_extendedprice", "lineitem"), ("l_tax", "lineitem"))),
)
def stats_histogram(spark, sf_dir):
    hist = stats.histogram(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])
    return hist.withColumns({"lo": money("lo", 6), "hi": money("hi", 6)})


@query(
    "stats_hist_on_edges",
    """WITH e AS (SELECT min(value) AS mn, max(value) AS mx FROM events WHERE ts < TIMESTAMP '2024-01-16'),
      b AS (SELECT unnest(range(20))::INT AS bin),
      k AS (SELECT bin, mn + (mx - mn) * bin / 20 AS lo, CASE WHEN bin = 19 THEN mx ELSE mn + (mx - mn) * (bin + 1) / 20 END AS hi FROM e, b)
    SELECT event_type, 'value' AS column, bin, count(value) AS n FROM
      (SELECT DISTINCT event_type FROM events WHERE ts >= TIMESTAMP '2024-01-16') CROSS JOIN k
      LEFT JOIN (SELECT event_type AS et, value FROM events WHERE ts >= TIMESTAMP '2024-01-16')
        ON et = event_type AND value >= lo AND (value < hi OR (bin = 19 AND value <= hi))
    GROUP BY event_type, bin""",
)
def stats_hist_on_edges(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    cut = F.lit("2024-01-16").cast("timestamp")
    edges = stats.collect_edges(stats.value_edges(events.where(F.col("ts") < cut), ["value"]))
    return stats.histogram_on_edges(events.where(F.col("ts") >= cut), edges, ["event_type"]).drop("lo", "hi")


@query(
    "hist_pad",
    "SELECT \"column\", bin + 1 AS bin, n FROM (" + HIST_SQL.format(c="c_acctbal", t="customer", k=5)
    + ") UNION ALL SELECT 'c_acctbal', 0, 0 UNION ALL SELECT 'c_acctbal', 6, 0",
)
def hist_pad(spark, sf_dir):
    hist = stats.histogram(table(spark, sf_dir, "customer"), ["c_acctbal"], bins=5)
    return stats.pad_histogram(hist).drop("lo", "hi")


@query(
    "schema_infer",
    " UNION ALL ".join(
        f"SELECT '{n}' AS name, '{r}' AS role, '{v}' AS value_type, count({n}) AS non_null FROM orders"
        for n, r, v in (
            ("o_orderkey", "entity", "int"), ("o_custkey", "feature", "int"), ("o_orderstatus", "feature", "str"),
            ("o_totalprice", "feature", "float"), ("o_orderdate", "timestamp", "datetime"), ("o_orderpriority", "feature", "str"),
        )
    ),
)
def schema_infer(spark, sf_dir):
    return stats.schema_table(table(spark, sf_dir, "orders"), ["o_orderkey"], "o_orderdate")


@query(
    "vector_stats",
    _stats_sql("customer", {"balance": "c_acctbal"}) + " UNION ALL " + _stats_sql("orders", {"o_totalprice": "o_totalprice"}),
)
def vector_stats(spark, sf_dir):
    tables = {
        "customer": stats.describe_numeric(table(spark, sf_dir, "customer"), ["c_acctbal", "c_nationkey"]),
        "orders": stats.describe_numeric(table(spark, sf_dir, "orders"), ["o_totalprice"]),
    }
    fields = {"customer": [("c_acctbal", "balance")], "orders": [("o_totalprice", "o_totalprice")]}
    return _rounded(stats.vector_stats(tables, fields))


@query(
    "dataset_profile",
    "SELECT p.column, p.count, p.mean, p.max, (SELECT count(*) FROM part) AS length FROM ("
    + _stats_sql("part", {n: n for n in ("p_size", "p_retailprice", "p_partkey")}) + ") p",
)
def dataset_profile(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    found = stats.profile(part)
    return _rounded(found["stats"]).select("column", "count", "mean", "max", F.lit(found["length"]).cast("long").alias("length"))


@query(
    "stats_increments",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column, count(*) AS rows, count({c}) AS count, round(avg({c}::DOUBLE), 4) AS mean, round(stddev_samp({c}::DOUBLE), 4) AS std,
      min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, true AS quantiles_in_bound, true AS distinct_in_bound FROM lineitem"""
        for c in ("l_quantity", "l_extendedprice", "l_suppkey")
    ),
)
def stats_increments(spark, sf_dir):
    """Statistics of three increments, stored and merged, held against the whole table."""
    rows = table(spark, sf_dir, "lineitem")
    columns = ["l_quantity", "l_extendedprice", "l_suppkey"]
    stored = [
        cut(increments.summarize(rows.where(part), columns), "increment")
        for part in (F.col("l_returnflag") == "A", F.col("l_returnflag") == "N", ~F.col("l_returnflag").isin("A", "N"))
    ]
    merged = increments.merge(stored[0].unionByName(stored[1]))
    found = cut(increments.describe(increments.merge(merged.unionByName(stored[2]))), "described")
    # Exact numbers of rows up to, and below, each estimate.
    estimates = {r["column"]: r for r in found.collect()}
    exact = [
        F.struct(
            F.lit(c).alias("column"), F.count_distinct(c).alias("exact"),
            *[F.count_if(F.col(c) < estimates[c][p]).alias(f"below_{p}") for p in increments.QUANTILES],
            *[F.count_if(F.col(c) <= estimates[c][p]).alias(f"upto_{p}") for p in increments.QUANTILES],
        )
        for c in columns
    ]
    counted = rows.agg(F.array(*exact).alias("x")).select(F.inline("x"))
    slack = increments.RANK_ERROR
    inside = F.lit(True)
    for name, p in increments.QUANTILES.items():
        inside &= (F.col(f"below_{name}") / F.col("count") <= p + slack) & (F.col(f"upto_{name}") / F.col("count") >= p - slack)
    near = F.abs(F.col("distinct") - F.col("exact")) <= increments.DISTINCT_ERROR * F.col("exact") + 1
    return found.join(counted, "column").select(
        "column", "rows", "count", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "min", "max",
        inside.alias("quantiles_in_bound"), near.alias("distinct_in_bound"),
    )
