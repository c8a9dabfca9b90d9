"""Joins, lookups, retrieval, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import joins, runs, stats, steps
from tidemark.operators.ordered import running
from tidemark.operators.windows import aggregate_windows
from tidemark.plans.vector import offline_features
from tidemark.session import fresh_path
from tidemark.sinks.files import write_parquet
from tidemark.sources.files import read_parquet
from tidemark.specs import Aggregation, FeatureSet, FeatureVector, JoinGraph

from .base import end_sql, money, query, table

W30 = end_sql("o_orderdate", 30 * 86400)


@query(
    "training_set",
    f"""WITH w AS (SELECT o_custkey, {W30} AS wend, sum(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY 1, 2)
    SELECT o.o_orderkey, o.o_custkey, o.o_orderdate, c.c_mktsegment, c.c_acctbal, round(w.s, 2) AS spent, w.n AS orders_30d
    FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
    ASOF LEFT JOIN w ON w.o_custkey = o.o_custkey AND o.o_orderdate >= w.wend
    WHERE c.c_acctbal > 0""",
)
def training_set(spark, sf_dir):
    """Windows per customer, joined point-in-time to every order, written and read back."""
    orders = table(spark, sf_dir, "orders")
    spend = aggregate_windows(
        orders.select("o_custkey", "o_orderdate", "o_totalprice"), ["o_custkey"], "o_orderdate",
        [Aggregation("o_totalprice", ("sum", "count"), "30d")], carry_last=False,
    )
    customer = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    sets = {
        "customer": FeatureSet("customer", ("o_custkey",), df=customer),
        "spend": FeatureSet("spend", ("o_custkey",), "o_orderdate", df=spend),
    }
    vector = FeatureVector(
        ("customer.c_mktsegment", "customer.c_acctbal", "spend.o_totalprice_sum_30d as spent",
         "spend.o_totalprice_count_30d as orders_30d"),
        with_indexes=True,
    )
    rows = orders.select("o_orderkey", "o_custkey", "o_orderdate")
    result = offline_features(vector, sets, rows, "o_orderdate", query="c_acctbal > 0")
    path = fresh_path(spark, "training")
    write_parquet(result.withColumn("spent", money("spent")), path, ts="o_orderdate", unit="year")
    return read_parquet(spark, path, columns=result.columns)


@query(
    "join_equi",
    """SELECT k, left_n, right_n, how FROM (
      SELECT coalesce(a.k, b.k) AS k, left_n, right_n, 'outer' AS how FROM a FULL JOIN b ON a.k = b.k
      UNION ALL SELECT a.k, left_n, right_n, 'inner' FROM a JOIN b ON a.k = b.k
      UNION ALL SELECT a.k, left_n, right_n, 'left' FROM a LEFT JOIN b ON a.k = b.k
      UNION ALL SELECT b.k, left_n, right_n, 'right' FROM a RIGHT JOIN b ON a.k = b.k)""".replace(
        "SELECT k, left_n",
        """WITH a AS (SELECT o_custkey AS k, count(*) AS left_n FROM orders GROUP BY 1),
      b AS (SELECT c_custkey AS k, c_nationkey AS right_n FROM customer WHERE c_acctbal > 3000)
    SELECT k, left_n""", 1),
)
def join_equi(spark, sf_dir):
    left = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(
        F.count(F.lit(1)).alias("left_n")
    )
    right = table(spark, sf_dir, "customer").where("c_acctbal > 3000").select(
        F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("right_n")
    )
    out = None
    for how in ("inner", "left", "right", "outer"):
        part = joins.equi_join(left, right, ["k"], ["key"], how).withColumn("how", F.lit(how))
        out = part if out is None else out.unionByName(part)
    return out


ASOF_SQL = """SELECT l.event_id, l.user_id, l.ts, r.event_id AS purchase_id, r.value AS purchase_value, r.ts AS purchase_ts
    FROM (SELECT * FROM events WHERE event_type IN ('error', 'view')) l
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') r ON r.user_id = l.user_id AND l.ts >= r.ts"""


def _asof_sides(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    left = events.where(F.col("event_type").isin("error", "view")).select("event_id", "user_id", "ts")
    right = events.where("event_type = 'purchase'").select(
        F.col("user_id").alias("buyer"), F.col("ts").alias("bought"),
        F.col("event_id").alias("purchase_id"), F.col("value").alias("purchase_value"),
    )
    return left, right


@query("join_asof", ASOF_SQL)
def join_asof(spark, sf_dir):
    left, right = _asof_sides(spark, sf_dir)
    return joins.asof_join(
        left, right, ["user_id"], "ts", "bought", ["buyer"], keep_right_ts="purchase_ts"
    )


@query("join_asof_diff_ts", ASOF_SQL.replace("r.ts AS purchase_ts", "date_trunc('second', r.ts) AS purchase_ts")
       .replace("(SELECT * FROM events WHERE event_type = 'purchase')", "(SELECT event_id, user_id, value, date_trunc('second', ts) AS ts FROM events WHERE event_type = 'purchase')"))
def join_asof_diff_ts(spark, sf_dir):
    """The right side keeps its time as zone-less seconds under another name."""
    left, right = _asof_sides(spark, sf_dir)
    coarse = right.withColumn("bought", F.date_trunc("second", "bought").cast("timestamp_ntz"))
    return joins.asof_join(
        left, coarse, ["user_id"], "ts", "bought", ["buyer"], keep_right_ts="purchase_ts"
    )


@query(
    "join_default_rule",
    """WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), u AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
    SELECT e.value AS view_value, p.value AS last_purchase, u.n FROM (SELECT * FROM events WHERE event_type = 'view') e
    ASOF LEFT JOIN p ON p.user_id = e.user_id AND e.ts >= p.ts JOIN u ON u.user_id = e.user_id""",
)
def join_default_rule(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    views = events.where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("view_value"))
    buys = events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought"), F.col("value").alias("last_purchase"))
    users = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    sets = {
        "views": FeatureSet("views", ("user_id",), "ts", df=views),
        "buys": FeatureSet("buys", ("user_id",), "bought", df=buys),
        "users": FeatureSet("users", ("user_id",), df=users),
    }
    return offline_features(FeatureVector(("views.view_value", "buys.last_purchase", "users.n")), sets)


def _tpch(spark, sf_dir):
    return {
        "orders": FeatureSet("orders", ("o_orderkey",), relations={"o_custkey": "c_custkey"}, df=table(spark, sf_dir, "orders")),
        "customer": FeatureSet("customer", ("c_custkey",), relations={"c_nationkey": "n_nationkey"}, df=table(spark, sf_dir, "customer")),
        "nation": FeatureSet("nation", ("n_nationkey",), relations={"n_regionkey": "r_regionkey"}, df=table(spark, sf_dir, "nation")),
        "region": FeatureSet("region", ("r_regionkey",), df=table(spark, sf_dir, "region")),
    }


@query(
    "join_graph",
    """SELECT c_custkey, c_name, n_name, o.o_custkey AS buyer, total FROM customer
    JOIN nation ON n_nationkey = c_nationkey
    FULL JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) o
      ON o.o_custkey = c_custkey""".replace("o.o_custkey AS buyer, ", "").replace("c_custkey, c_name", "coalesce(c_custkey, o.o_custkey) AS c_custkey, c_name"),
)
def join_graph(spark, sf_dir):
    sets = _tpch(spark, sf_dir)
    totals = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("total")
    )
    sets["totals"] = FeatureSet("totals", ("c_custkey",), df=totals)
    graph = JoinGraph("customer").inner("nation").outer("totals")
    vector = FeatureVector(("customer.c_name", "nation.n_name", "totals.total"), join_graph=graph, with_indexes=True)
    return offline_features(vector, sets, drop_columns=["c_nationkey"])


CHAIN_SQL = """SELECT r_name, n_name, c_name, o_orderkey, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey
    JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"""


@query("join_auto_order", CHAIN_SQL)
def join_auto_order(spark, sf_dir):
    """Sets named from the far end: the chain orders -> customer -> nation -> region is found."""
    vector = FeatureVector(
        ("region.r_name", "nation.n_name", "customer.c_name", "orders.o_totalprice"), with_indexes=True
    )
    out = offline_features(vector, _tpch(spark, sf_dir))
    return out.select("r_name", "n_name", "c_name", "o_orderkey", "o_totalprice")


@query("join_relations", "SELECT n_name, c_mktsegment, c_acctbal FROM customer JOIN nation ON n_nationkey = c_nationkey")
def join_relations(spark, sf_dir):
    sets = {
        "customer": FeatureSet("customer", ("c_custkey",), df=table(spark, sf_dir, "customer")),
        "nation": FeatureSet("nation", ("n_nationkey",), df=table(spark, sf_dir, "nation")),
    }
    vector = FeatureVector(
        ("customer.c_mktsegment", "customer.c_acctbal", "nation.n_name"),
        relations={"customer": {"c_nationkey": "n_nationkey"}},
    )
    return offline_features(vector, sets)


@query(
    "join_entity_rows",
    """SELECT e.event_id, e.user_id, e.ts, a.value AS last_click, u.first_type FROM
      (SELECT event_id, user_id, ts FROM events) e
    ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'click') a ON a.user_id = e.user_id AND e.ts >= a.ts
    JOIN (SELECT user_id, arg_min(event_type, ts) AS first_type FROM events GROUP BY 1) u ON u.user_id = e.user_id""",
)
def join_entity_rows(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    rows = events.select("event_id", "user_id", "ts")
    clicks = events.where("event_type = 'click'").select("user_id", F.col("ts").alias("at"), F.col("value").alias("last_click"))
    firsts = events.groupBy("user_id").agg(F.min_by("event_type", "ts").alias("first_type"))
    sets = {
        "clicks": FeatureSet("clicks", ("user_id",), "at", df=clicks),
        "firsts": FeatureSet("firsts", ("user_id",), df=firsts),
    }
    vector = FeatureVector(("clicks.last_click", "firsts.first_type"), with_indexes=True)
    return offline_features(vector, sets, rows, "ts")


@query(
    "join_with_table",
    "SELECT l_orderkey, l_linenumber, s_name, n_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey",
)
def join_with_table(spark, sf_dir):
    suppliers = joins.equi_join(
        table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"),
        table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), ["s_nationkey"], ["n_nationkey"],
    )
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return joins.equi_join(lines, suppliers, ["l_suppkey"], ["s_suppkey"]).select("l_orderkey", "l_linenumber", "s_name", "n_name")


LOOKUP_SQL = """WITH last AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order,
        arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS last_price FROM orders GROUP BY 1)
    SELECT c_custkey, c_mktsegment, last_order, last_price, last_order IS NOT NULL AS found
    FROM customer LEFT JOIN last ON o_custkey = c_custkey"""


def _lookup(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("c_custkey"), "o_orderdate", F.col("o_orderkey").alias("last_order"), F.col("o_totalprice").alias("last_price")
    )
    latest = joins.latest_per_key(orders, ["c_custkey"], "o_orderdate").drop("o_orderdate")
    requests = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return joins.lookup_latest(requests, [(latest, ["c_custkey"])], keep_found="found")


@query("lookup_latest", LOOKUP_SQL)
def lookup_latest(spark, sf_dir):
    return _lookup(spark, sf_dir)


@query(
    "enrich_impute",
    LOOKUP_SQL.replace("SELECT c_custkey, c_mktsegment, last_order, last_price, last_order IS NOT NULL AS found",
                       "SELECT c_custkey, c_mktsegment, coalesce(last_order, -1) AS last_order, round(coalesce(last_price, (SELECT avg(last_price) FROM last)), 4) AS last_price"),
)
def enrich_impute(spark, sf_dir):
    enriched = _lookup(spark, sf_dir).drop("found")
    known = stats.describe_numeric(enriched, ["last_price"], approximate=True)
    filled = steps.impute_with_stats(
        enriched, {"last_price": "$mean", "last_order": -1}, known, ["last_price", "last_order"]
    )
    return filled.withColumn("last_price", money("last_price", 4))


FIXED_SQL = f"""WITH w AS (SELECT user_id, {end_sql('ts', 86400)} AS wend, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2),
      q AS (SELECT event_id, user_id, ts FROM events)"""


def _daily(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    windows = aggregate_windows(
        events.select("user_id", "ts", "value"), ["user_id"], "ts",
        [Aggregation("value", ("count", "sum"), "1d")], carry_last=False,
    ).select("user_id", F.col("ts").alias("wend"), F.col("value_count_1d").alias("n"), money("value_sum_1d").alias("total"))
    return windows, events.select("event_id", "user_id", "ts")


@query(
    "lookup_fixed_window",
    FIXED_SQL + """ SELECT q.event_id, q.user_id, q.ts, w.wend AS window_end, n, total FROM q
    ASOF LEFT JOIN w ON w.user_id = q.user_id AND q.ts >= w.wend""",
)
def lookup_fixed_window(spark, sf_dir):
    windows, requests = _daily(spark, sf_dir)
    return joins.lookup_fixed_window(requests, windows, ["user_id"], "ts", "wend", "1d")


@query(
    "lookup_open_window",
    FIXED_SQL + f""" SELECT q.event_id, q.user_id, q.ts, {end_sql('q.ts', 86400)} AS window_end, n, total FROM q
    LEFT JOIN w ON w.user_id = q.user_id AND w.wend = {end_sql('q.ts', 86400)}""",
)
def lookup_open_window(spark, sf_dir):
    windows, requests = _daily(spark, sf_dir)
    return joins.lookup_fixed_window(requests, windows, ["user_id"], "ts", "wend", "1d", "current_open")


@query(
    "merge_by_key",
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity,
        (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1) // 3 AS g,
        l_shipdate, l_partkey, l_suppkey, l_extendedprice FROM lineitem)
    SELECT l_orderkey, string_agg(l_quantity::INT::VARCHAR, ',' ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS parts
    FROM p GROUP BY l_orderkey, g HAVING count(*) = 3""",
)
def merge_by_key(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    order = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    merged = joins.merge_by_key(lines, "l_orderkey", order, F.col("l_quantity").cast("int").cast("string"), 3)
    return merged.withColumn("parts", F.array_join("parts", ","))


@query(
    "udf_merge",
    """WITH p AS (SELECT user_id, value, ts, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 4 AS g FROM events)
    SELECT user_id, round(sum(value), 2) AS total, round(max(value), 2) AS peak FROM p GROUP BY user_id, g HAVING count(*) = 4""",
)
def udf_merge(spark, sf_dir):
    """The gathered parts go through a merge expression of the caller."""
    events = table(spark, sf_dir, "events")
    merged = joins.merge_by_key(events, "user_id", ["ts", "event_id"], F.col("value"), 4)
    total = F.aggregate("parts", F.lit(0.0), lambda a, x: a + x)
    return merged.select("user_id", money(total).alias("total"), money(F.array_max("parts")).alias("peak"))


@query("join_semi_anti", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def join_semi_anti(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(done, "c_custkey", "left_anti")


@query(
    "sort_order_by",
    "SELECT n_name, c_name, c_acctbal AS balance FROM customer JOIN nation ON n_nationkey = c_nationkey ORDER BY n_name, balance",
)
def sort_order_by(spark, sf_dir):
    sets = _tpch(spark, sf_dir)
    vector = FeatureVector(("nation.n_name", "customer.c_name", "customer.c_acctbal as balance"))
    return offline_features(vector, sets, order_by=["n_name", "c_acctbal"])


@query("limit_preview", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 20")
def limit_preview(spark, sf_dir):
    return stats.preview(table(spark, sf_dir, "orders"), 20, max_columns=3, order=["o_orderkey"])


@query(
    "sample_by_hash",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE ('0x' || substr(md5('s|' || l_orderkey || '|' || l_linenumber), 1, 8))::BIGINT < (0.1 * 4294967296)::BIGINT",
)
def sample_by_hash(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return stats.sample_by_hash(lines, ["l_orderkey", "l_linenumber"], 0.1, "s")


@query("sample_rows")
def sample_rows(spark, sf_dir):
    return stats.sample_rows(table(spark, sf_dir, "lineitem"), 0.1, seed=42)


@query(
    "topk_best",
    """SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS o_orderkey, max(o_totalprice) AS o_totalprice
    FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1""",
)
def topk_best(spark, sf_dir):
    runs_table = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", "o_totalprice", F.when(F.col("o_orderstatus") == "F", "error").otherwise("completed").alias("state")
    )
    best = runs.best_run(
        runs_table, "max.price", F.col("o_totalprice").cast("string"), order="o_orderkey", groups=["o_custkey"]
    )
    return best.drop("state")


@query(
    "union_by_name",
    """SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment, NULL::VARCHAR AS name FROM customer
    UNION ALL SELECT s_suppkey, s_acctbal, NULL, s_name FROM supplier""",
)
def union_by_name(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


@query(
    "win_latest_per_row",
    """SELECT l.event_id, r.event_id AS error_id FROM (SELECT * FROM events WHERE event_type = 'click') l
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') r ON r.user_id = l.user_id AND l.ts >= r.ts""",
)
def win_latest_per_row(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    errors = F.when(F.col("event_type") == "error", F.col("event_id"))
    carried = running(events, ["user_id"], ["ts", "event_id"], {"error_id": ("last", errors)})
    return carried.where("event_type = 'click'").select("event_id", "error_id")
