"""Filters and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.names import metric_names_column, normalize_columns
from tidemark.operators import filters, steps
from tidemark.plans.vector import offline_features
from tidemark.specs import FeatureSet, FeatureVector

from .base import query, table


@query(
    "filter_time_range",
    """SELECT o_orderkey, o_orderdate FROM orders
    WHERE o_orderdate > TIMESTAMP '1997-03-01' AND o_orderdate <= TIMESTAMP '1997-09-30'""",
)
def filter_time_range(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return filters.time_range(orders, "o_orderdate", "1997-03-01", "1997-09-30")


def _order_sets(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max("l_shipdate").alias("shipped"), F.count(F.lit(1)).alias("lines")
    )
    return {
        "orders": FeatureSet("orders", ("o_orderkey",), relations={}, df=orders),
        "lines": FeatureSet("lines", ("o_orderkey",), df=lines),
    }


@query(
    "filter_time_per_set",
    """SELECT o_orderkey, o_totalprice, lines FROM orders JOIN
      (SELECT l_orderkey, max(l_shipdate) AS shipped, count(*) AS lines FROM lineitem GROUP BY l_orderkey) l
      ON l_orderkey = o_orderkey
    WHERE o_orderdate > TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1998-01-01'
      AND shipped > TIMESTAMP '1996-01-01' AND shipped <= TIMESTAMP '1998-01-01'""",
)
def filter_time_per_set(spark, sf_dir):
    vector = FeatureVector(("orders.o_totalprice", "lines.lines"), with_indexes=True)
    return offline_features(
        vector, _order_sets(spark, sf_dir), start="1996-01-01", end="1998-01-01",
        time_filter={"orders": "o_orderdate", "lines": "shipped"},
    )


@query(
    "filter_additional",
    """SELECT p_partkey, p_brand, p_size, p_type FROM part
    WHERE p_size >= 10 AND p_size != 20 AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#17')
      AND p_type NOT IN ('ECONOMY')""",
)
def filter_additional(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_type")
    return filters.additional_filters(
        part,
        [
            ("p_size", ">=", 10),
            ("p_size", "!=", 20),
            ("p_brand", "in", ["Brand#1", "Brand#2", "Brand#17", None]),
            ("p_type", "not in", ["ECONOMY"]),
        ],
    )


@query(
    "filter_query",
    """SELECT o_orderkey, o_totalprice, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey
    WHERE o_totalprice > 200000 AND c_mktsegment = 'MACHINERY'""",
)
def filter_query(spark, sf_dir):
    sets = {
        "orders": FeatureSet("orders", ("o_orderkey",), relations={"o_custkey": "c_custkey"}, df=table(spark, sf_dir, "orders")),
        "customer": FeatureSet("customer", ("c_custkey",), df=table(spark, sf_dir, "customer")),
    }
    vector = FeatureVector(("orders.o_totalprice", "customer.c_mktsegment"), with_indexes=True)
    return offline_features(
        vector, sets, query="o_totalprice > 200000 AND c_mktsegment = 'MACHINERY'", drop_columns=["o_custkey", "c_custkey"]
    )


@query("filter_predicate", "SELECT event_id, value FROM events WHERE event_type = 'error' AND value > 25")
def filter_predicate(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.where((F.col("event_type") == "error") & (F.col("value") > 25)).select("event_id", "value")


@query(
    "filter_label_not_null",
    """SELECT d.doc_id, n_chars, quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
    WHERE quality IS NOT NULL""",
)
def filter_label_not_null(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return filters.label_not_null(docs.join(labels, "doc_id", "left"), "quality")


@query(
    "project_select",
    """SELECT n_name, s.s_name AS sup_s_name, s.s_nationkey AS sup_s_nationkey, round(s.s_acctbal, 2) AS balance
    FROM supplier s JOIN nation ON n_nationkey = s_nationkey""",
)
def project_select(spark, sf_dir):
    sets = {
        "supplier": FeatureSet("supplier", ("s_suppkey",), relations={"s_nationkey": "n_nationkey"}, df=table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")),
        "balance": FeatureSet("balance", ("s_suppkey",), df=table(spark, sf_dir, "supplier").select("s_suppkey", F.round("s_acctbal", 2).alias("s_acctbal"))),
        "nation": FeatureSet("nation", ("n_nationkey",), df=table(spark, sf_dir, "nation")),
    }
    vector = FeatureVector(("supplier.* as sup", "nation.n_name"), label="balance.s_acctbal as balance")
    return offline_features(vector, sets)


@query(
    "project_unique_rename",
    """SELECT c_acctbal AS v, s_acctbal AS v_suppliers, k FROM
      (SELECT c_nationkey AS k, round(sum(c_acctbal), 2) AS c_acctbal FROM customer GROUP BY 1) c JOIN
      (SELECT s_nationkey AS k, round(sum(s_acctbal), 2) AS s_acctbal FROM supplier GROUP BY 1) s USING (k)""",
)
def project_unique_rename(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.round(F.sum("c_acctbal"), 2).alias("v"))
    suppliers = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.round(F.sum("s_acctbal"), 2).alias("v"))
    sets = {
        "customers": FeatureSet("customers", ("k",), df=customers),
        "suppliers": FeatureSet("suppliers", ("k",), df=suppliers),
    }
    return offline_features(FeatureVector(("customers.v", "suppliers.v"), with_indexes=True), sets)


@query("project_drop_columns", "SELECT o_orderstatus, o_orderdate FROM orders")
def project_drop_columns(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").drop("o_custkey", "o_orderpriority")
    sets = {"orders": FeatureSet("orders", ("o_orderkey",), df=orders)}
    return offline_features(FeatureVector(("orders.*",)), sets, drop_columns=["o_totalprice"])


@query("step_drop_features", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def step_drop_features(spark, sf_dir):
    fs = FeatureSet("customer", ("c_custkey",), label_column="c_acctbal")
    return steps.drop_features(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], fs)


@query("step_rename", "SELECT p_partkey AS part_id, p_retailprice AS price FROM part")
def step_rename(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return steps.rename(part, {"p_partkey": "part_id", "p_retailprice": "price"})


@query(
    "step_extend",
    """SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net,
      l_quantity > 25 AS bulk FROM lineitem""",
)
def step_extend(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    out = steps.extend(
        lines,
        {"net": F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4), "bulk": F.col("l_quantity") > 25},
    )
    return out.select("l_orderkey", "l_linenumber", "net", "bulk")


@query(
    "step_event_metadata",
    "SELECT event_id::VARCHAR AS event_id, (props::JSON ->> 'k') AS event_key, value FROM events",
)
def step_event_metadata(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn(
        "body", F.struct(F.col("event_id").alias("id"), F.from_json("props", "k long").alias("props"))
    )
    out = steps.event_metadata(events, "body.id", "body.props.k")
    return out.select("event_id", "event_key", "value")


@query("normalize_columns", 'SELECT n_nationkey AS nation_key, n_name AS name_text FROM nation')
def normalize(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("nation (key)"), F.col("n_name").alias("name text")
    )
    return normalize_columns(nation)


@query(
    "normalize_keys_metric",
    """SELECT event_id, '_' || event_type || '_value' AS metric, value FROM events
    UNION ALL SELECT event_id, '_1' || event_type, value FROM events""",
)
def normalize_keys_metric(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    named = F.create_map(
        F.concat(F.lit("-"), "event_type", F.lit("-value")), "value",
        F.concat(F.lit("1"), "event_type"), "value",
    )
    return events.select("event_id", F.explode(metric_names_column(named)).alias("metric", "value"))
