"""Feature steps and validators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions.keys import hash_keys
from tidemark.functions.tables import register_table_functions
from tidemark.functions.time import parse_mixed_ts, with_date_parts
from tidemark.operators import filters, stats, steps, validate
from tidemark.operators.scoring import apply_handler

from .base import query, table

PRIORITIES = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4, "5-LOW": 5}


@query(
    "step_map_values",
    """SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3
        WHEN '4-NOT SPECIFIED' THEN 4 WHEN '5-LOW' THEN 5 END AS o_orderpriority,
      CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'P' THEN 'pending' ELSE o_orderstatus END AS o_orderstatus
    FROM orders""",
)
def step_map_values(spark, sf_dir):
    return steps.map_values(
        table(spark, sf_dir, "orders"),
        {"o_orderpriority": PRIORITIES, "o_orderstatus": {"F": "filled", "P": "pending"}},
    )


@query(
    "step_map_ranges",
    """SELECT p_partkey, p_size, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' END AS p_size_mapped,
      CASE WHEN p_retailprice < 1000 THEN 'cheap' WHEN p_retailprice >= 1000 THEN 'dear' END AS p_retailprice_mapped
    FROM part""",
)
def step_map_ranges(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    mapped = steps.map_values(
        part,
        {
            "p_size": {"ranges": {"small": ["-inf", 10], "medium": [10, 30]}},
            "p_retailprice": {"ranges": {"cheap": [0, 1000], "dear": [1000, "inf"]}},
        },
        with_original=True,
    )
    return mapped.drop("p_retailprice")


@query(
    "step_impute",
    """SELECT d.doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic,
      CASE WHEN l.doc_id IS NULL THEN 0.5 ELSE n_chars / 1000.0 END::DOUBLE AS size
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def step_impute(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    joined = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    size = F.when(F.col("quality").isNull(), F.lit(float("nan"))).otherwise(F.col("n_chars") / 1000)
    frame = joined.select("doc_id", "quality", "toxic", size.alias("size"))
    return steps.impute(frame, {"quality": -1, "size": 0.5}, default=0)


@query(
    "impute_policy",
    """WITH j AS (SELECT d.doc_id, n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
      s AS (SELECT avg(quality) AS m, max(toxic) AS x FROM j)
    SELECT doc_id, round(coalesce(quality::DOUBLE, m), 6) AS quality, coalesce(toxic, x) AS toxic, n_chars FROM j, s""",
)
def impute_policy(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf_dir, "labels").withColumn("quality", F.col("quality").cast("double"))
    joined = docs.join(labels, "doc_id", "left").select("doc_id", "n_chars", "quality", "toxic")
    known = stats.describe_numeric(joined, ["quality", "toxic", "n_chars"], approximate=True)
    filled = steps.impute_with_stats(
        joined, {"quality": "$mean", "toxic": "$max", "*": 0}, known, ["quality", "toxic", "n_chars"]
    )
    return filled.withColumn("quality", F.round("quality", 6))


@query(
    "step_one_hot",
    """SELECT o_orderkey, (o_orderpriority = '1-URGENT')::INT AS o_orderpriority_1_URGENT,
      (o_orderpriority = '4-NOT SPECIFIED')::INT AS o_orderpriority_4_NOT_SPECIFIED,
      (o_orderstatus = 'F')::INT AS o_orderstatus_F, (o_orderstatus = 'O')::INT AS o_orderstatus_O FROM orders""",
)
def step_one_hot(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return steps.one_hot(
        orders, {"o_orderpriority": ["1-URGENT", "4-NOT SPECIFIED"], "o_orderstatus": ["F", "O"]}
    )


DATE_PARTS = [
    "year", "quarter", "month", "weekofyear", "day", "hour", "minute", "second", "day_of_week",
    "dayofyear", "days_in_month", "is_leap_year", "is_month_start", "is_month_end",
    "is_quarter_start", "is_quarter_end", "is_year_start", "is_year_end", "asm8", "tz",
]


@query(
    "step_date_parts",
    """SELECT event_id, ts, year(ts)::INT AS ts_year, quarter(ts)::INT AS ts_quarter, month(ts)::INT AS ts_month,
      weekofyear(ts)::INT AS ts_weekofyear, day(ts)::INT AS ts_day, hour(ts)::INT AS ts_hour,
      minute(ts)::INT AS ts_minute, second(ts)::INT AS ts_second, (isodow(ts) - 1)::INT AS ts_day_of_week,
      dayofyear(ts)::INT AS ts_dayofyear, day(last_day(ts))::INT AS ts_days_in_month,
      (year(ts) % 4 = 0 AND (year(ts) % 100 <> 0 OR year(ts) % 400 = 0)) AS ts_is_leap_year,
      day(ts) = 1 AS ts_is_month_start, ts::DATE = last_day(ts) AS ts_is_month_end,
      (day(ts) = 1 AND month(ts) IN (1, 4, 7, 10)) AS ts_is_quarter_start,
      (ts::DATE = last_day(ts) AND month(ts) IN (3, 6, 9, 12)) AS ts_is_quarter_end,
      dayofyear(ts) = 1 AS ts_is_year_start, (month(ts) = 12 AND day(ts) = 31) AS ts_is_year_end,
      epoch_us(ts) * 1000 AS ts_asm8, 'UTC' AS ts_tz
    FROM events""",
)
def step_date_parts(spark, sf_dir):
    return with_date_parts(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", DATE_PARTS)


@query(
    "date_parts",
    """SELECT o_orderkey, year(o_orderdate)::INT AS o_orderdate_year, quarter(o_orderdate)::INT AS o_orderdate_quarter,
      (isodow(o_orderdate) - 1)::INT AS o_orderdate_dayofweek, day(last_day(o_orderdate))::INT AS o_orderdate_daysinmonth,
      o_orderdate::DATE = last_day(o_orderdate) AS o_orderdate_is_month_end, dayofyear(o_orderdate) = 1 AS o_orderdate_is_year_start
    FROM orders""",
)
def date_parts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    parts = ["year", "quarter", "dayofweek", "daysinmonth", "is_month_end", "is_year_start"]
    return with_date_parts(orders, "o_orderdate", parts).drop("o_orderdate")


@query(
    "time_expr",
    """SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'
    AND ts <= TIMESTAMP '2024-01-24 10:30:15'""",
)
def time_expr(spark, sf_dir):
    import datetime as dt

    now = dt.datetime(2024, 1, 25, 12, 30, 15, tzinfo=dt.timezone.utc)
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    return filters.time_range(events, "ts", "now -5d12h floor 1d", "now -1d2h", now)


@query("parse_mixed_ts", "SELECT event_id, ts AS parsed FROM events")
def parse_mixed(spark, sf_dir):
    layouts = ["yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd HH:mm:ss.SSSSSSXXX"]
    texts = F.array(*[F.date_format("ts", layout) for layout in layouts])
    events = table(spark, sf_dir, "events")
    mixed = events.select("event_id", F.get(texts, (F.col("event_id") % 3).cast("int")).alias("text"))
    return mixed.select("event_id", parse_mixed_ts("text").alias("parsed"))


@query("hash_keys", "SELECT l_orderkey, l_linenumber, sha1(l_orderkey || l_linenumber::VARCHAR || l_returnflag) AS key FROM lineitem")
def hash_keys_query(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", hash_keys(["l_orderkey", "l_linenumber", "l_returnflag"]).alias("key"))


@query("json_nested", "SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k, '{\"k\":' || (props::JSON ->> 'k') || '}' AS props_text FROM events")
def json_nested(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k long"))
    return events.select("event_id", F.col("p.k").alias("k"), F.to_json("p").alias("props_text"))


VALIDATORS = {
    "l_quantity": validate.MinMax("float", low=2, high=45),
    "l_discount": validate.MinMax(high=0.08),
    "l_returnflag": validate.Regex(pattern="A|N"),
    "l_linestatus": validate.MinMaxLen(low=2),
    "l_linenumber": validate.Validator("int8"),
}


@query(
    "step_validate",
    """SELECT feature, violations, example FROM (
      SELECT 'l_quantity' AS feature, count(*) AS violations, min(l_quantity::VARCHAR) AS example FROM lineitem WHERE l_quantity < 2 OR l_quantity > 45
      UNION ALL SELECT 'l_discount', count(*), min(l_discount::VARCHAR) FROM lineitem WHERE l_discount > 0.08
      UNION ALL SELECT 'l_returnflag', count(*), min(l_returnflag) FROM lineitem WHERE NOT regexp_full_match(l_returnflag, 'A|N')
      UNION ALL SELECT 'l_linestatus', count(*), min(l_linestatus) FROM lineitem WHERE length(l_linestatus) < 2
      UNION ALL SELECT 'l_linenumber', count(*), min(l_linenumber::VARCHAR) FROM lineitem WHERE l_linenumber NOT BETWEEN -128 AND 127)""",
)
def step_validate(spark, sf_dir):
    return validate.report(table(spark, sf_dir, "lineitem"), VALIDATORS).drop("severity")


@query(
    "validator_type",
    """SELECT event_id, (value::DECIMAL(38,0) NOT BETWEEN 0 AND 255) AS bad_uint8, try_cast(event_type AS DOUBLE) IS NULL AS bad_float,
      (event_id NOT BETWEEN -128 AND 127) AS bad_int8 FROM events""",
)
def validator_type(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    checks = {
        "value": validate.Validator("uint8"),
        "event_type": validate.Validator("float"),
        "event_id": validate.Validator("int8"),
    }
    bad = validate.violations(events, checks)
    return events.select(
        "event_id", bad["value"].alias("bad_uint8"), bad["event_type"].alias("bad_float"), bad["event_id"].alias("bad_int8")
    )


@query(
    "validator_minmax",
    """SELECT c_custkey, (c_acctbal < 0 OR c_acctbal > 5000) AS bad FROM customer""",
)
def validator_minmax(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    bad = validate.violations(customer, {"c_acctbal": validate.MinMax(low=0, high=5000)})
    return customer.select("c_custkey", bad["c_acctbal"].alias("bad"))


@query(
    "validator_minmaxlen",
    "SELECT doc_id, (length(text) < 100 OR length(text) > 2000) AS bad FROM documents",
)
def validator_minmaxlen(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    bad = validate.violations(docs, {"text": validate.MinMaxLen(low=100, high=2000)})
    return docs.select("doc_id", bad["text"].alias("bad"))


@query(
    "validator_regex",
    r"""SELECT page_id, NOT regexp_full_match(url, 'https?://[a-z.]+/(en|fr)/[0-9]+.*') AS bad FROM pages""",
)
def validator_regex(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    bad = validate.violations(pages, {"url": validate.Regex(pattern="https?://[a-z.]+/(en|fr)/[0-9]+.*")})
    return pages.select("page_id", bad["url"].alias("bad"))


class NetPrice:
    """A user step with its own argument check."""

    def __init__(self, price: str, discount: str):
        self.price, self.discount = price, discount

    def validate(self, df):
        missing = {self.price, self.discount} - set(df.columns)
        if missing:
            raise ValueError(f"columns {sorted(missing)} are missing")

    def do(self, df):
        return df.withColumn("net", F.round(F.col(self.price) * (1 - F.col(self.discount)), 4))


NET_SQL = "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem"


@query("udf_step", NET_SQL)
def udf_step(spark, sf_dir):
    out = steps.apply_step(table(spark, sf_dir, "lineitem"), NetPrice("l_extendedprice", "l_discount"))
    return out.select("l_orderkey", "l_linenumber", "net")


@query("udf_validate_args", NET_SQL)
def udf_validate_args(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    try:
        steps.apply_step(lines, NetPrice("l_extendedprice", "absent"))
    except ValueError:
        return steps.apply_step(lines, NetPrice("l_extendedprice", "l_discount")).select("l_orderkey", "l_linenumber", "net")
    raise AssertionError("a step with missing columns must be refused")


@query("udf_handler", "SELECT c_custkey, round(c_acctbal * 0.9 + 1, 4) AS scaled FROM customer")
def udf_handler(spark, sf_dir):
    def scale(df, factor, offset):
        return df.withColumn("scaled", F.round(F.col("c_acctbal") * factor + offset, 4))

    return steps.apply_step(table(spark, sf_dir, "customer"), scale, factor=0.9, offset=1).select("c_custkey", "scaled")


def _load_bands():
    """Set-up of the handler, once per task."""
    edges = np.array([0.0, 1000.0, 5000.0])

    def band(balance: pd.Series, nation: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, balance.to_numpy("float64"), side="right") * 100 + nation.to_numpy("int64"))

    return band


@query(
    "udf_handler_batches",
    "SELECT c_custkey, ((c_acctbal >= 0)::INT + (c_acctbal >= 1000)::INT + (c_acctbal >= 5000)::INT)::BIGINT * 100 + c_nationkey AS band FROM customer",
)
def udf_handler_batches(spark, sf_dir):
    """A user's handler over batches of columns, made once per task."""
    customer = table(spark, sf_dir, "customer")
    return apply_handler(customer, _load_bands, ["c_acctbal", "c_nationkey"], "band", "long").select("c_custkey", "band")


@query("step_map_udf", "SELECT p_partkey, upper(p_name) || '/' || p_brand AS label FROM part")
def step_map_udf(spark, sf_dir):
    def label(df):
        return df.select("p_partkey", F.concat_ws("/", F.upper("p_name"), "p_brand").alias("label"))

    return table(spark, sf_dir, "part").transform(label)


@query(
    "step_flat_map",
    "SELECT doc_id, u.pos::INT - 1 AS pos, u.line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(l) WITH ORDINALITY AS u(line, pos)",
)
def step_flat_map(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("lines", F.split("text", "\n"))
    return steps.flat_map(docs, "lines", "line", "pos").select("doc_id", "pos", "line")


@query("udtf_flat_map", "SELECT part.p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def udtf_flat_map(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return steps.flat_map(part, F.split("p_name", " "), "word").select("p_partkey", "word")


@query("udtf_split_sql", "SELECT p_partkey, unnest(range(len(string_split(p_name, ' '))))::INT AS part, unnest(string_split(p_name, ' ')) AS value FROM part")
def udtf_split_sql(spark, sf_dir):
    """A table function with a table argument, called from SQL."""
    register_table_functions(spark)
    table(spark, sf_dir, "part").createOrReplaceTempView("part_rows")
    return spark.sql("SELECT p_partkey, part, value FROM split_rows(TABLE(SELECT p_partkey, p_name FROM part_rows), 'p_name', ' ')")


@query(
    "udtf_sessions_sql",
    """WITH g AS (SELECT user_id, ts, (coalesce(ts - lag(ts) OVER w > INTERVAL 6 HOURS, true))::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS session FROM g)
    SELECT user_id, session::BIGINT AS session, min(ts) AS begins, max(ts) AS ends, count(*) AS n FROM s GROUP BY ALL""",
)
def udtf_sessions_sql(spark, sf_dir):
    """Sessions of every user: the function itself asks for PARTITION BY and ORDER BY."""
    register_table_functions(spark)
    table(spark, sf_dir, "events").createOrReplaceTempView("event_rows")
    return spark.sql("SELECT * FROM sessions(TABLE(SELECT user_id, ts FROM event_rows), 'user_id', 'ts', '6h')")


@query(
    "step_flatten",
    """SELECT o_orderkey, 'status' AS name, o_orderstatus AS value FROM orders
    UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM orders""",
)
def step_flatten(spark, sf_dir):
    pairs = F.array(
        F.struct(F.lit("status").alias("name"), F.col("o_orderstatus").alias("value")),
        F.struct(F.lit("priority").alias("name"), F.col("o_orderpriority").alias("value")),
    )
    return steps.flatten(table(spark, sf_dir, "orders"), pairs).select("o_orderkey", "name", "value")


@query(
    "step_choice",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'errors' WHEN value > 50 THEN 'large' ELSE 'other' END AS branch FROM events""",
)
def step_choice(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    branches = {"errors": F.col("event_type") == "error", "large": F.col("value") > 50}
    return steps.choice(events, branches, "other").select("event_id", "branch")


@query(
    "step_partition",
    """SELECT event_id, 'left' AS side, value FROM events WHERE value > 20
    UNION ALL SELECT event_id, 'right', value FROM events WHERE value <= 20""",
)
def step_partition(spark, sf_dir):
    left, right = steps.partition(table(spark, sf_dir, "events"), F.col("value") > 20)

    def tag(df, side):
        return df.select("event_id", F.lit(side).alias("side"), "value")

    return tag(left, "left").unionByName(tag(right, "right"))


@query(
    "step_error_branch",
    """SELECT page_id, try_cast(regexp_extract(url, '/([^/?#]*)(\\?.*|#.*)?$', 1) AS INT) AS number,
      CASE WHEN try_cast(regexp_extract(url, '/([^/?#]*)(\\?.*|#.*)?$', 1) AS INT) IS NULL THEN 'number' END AS error FROM pages""",
)
def step_error_branch(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    last = F.regexp_extract("url", r"/([^/?#]*)(\?.*|#.*)?$", 1)
    good, bad = steps.split_errors(pages, {"number": last.try_cast("int")})
    return good.select("page_id", "number", F.lit(None).cast("string").alias("error")).unionByName(
        bad.select("page_id", "number", "error")
    )


@query(
    "array_map_functions",
    """SELECT s_suppkey, 'name' AS k, s_name AS v FROM supplier UNION ALL SELECT s_suppkey, 'nation', s_nationkey::VARCHAR FROM supplier""",
)
def array_map_functions(spark, sf_dir):
    names = F.array(F.lit("name"), F.lit("nation"))
    values = F.array("s_name", F.col("s_nationkey").cast("string"))
    zipped = F.map_from_arrays(names, values)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(zipped).alias("k", "v"))
