"""Time-window aggregates and ordered scans per key."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import cuts, ordered
from tidemark.operators.series import aggregate_series
from tidemark.operators.windows import aggregate_every_event, aggregate_windows, reduce_all
from tidemark.specs import Aggregation

from .base import end_sql, money, query, table

H = 3600


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")


@query(
    "agg_ops",
    f"""SELECT user_id, {end_sql('ts', 86400)} AS ts, count(value) AS value_count_1d, round(sum(value), 2) AS value_sum_1d,
      round(sum(value * value), 4) AS value_sqr_1d, max(value) AS value_max_1d, min(value) AS value_min_1d,
      arg_min(value, ts) AS value_first_1d, arg_max(value, ts) AS value_last_1d, round(avg(value), 6) AS value_avg_1d,
      round(var_samp(value), 8) AS value_stdvar_1d, round(stddev_samp(value), 6) AS value_stddev_1d, '1d' AS ts_window
    FROM events GROUP BY user_id, {end_sql('ts', 86400)}""",
)
def agg_ops(spark, sf_dir):
    ops = ("count", "sum", "sqr", "max", "min", "first", "last", "avg", "stdvar", "stddev")
    out = aggregate_windows(_events(spark, sf_dir), ["user_id"], "ts", [Aggregation("value", ops, "1d")], carry_last=False)
    digits = {"sum": 2, "sqr": 4, "avg": 6, "stdvar": 8, "stddev": 6}
    return out.withColumns({f"value_{op}_1d": money(f"value_{op}_1d", d) for op, d in digits.items()})


@query(
    "agg_window_tumbling",
    f"""SELECT event_type, {end_sql('ts', H)} AS ts, round(sum(value), 2) AS value_sum_1h, count(value) AS value_count_1h,
      '1h' AS ts_window FROM events GROUP BY event_type, {end_sql('ts', H)}""",
)
def agg_window_tumbling(spark, sf_dir):
    agg = Aggregation("value", ("sum", "count"), "1h")
    out = aggregate_windows(_events(spark, sf_dir), ["event_type"], "ts", [agg], carry_last=False)
    return out.withColumn("value_sum_1h", money("value_sum_1h"))


def sliding_sql(key: str, size: int, step: int, label: str) -> str:
    """Every period-aligned window that holds an event, window end as time."""
    micros = step * 1_000_000
    return f"""SELECT {key}, make_timestamp(wend) AS ts, round(sum(value), 2) AS value_sum_{label},
      max(value) AS value_max_{label}, round(stddev_samp(value), 4) AS value_stddev_{label}, '{label}' AS ts_window
    FROM (SELECT {key}, value, unnest(range((epoch_us(ts) // {micros} + 1) * {micros},
      (epoch_us(ts) // {micros} + 1) * {micros} + {size * 1_000_000}, {micros})) AS wend FROM events) GROUP BY {key}, wend"""


@query("agg_window_sliding", sliding_sql("user_id", 6 * H, H, "6h"))
def agg_window_sliding(spark, sf_dir):
    agg = Aggregation("value", ("sum", "max", "stddev"), "6h", "1h")
    out = aggregate_windows(_events(spark, sf_dir), ["user_id"], "ts", [agg], carry_last=False)
    return out.withColumns({"value_sum_6h": money("value_sum_6h"), "value_stddev_6h": money("value_stddev_6h", 4)})


@query(
    "agg_multi_window",
    f"""SELECT user_id, {end_sql('ts', 6 * H)} AS ts, round(sum(value), 2) AS value_sum_6h, NULL::DOUBLE AS value_sum_1d,
      NULL::BIGINT AS n_count_7d, '6h' AS ts_window FROM events GROUP BY user_id, {end_sql('ts', 6 * H)}
    UNION ALL SELECT user_id, {end_sql('ts', 86400)}, NULL, round(sum(value), 2), NULL, '1d' FROM events GROUP BY user_id, {end_sql('ts', 86400)}
    UNION ALL SELECT user_id, {end_sql('ts', 7 * 86400)}, NULL, NULL, count(event_id), '7d' FROM events GROUP BY user_id, {end_sql('ts', 7 * 86400)}""",
)
def agg_multi_window(spark, sf_dir):
    aggs = [Aggregation("value", "sum", ("6h", "1d")), Aggregation("event_id", "count", "7d", name="n")]
    out = aggregate_windows(_events(spark, sf_dir), ["user_id"], "ts", aggs, carry_last=False)
    return out.withColumns({c: money(c) for c in ("value_sum_6h", "value_sum_1d")})


@query(
    "agg_last_values",
    f"""SELECT user_id, {end_sql('ts', 86400)} AS ts, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type,
      arg_max(value, ts) AS value, max(value) AS value_max_1d, '1d' AS ts_window FROM events GROUP BY user_id, {end_sql('ts', 86400)}""",
)
def agg_last_values(spark, sf_dir):
    return aggregate_windows(_events(spark, sf_dir), ["user_id"], "ts", [Aggregation("value", "max", "1d")])


EVERY_SQL = """SELECT a.event_id, a.user_id, a.ts, a.value, count(b.value) AS value_count_{label}, round(sum(b.value), 2) AS value_sum_{label},
      max(b.value) AS value_max_{label}, round(var_samp(b.value), 8) AS value_stdvar_{label}
    FROM events a JOIN events b ON b.user_id = a.user_id AND b.ts <= a.ts
      AND epoch_us(b.ts) >= epoch_us(a.ts) // {p} * {p} + {p} - {w} GROUP BY ALL"""


@query("agg_emit_every_event", EVERY_SQL.format(label="2d", p=6 * H * 1_000_000, w=48 * H * 1_000_000))
def agg_emit_every_event(spark, sf_dir):
    events = _events(spark, sf_dir).drop("event_type")
    agg = Aggregation("value", ("count", "sum", "max", "stdvar"), "2d", "6h")
    out = aggregate_every_event(events, ["user_id"], "ts", [agg])
    return out.withColumns({"value_sum_2d": money("value_sum_2d"), "value_stdvar_2d": money("value_stdvar_2d", 8)})


@query(
    "agg_naming",
    f"""SELECT user_id, {end_sql('ts', 86400)} AS ts, max(value) AS amount_max_1d, count(value) AS value_count_1d, '1d' AS ts_window
    FROM events GROUP BY user_id, {end_sql('ts', 86400)}""",
)
def agg_naming(spark, sf_dir):
    aggs = [Aggregation("value", "max", "1d", name="amount"), Aggregation("value", "count", "1d")]
    return aggregate_windows(_events(spark, sf_dir), ["user_id"], "ts", aggs, carry_last=False)


@query(
    "agg_global_reduce",
    """SELECT count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 0) AS revenue, max(l_shipdate) AS newest FROM lineitem""",
)
def agg_global_reduce(spark, sf_dir):
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return reduce_all(
        table(spark, sf_dir, "lineitem"),
        [F.count(F.lit(1)).alias("n"), F.round(revenue, 0).alias("revenue"), F.max("l_shipdate").alias("newest")],
    )


@query(
    "agg_batch_n",
    """SELECT user_id, batch, count(*) AS n, round(sum(value), 2) AS total, max(ts) AS closed FROM (SELECT user_id, value, ts,
      (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 10 AS batch FROM events) GROUP BY 1, 2""",
)
def agg_batch_n(spark, sf_dir):
    batched = ordered.batch_of(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], 10)
    return batched.groupBy("user_id", "batch").agg(
        F.count(F.lit(1)).alias("n"), money(F.sum("value")).alias("total"), F.max("ts").alias("closed")
    )


#: Rows of every batch of 10 events or 5 days, cut greedily; ``closes`` is when a batch that is not full ends.
BATCHED = """WITH RECURSIVE p AS (SELECT user_id, event_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos,
        1 + count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 431999999999 MICROSECONDS FOLLOWING) AS by_time FROM events),
      s AS (SELECT user_id, 1::BIGINT AS pos, 0::BIGINT AS batch FROM events GROUP BY user_id
        UNION ALL SELECT n.user_id, n.pos, n.batch FROM (SELECT s.user_id, least(s.pos + 10, p.by_time) AS pos, s.batch + 1 AS batch FROM s JOIN p USING (user_id, pos)) n
          JOIN p USING (user_id, pos)),
      b AS (SELECT user_id, batch, pos AS begins, lead(pos) OVER (PARTITION BY user_id ORDER BY pos) AS stop FROM s),
      r AS (SELECT p.user_id, event_id, ts, value, batch, stop FROM p JOIN b ON p.user_id = b.user_id AND pos >= begins AND (stop IS NULL OR pos < stop))"""


@query(
    "agg_batch_timeout",
    f"""{BATCHED} SELECT user_id, batch, count(*) AS n, min(ts) AS first_time, max(ts) AS last_time, round(sum(value), 2) AS total,
      CASE WHEN count(*) = 10 THEN 'count' WHEN max(stop) IS NOT NULL THEN 'time' ELSE 'open' END AS closed_by FROM r GROUP BY 1, 2""",
)
def agg_batch_timeout(spark, sf_dir):
    """Batches of ten events or five days, whichever comes first."""
    batched = cuts.batch_by_time(_events(spark, sf_dir).select("user_id", "event_id", "ts", "value"), ["user_id"], "ts", 10, "5d", ["event_id"])
    return cuts.closed_batches(batched, ["user_id"], "ts", 10, [money(F.sum("value")).alias("total")])


@query(
    "agg_tsdb",
    f"""SELECT event_type, make_timestamp(epoch_us(ts) // {6 * H * 1_000_000} * {6 * H * 1_000_000}) AS start, {end_sql('ts', 6 * H)} AS "end",
      round(avg(value), 6) AS avg_value, max(value) AS max_value, count(value) AS count_value FROM events
    WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25' AND value > 1
    GROUP BY event_type, epoch_us(ts) // {6 * H * 1_000_000}, {end_sql('ts', 6 * H)}""",
)
def agg_tsdb(spark, sf_dir):
    out = aggregate_series(
        _events(spark, sf_dir), "ts", ["value"], ["avg", "max", "count"], "6h", groups=["event_type"],
        where="value > 1", start="2024-01-05", end="2024-01-25",
    )
    return out.withColumn("avg_value", money("avg_value", 6))


@query(
    "agg_tsdb_sliding",
    f"""SELECT make_timestamp(s) AS start, make_timestamp(s + {4 * H * 1_000_000}) AS "end", round(sum(value), 2) AS sum_value FROM
      (SELECT value, unnest(range(epoch_us(ts) // {H * 1_000_000} * {H * 1_000_000} - {3 * H * 1_000_000},
        epoch_us(ts) // {H * 1_000_000} * {H * 1_000_000} + 1, {H * 1_000_000})) AS s FROM events WHERE event_type = 'view')
    GROUP BY s""",
)
def agg_tsdb_sliding(spark, sf_dir):
    out = aggregate_series(_events(spark, sf_dir), "ts", ["value"], ["sum"], "4h", "1h", where="event_type = 'view'")
    return out.withColumn("sum_value", money("sum_value"))


@query(
    "win_first_window",
    f"""SELECT event_id, {end_sql('ts', H)} AS first_end, make_timestamp((epoch_us(ts) // {H * 1_000_000}) * {H * 1_000_000} + {6 * H * 1_000_000}) AS last_end FROM events""",
)
def win_first_window(spark, sf_dir):
    """First and last sliding window (6h by 1h) of each event, by arithmetic instead of ranking."""
    from tidemark.functions.time import epoch_bucket

    hour = H * 1_000_000
    start = epoch_bucket("ts", hour)
    return _events(spark, sf_dir).select(
        "event_id",
        F.timestamp_micros(start + hour).alias("first_end"),
        F.timestamp_micros(start + 6 * hour).alias("last_end"),
    )


@query(
    "win_trailing_agg",
    """SELECT event_id, user_id, ts, count(*) OVER w AS seen, round(sum(value) OVER w, 2) AS total, max(value) OVER w AS peak FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
)
def win_trailing_agg(spark, sf_dir):
    out = ordered.running(
        _events(spark, sf_dir).select("event_id", "user_id", "ts", "value"), ["user_id"], ["ts", "event_id"],
        {"seen": ("count", F.lit(1)), "total": ("sum", F.col("value")), "peak": ("max", F.col("value"))},
    )
    return out.select("event_id", "user_id", "ts", "seen", money("total").alias("total"), "peak")


@query(
    "win_collapse",
    """SELECT a.event_id, a.user_id, a.ts, a.value,
      count(b.value) FILTER (WHERE epoch_us(b.ts) >= epoch_us(a.ts) // 3600000000 * 3600000000 - 5 * 3600000000) AS value_count_6h,
      count(b.value) FILTER (WHERE epoch_us(b.ts) >= epoch_us(a.ts) // 3600000000 * 3600000000 - 23 * 3600000000) AS value_count_24h,
      max(b.value) FILTER (WHERE epoch_us(b.ts) >= epoch_us(a.ts) // 604800000000 * 604800000000) AS week_max_7d
    FROM events a JOIN events b ON b.user_id = a.user_id AND b.ts <= a.ts GROUP BY ALL""",
)
def win_collapse(spark, sf_dir):
    """Several windows and periods per event collapse into one row without joining back."""
    aggs = [Aggregation("value", "count", ("6h", "24h"), "1h"), Aggregation("value", "max", "7d", name="week")]
    events = _events(spark, sf_dir).drop("event_type")
    return aggregate_every_event(events, ["user_id"], "ts", aggs)


@query(
    "win_sample",
    """SELECT event_id, user_id, ts FROM events QUALIFY (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) % 10 = 0""",
)
def win_sample(spark, sf_dir):
    events = _events(spark, sf_dir).select("event_id", "user_id", "ts")
    return ordered.sample_every(events, ["user_id"], ["ts", "event_id"], 10)
