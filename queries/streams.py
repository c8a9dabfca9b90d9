"""Structured Streaming queries over the event log, each drained to a table.

Raw prediction events are derived from ``events``: two inputs per even event, an error on
every tenth, no function on some users.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import validate
from tidemark.operators.ordered import flag_out_of_order
from tidemark.session import fresh_path
from tidemark.sources.files import stream_files
from tidemark.streaming import predictions as pred
from tidemark.streaming import processors, run, stateful
from tidemark.streaming.checks import drain_validated

from .base import end_sql, money, query, schema_of, table
from .windows import BATCHED


def _stream(spark, sf_dir):
    return stream_files(spark, f"{sf_dir}/events.parquet*", schema_of(spark, sf_dir, "events"))


#: Arrival of the events in three parts of time; every tenth event comes a part late.
ARRIVAL = """SELECT *, least(2, (epoch_us(ts) - lo) * 3 // (hi - lo + 1) + (event_id % 10 = 0)::INT) AS part
    FROM events, (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events)"""


def _arrivals(spark, sf_dir, go):
    """``go(stream, base)`` after each part has arrived; every run goes on from the last one's checkpoint."""
    events = table(spark, sf_dir, "events")
    low, high = events.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    on_time = F.floor((F.unix_micros("ts") - F.lit(low)) * 3 / F.lit(high - low + 1))
    part = F.least(F.lit(2), on_time + (F.col("event_id") % 10 == 0).cast("int"))
    base = fresh_path(spark, "arrivals")
    out = None
    for i in range(3):
        events.where(part == i).write.mode("append").parquet(f"{base}/in")
        out = go(stream_files(spark, f"{base}/in", events.schema), f"{base}/run")
    return out


def raw_events(events):
    """Prediction events as a model server would push them."""
    k = F.from_json("props", "k double")["k"]
    one = F.array("value", k)
    two = F.array(F.col("value") * 2, k)
    label = F.array(F.when(F.col("value") > 20, 1.0).otherwise(0.0))
    even = F.col("event_id") % 2 == 0
    user = F.col("user_id") % 3
    uri = F.when(user == 0, "prj/fn:v1").when(user == 1, "prj/fn@abc").otherwise("prj/fn")
    return events.select(
        F.when(F.col("user_id") % 50 != 0, uri).alias("function_uri"),
        F.col("event_type").alias("model"),
        F.when(F.col("user_id") % 2 == 0, "v2").alias("version"),
        F.lit("Model").alias("class"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("when"),
        F.when(F.col("event_id") % 97 != 0, F.round(F.col("value") * 100).cast("long")).alias("microsec"),
        F.struct(
            F.col("event_id").cast("string").alias("id"),
            F.when(even, F.array(one, two)).otherwise(F.array(one)).alias("inputs"),
        ).alias("request"),
        F.struct(
            F.col("event_id").cast("string").alias("id"),
            F.when(even, F.array(label, label)).otherwise(F.array(label)).alias("outputs"),
        ).alias("resp"),
        F.when(F.col("event_id") % 10 == 0, "failed").alias("error"),
        F.create_map(F.lit("kind"), F.lit("test")).alias("labels"),
        F.when(F.col("event_id") % 5 == 1, F.create_map(F.lit("m-1"), F.col("value")))
        .otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))
        .alias("metrics"),
    )


RAW = """WITH r AS (SELECT sha1('prj_fn_' || CASE user_id % 3 WHEN 0 THEN 'v1' WHEN 1 THEN 'abc' ELSE 'N/A' END || '_' || event_type || '_'
        || CASE WHEN user_id % 2 = 0 THEN 'v2' ELSE 'latest' END) AS endpoint_id,
        event_type || ':' || CASE WHEN user_id % 2 = 0 THEN 'v2' ELSE 'latest' END AS versioned_model, *,
        (props::JSON ->> 'k')::DOUBLE AS k, event_id % 10 = 0 AS failed, event_id % 97 = 0 AS invalid,
        round(value * 100)::BIGINT AS latency FROM events WHERE user_id % 50 <> 0),
      u AS (SELECT *, 0 AS part, value AS f0 FROM r WHERE NOT failed AND NOT invalid
        UNION ALL SELECT *, 1, value * 2 FROM r WHERE NOT failed AND NOT invalid AND event_id % 2 = 0)"""


def _identified(spark, sf_dir):
    return pred.with_endpoint_id(raw_events(_stream(spark, sf_dir)))


def _rows(spark, sf_dir):
    good, _ = pred.split_errors(_identified(spark, sf_dir))
    return pred.unpack(good)


def _messages(spark, sf_dir):
    """The events as JSON text: nested bodies, flat ones and single answers, as servers send them."""
    raw = raw_events(_stream(spark, sf_dir))
    flat = F.col("request.id").cast("long") % 3
    one = F.size("request.inputs") == 1
    inputs = F.when(one & (flat > 0), F.to_json(F.col("request.inputs")[0])).otherwise(F.to_json("request.inputs"))
    outputs = (
        F.when(one & (flat == 1), F.col("resp.outputs")[0][0].cast("string"))
        .when(flat != 0, F.to_json(F.transform("resp.outputs", lambda o: o[0])))
        .otherwise(F.to_json("resp.outputs"))
    )
    rest = F.to_json(F.struct(
        "function_uri", "model", "version", "class", "when", "microsec", "error", "labels", "metrics",
    ))
    body = F.concat(
        F.lit('{"request":{"id":"'), F.col("request.id"), F.lit('","inputs":'), inputs,
        F.lit('},"resp":{"id":"'), F.col("request.id"), F.lit('","outputs":'), outputs, F.lit("},"), F.substr(rest, F.lit(2)),
    )
    return raw.select(body.alias("body"))


@query("stream_endpoint_id", f"{RAW} SELECT endpoint_id, versioned_model, event_id::VARCHAR AS request_id FROM r")
def stream_endpoint_id(spark, sf_dir):
    stream = _identified(spark, sf_dir).select("endpoint_id", "versioned_model", F.col("request.id").alias("request_id"))
    return run.drain(stream, "endpoint-id")


@query("stream_error_split", f"{RAW} SELECT endpoint_id, ts AS timestamp, 'failed' AS model_error, 1.0::DOUBLE AS error_count FROM r WHERE failed")
def stream_error_split(spark, sf_dir):
    _, errors = pred.split_errors(_identified(spark, sf_dir))
    return run.drain(errors, "errors")


@query(
    "stream_unpack_predictions",
    f"""{RAW} SELECT endpoint_id, versioned_model AS model, ts AS timestamp, event_id::VARCHAR AS request_id, part::INT AS part, latency,
      f0, k AS f1, CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END::DOUBLE AS p0 FROM u""",
)
def stream_unpack_predictions(spark, sf_dir):
    """From JSON text whose inputs and outputs are nested, flat or single values."""
    events = pred.read_events(_messages(spark, sf_dir), "body")
    good, _ = pred.split_errors(pred.with_endpoint_id(events))
    rows = pred.unpack(good).select(
        "endpoint_id", "model", "timestamp", "request_id", "part", "latency",
        F.col("features")[0].alias("f0"), F.col("features")[1].alias("f1"), F.col("prediction")[0].alias("p0"),
    )
    return run.drain(rows, "unpack")


@query(
    "stream_first_last_request",
    f"""{RAW} SELECT endpoint_id, min(ts) FILTER (WHERE NOT failed) AS first_request, max(ts) FILTER (WHERE NOT failed) AS last_request,
      count(*) FILTER (WHERE failed OR invalid) AS error_count FROM r GROUP BY 1""",
)
def stream_first_last_request(spark, sf_dir):
    summary = pred.endpoint_summary(_identified(spark, sf_dir))
    return run.drain_table(summary, "endpoints", "update", run.replace_keys(["endpoint_id"]))


@query(
    "stream_out_of_order",
    """SELECT event_id, user_id, ts, coalesce(ts < max(ts) OVER (PARTITION BY user_id ORDER BY (props::JSON ->> 'k')::INT, event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS out_of_order FROM events""",
)
def stream_out_of_order(spark, sf_dir):
    """Arrival order is shuffled by the ``k`` property."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.from_json("props", "k int")["k"].alias("k"))
    return flag_out_of_order(events, ["user_id"], ["k", "event_id"], "ts").drop("k")


@query(
    "stream_map_names",
    f"""{RAW} SELECT event_id::VARCHAR AS request_id, part::INT AS part, CASE WHEN event_type = 'view' THEN 'amount' ELSE 'f0' END AS name, f0 AS value FROM u
    UNION ALL SELECT event_id::VARCHAR, part::INT, CASE WHEN event_type = 'view' THEN 'k' ELSE 'f1' END, k FROM u
    UNION ALL SELECT event_id::VARCHAR, part::INT, CASE WHEN event_type = 'view' THEN 'large' ELSE 'p0' END, CASE WHEN value > 20 THEN 1 ELSE 0 END FROM u""",
)
def stream_map_names(spark, sf_dir):
    views = pred.with_endpoint_id(raw_events(table(spark, sf_dir, "events"))).where("model = 'view'")
    known = views.select("endpoint_id").distinct().select(
        "endpoint_id",
        F.array(F.lit("amount"), F.lit("k")).alias("feature_names"),
        F.array(F.lit("large")).alias("label_names"),
    )
    named = pred.map_names(_rows(spark, sf_dir), known)
    long = named.select(
        "request_id", "part", F.explode(F.map_concat("named_features", "named_predictions")).alias("name", "value")
    )
    return run.drain(long, "names")


LIVE = """SELECT endpoint_id, make_timestamp(wend) AS timestamp, count(latency) AS predictions_count_{label}, round(avg(latency), 6) AS latency_avg_{label}{more} FROM
      (SELECT endpoint_id, latency, unnest(range((epoch_us(ts) // 300000000 + 1) * 300000000, (epoch_us(ts) // 300000000 + 1) * 300000000 + {size}, 300000000)) AS wend FROM u)
    WHERE wend <= (SELECT epoch_us(max(ts)) - 600000000 FROM u) GROUP BY endpoint_id, wend"""


@query("stream_live_aggs", f"{RAW} {LIVE.format(label='1h', size=3600 * 1_000_000, more='')}")
def stream_live_aggs(spark, sf_dir):
    live = run.drain(pred.live_aggregates(_rows(spark, sf_dir), "1h", lateness="10m"), "live-1h")
    return live.withColumn("latency_avg_1h", money("latency_avg_1h", 6))


@query(
    "stream_rate",
    f"{RAW} {LIVE.format(label='5m', size=300 * 1_000_000, more=', round(count(latency) / 300, 9) AS predictions_per_second')}",
)
def stream_rate(spark, sf_dir):
    live = run.drain(pred.with_rate(pred.live_aggregates(_rows(spark, sf_dir), "5m", lateness="10m")), "live-5m")
    return live.withColumns({"latency_avg_5m": money("latency_avg_5m", 6), "predictions_per_second": money("predictions_per_second", 9)})


@query(
    "stream_three_records",
    f"""{RAW} SELECT 'base_metrics' AS record_type, ts AS timestamp, endpoint_id, 'latency' AS name, latency::DOUBLE AS value FROM u
    UNION ALL SELECT 'endpoint_features', ts, endpoint_id, 'f0', f0 FROM u
    UNION ALL SELECT 'endpoint_features', ts, endpoint_id, 'f1', k FROM u
    UNION ALL SELECT 'endpoint_features', ts, endpoint_id, 'p0', CASE WHEN value > 20 THEN 1 ELSE 0 END FROM u
    UNION ALL SELECT 'custom_metrics', ts, endpoint_id, 'm-1', value FROM u WHERE event_id % 5 = 1""",
)
def stream_three_records(spark, sf_dir):
    records = pred.three_records(pred.map_names(_rows(spark, sf_dir)), ["latency"])
    return run.drain(records.select("record_type", "timestamp", "endpoint_id", F.explode("fields").alias("name", "value")), "records")


@query(
    "stream_to_parquet",
    f"""{RAW} SELECT endpoint_id AS key, year(ts)::INT AS year, month(ts)::INT AS month, day(ts)::INT AS day, hour(ts)::INT AS hour, count(*) AS n, round(sum(f0), 2) AS total
    FROM u GROUP BY ALL""",
)
def stream_to_parquet(spark, sf_dir):
    """The log of all models, partitioned by endpoint and time down to the hour."""
    log = pred.log_rows(_rows(spark, sf_dir)).withColumn("f0", F.col("features")[0]).select("timestamp", "f0", *pred.LOG_PARTITIONS)
    written = run.drain(log, "log", partition_by=pred.LOG_PARTITIONS)
    return written.groupBy(*pred.LOG_PARTITIONS).agg(F.count(F.lit(1)).alias("n"), money(F.sum("f0")).alias("total"))


@query(
    "stream_log_compacted",
    f"""{RAW} SELECT endpoint_id AS key, year(ts)::INT AS year, month(ts)::INT AS month, day(ts)::INT AS day, count(*) AS n, round(sum(f0), 2) AS total
    FROM u GROUP BY ALL""",
)
def stream_log_compacted(spark, sf_dir):
    """The log by endpoint and day: three resumed runs append to it, and each merges its small files."""
    by = ["key", "year", "month", "day"]

    def go(stream, base):
        good, _ = pred.split_errors(pred.with_endpoint_id(raw_events(stream)))
        rows = pred.log_rows(pred.unpack(good)).withColumn("f0", F.col("features")[0]).select("timestamp", "f0", *by)
        return run.drain_log(rows, "log-compacted", by, base=base)

    return _arrivals(spark, sf_dir, go).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), money(F.sum("f0")).alias("total"))


def _totals(_key, rows: pd.DataFrame, state):
    """Running count per user; every row carries the count so far."""
    seen = state[0] + pd.Series(range(1, len(rows) + 1), index=rows.index)
    out = rows[["user_id", "event_id"]].assign(seen=seen.astype("int64"))
    return out, (state[0] + len(rows),)


STATE_SQL = "SELECT user_id, count(*) AS events, count(*) AS newest, (count(*) * (count(*) + 1) / 2)::BIGINT AS check_sum FROM events GROUP BY 1"


def _with_state(spark, sf_dir):
    """State is carried over three runs."""

    def go(stream, base):
        out = stateful.map_with_state(
            stream.select("user_id", "event_id"), ["user_id"], _totals,
            "user_id long, event_id long, seen long", "seen long", (0,),
        )
        return run.drain(out, "state", base=base)

    written = _arrivals(spark, sf_dir, go)
    return written.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("events"), F.max("seen").alias("newest"), F.sum("seen").alias("check_sum")
    )


@query("stream_map_with_state", STATE_SQL)
def stream_map_with_state(spark, sf_dir):
    return _with_state(spark, sf_dir)


@query("udf_stateful", "SELECT user_id, ceil(count(*) / 10)::BIGINT AS kept FROM events GROUP BY 1")
def udf_stateful(spark, sf_dir):
    """Every tenth row per key, counted by state in arrival order."""


    def go(stream, base):
        return run.drain(stateful.sample_every(stream.select("user_id", "event_id"), ["user_id"], 10), "sampled", base=base)

    kept = _arrivals(spark, sf_dir, go)
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("kept"))


@query(
    "stream_window_late",
    f"""WITH a AS ({ARRIVAL}), marks AS (SELECT part, max(max(ts)) OVER (ORDER BY part) - INTERVAL 30 MINUTE AS mark FROM a GROUP BY part),
      kept AS (SELECT a.* FROM a LEFT JOIN marks m ON m.part = a.part - 1 WHERE m.mark IS NULL OR {end_sql('ts', 3600)} > m.mark)
    SELECT event_type, make_timestamp(epoch_us(ts) // 3600000000 * 3600000000) AS window_start, {end_sql('ts', 3600)} AS window_end,
      count(*) AS n, round(sum(value), 2) AS total FROM kept
    WHERE {end_sql('ts', 3600)} <= (SELECT max(mark) FROM marks)
    GROUP BY event_type, epoch_us(ts) // 3600000000, {end_sql('ts', 3600)}""",
)
def stream_window_late(spark, sf_dir):
    """Three runs; events that come after their window was closed are dropped."""

    def go(stream, base):
        return run.drain(stateful.late_windows(stream, ["event_type"], "ts", "1h", None, "30m", "value"), "late", base=base)

    return _arrivals(spark, sf_dir, go).withColumn("total", money("total"))


@query(
    "stream_latest",
    "SELECT user_id, event_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
)
def stream_latest(spark, sf_dir):
    """Streaming form of the key-value target: every batch is merged into the latest table."""

    def go(stream, base):
        rows = stream.select("user_id", "event_id", "event_type", "ts")
        return run.drain_buckets(rows, "latest", "append", ["user_id"], run.keep_latest(["user_id"], "ts"), 16, base)

    return _arrivals(spark, sf_dir, go)


@query("stream_merge_by_key", "SELECT user_id, count(*) // 4 AS merged FROM events GROUP BY 1 HAVING count(*) >= 4")
def stream_merge_by_key(spark, sf_dir):
    stream = _stream(spark, sf_dir).select("user_id", "event_id", "ts")
    merged = run.drain(stateful.merge_parts(stream, "user_id", "event_id", 4, "ts", "10m"), "merged")
    return merged.groupBy("user_id").agg(F.count(F.lit(1)).alias("merged"))


@query("stream_enrich", "SELECT event_id, n, biggest FROM events JOIN (SELECT user_id, count(*) AS n, max(value) AS biggest FROM events GROUP BY 1) USING (user_id)")
def stream_enrich(spark, sf_dir):
    profile = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("biggest"))
    enriched = stateful.enrich(_stream(spark, sf_dir), profile, ["user_id"])
    return run.drain(enriched.select("event_id", "n", "biggest"), "enriched")


@query("step_foreach", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def step_foreach(spark, sf_dir):
    """Side effect per micro-batch (a batch summary is appended), rows pass on unchanged."""
    from tidemark.session import fresh_path

    base = fresh_path(spark, "foreach")

    def note(batch, batch_id):
        summary = batch.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
        summary.write.mode("overwrite").parquet(f"{base}/notes/batch={batch_id}")

    run.for_each(_stream(spark, sf_dir), note, f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/notes").groupBy("event_type").agg(F.sum("n").alias("n"))


def _in_order(spark, sf_dir, go):
    """``go(stream, base)`` after each of three parts of time has arrived, none of them late."""
    events = table(spark, sf_dir, "events")
    low, high = events.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    part = F.floor((F.unix_micros("ts") - F.lit(low)) * 3 / F.lit(high - low + 1))
    base, out = fresh_path(spark, "in-order"), None
    for i in range(3):
        events.where(part == i).write.mode("append").parquet(f"{base}/in")
        out = go(stream_files(spark, f"{base}/in", events.schema), f"{base}/run")
    return out


def _spent(_key, rows: pd.DataFrame, state):
    """Orders so far and the newest event of a customer; both go on from the seed."""
    seen = np.arange(state[0] + 1, state[0] + len(rows) + 1)
    out = pd.DataFrame({"user_id": rows["user_id"], "event_id": rows["event_id"], "seen": seen, "before": state[1]})
    return out, (state[0] + len(rows), int(rows["event_id"].iloc[-1]))


@query(
    "stream_map_with_table",
    f"""WITH a AS ({ARRIVAL}), seed AS (SELECT c_custkey AS user_id, c_custkey % 7 AS seen, -c_custkey AS newest FROM customer WHERE c_custkey % 3 <> 0),
      last AS (SELECT user_id, part, arg_max(event_id, (ts, event_id)) AS newest FROM a GROUP BY 1, 2)
    SELECT a.user_id, a.event_id, coalesce(seed.seen, 0) + row_number() OVER (PARTITION BY a.user_id ORDER BY a.part, a.ts, a.event_id) AS seen,
      coalesce((SELECT arg_max(l.newest, l.part) FROM last l WHERE l.user_id = a.user_id AND l.part < a.part), seed.newest, 0) AS before
    FROM a LEFT JOIN seed USING (user_id)""",
)
def stream_map_with_table(spark, sf_dir):
    """State that starts from a table and is carried over three runs; every emitted row is compared."""
    customers = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0")
    seed = customers.selectExpr("c_custkey AS user_id", "c_custkey % 7 AS seen", "-c_custkey AS newest")

    def go(stream, base):
        out = processors.map_with_table(
            stream.select("user_id", "event_id", "ts"), ["user_id"], _spent, "user_id long, event_id long, seen long, before long",
            "seen long, newest long", (0, 0), seed, ["ts", "event_id"],
        )
        with processors.state_store(spark):
            return run.drain(out, "seeded", base=base)

    return _arrivals(spark, sf_dir, go)


@query(
    "stream_value_counts",
    f"SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY part, ts, event_id) AS seen FROM ({ARRIVAL})",
)
def stream_value_counts(spark, sf_dir):
    """Map state: how often a user has shown the kind of each event, over three runs."""

    def go(stream, base):
        rows = stream.select("user_id", "event_id", "event_type", "ts")
        counted = processors.count_values(rows, ["user_id"], "event_type", "seen", ["ts", "event_id"])
        with processors.state_store(spark):
            return run.drain(counted, "counted", base=base)

    return _arrivals(spark, sf_dir, go).drop("ts")


@query(
    "stream_batch_timeout",
    f"""{BATCHED}, g AS (SELECT user_id, batch, count(*) AS n, min(ts) AS first_time, max(stop) AS stop FROM r GROUP BY 1, 2)
    SELECT r.user_id, event_id, batch, CASE WHEN n = 10 THEN 'count' ELSE 'time' END AS closed_by FROM r JOIN g USING (user_id, batch)
    WHERE n = 10 OR g.stop IS NOT NULL OR first_time + INTERVAL 5 DAYS <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES""",
)
def stream_batch_timeout(spark, sf_dir):
    """Ten events of a user or five days, over three runs: list state and a timer; open batches stay in state."""

    def go(stream, base):
        rows = stream.select("user_id", "event_id", "ts")
        batched = processors.batch_rows(rows, ["user_id"], 10, "5d", "ts", "10m", ["event_id"])
        with processors.state_store(spark):
            return run.drain(batched, "batched", base=base)

    return _in_order(spark, sf_dir, go).drop("ts")


@query(
    "stream_late_counts",
    f"""WITH a AS ({ARRIVAL}), m AS (SELECT user_id, part, max(ts) AS newest FROM a GROUP BY 1, 2),
      k AS (SELECT user_id, part, max(newest) OVER (PARTITION BY user_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m)
    SELECT a.user_id, count(*) AS n, count(*) FILTER (a.ts < k.before) AS late FROM a JOIN k ON a.user_id = k.user_id AND a.part = k.part GROUP BY a.user_id, a.part""",
)
def stream_late_counts(spark, sf_dir):
    """Streaming form of the out-of-order check: rows of a run older than what earlier runs brought."""

    def go(stream, base):
        return run.drain(stateful.late_per_batch(stream.select("user_id", "ts"), ["user_id"], "ts"), "late", base=base)

    return _arrivals(spark, sf_dir, go)


@query(
    "stream_validate",
    """SELECT 'value' AS feature, count(*)::BIGINT AS violations, min(value::VARCHAR) AS example FROM events WHERE value IS NULL OR value < 1 OR value > 90
    UNION ALL SELECT 'event_type', count(*), min(event_type) FROM events WHERE event_type IS NULL OR NOT regexp_full_match(event_type, 'click|view')""",
)
def stream_validate(spark, sf_dir):
    """Violations observed per micro-batch of the event stream, summed up."""
    checks = {"value": validate.MinMax(low=1, high=90), "event_type": validate.Regex(pattern="click|view")}
    _, reports = drain_validated(_stream(spark, sf_dir), checks, "validated")
    return reports.groupBy("feature").agg(F.sum("violations").alias("violations"), F.min("example").alias("example"))
