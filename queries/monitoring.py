"""Drift, intervals, applications, results, series reads and alerts over the event log.

An endpoint is an event type, its features are ``value`` and ``k`` of the properties.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import alerts, drift, monitoring, series, stats
from tidemark.plans.monitor import drift_job, reference_counts

from .base import money, query, table

CUT = "2024-01-16"


def _log(spark, sf_dir):
    """Prediction log: endpoint_id, timestamp, value, k."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("endpoint_id"),
        F.col("ts").alias("timestamp"),
        "value",
        F.from_json("props", "k double")["k"].alias("k"),
    )


def _halves(log):
    cut = F.lit(CUT).cast("timestamp")
    return log.where(F.col("timestamp") < cut), log.where(F.col("timestamp") >= cut)


def _edges_by_endpoint(log, columns):
    return stats.edges_by_group(log, ["endpoint_id"], columns, padded=True)


def _features(spark, sf_dir):
    reference, sample = _halves(_log(spark, sf_dir))
    columns = ["value", "k"]
    edges = _edges_by_endpoint(reference, columns)

    def counts(part):
        hist = drift.histogram_per_group(part.drop("timestamp"), ["endpoint_id"], edges, ["endpoint_id"])
        return drift.counts_array(hist, ["endpoint_id"])

    return drift.per_feature(counts(sample), counts(reference), ["endpoint_id"], ["endpoint_id"]).drop("total")


DRIFT_CTE = f"""WITH x AS (SELECT event_type AS endpoint_id, 'value' AS feature, value AS x, ts FROM events
        UNION ALL SELECT event_type, 'k', (props::JSON ->> 'k')::DOUBLE, ts FROM events),
      e AS (SELECT endpoint_id, feature, min(x) AS mn, max(x) AS mx FROM x WHERE ts < TIMESTAMP '{CUT}' GROUP BY 1, 2),
      b AS (SELECT endpoint_id, feature, ts < TIMESTAMP '{CUT}' AS ref, CASE WHEN x < mn THEN 0 WHEN x > mx THEN 21
        ELSE least(floor((x - mn) / ((mx - mn) / 20))::INT, 19) + 1 END AS bin FROM x JOIN e USING (endpoint_id, feature)),
      n AS (SELECT endpoint_id, feature, bin, count(*) FILTER (WHERE NOT ref) AS cp, count(*) FILTER (WHERE ref) AS cq FROM b GROUP BY 1, 2, 3),
      g AS (SELECT endpoint_id, feature, unnest(range(22))::INT AS bin FROM e),
      pq AS (SELECT endpoint_id, feature, bin, coalesce(cp, 0) / sum(cp) OVER w AS p, coalesce(cq, 0) / sum(cq) OVER w AS q
        FROM g LEFT JOIN n USING (endpoint_id, feature, bin) WINDOW w AS (PARTITION BY endpoint_id, feature)),
      f AS (SELECT endpoint_id, feature AS "column", sum(abs(p - q)) / 2 AS tvd, sqrt(greatest(1 - sum(sqrt(p * q)), 0)) AS hellinger,
        sum(CASE WHEN p = 0 THEN 0 ELSE p * ln(p / CASE WHEN q = 0 THEN 1e-4 ELSE q END) END)
        + sum(CASE WHEN q = 0 THEN 0 ELSE q * ln(q / CASE WHEN p = 0 THEN 1e-4 ELSE p END) END) AS kld FROM pq GROUP BY 1, 2)"""


def _metric(name):
    @query(f"drift_{name}", f'{DRIFT_CTE} SELECT endpoint_id, "column", round({name}, 6) AS {name} FROM f')
    def one(spark, sf_dir):
        return _features(spark, sf_dir).select("endpoint_id", "column", money(name, 6).alias(name))


for _name in drift.METRICS:
    _metric(_name)


@query("drift_normalize", f'{DRIFT_CTE} SELECT endpoint_id, feature AS "column", bin, round(p, 9) AS share FROM pq')
def drift_normalize(spark, sf_dir):
    reference, sample = _halves(_log(spark, sf_dir))
    edges = _edges_by_endpoint(reference, ["value", "k"])
    hist = drift.histogram_per_group(sample.drop("timestamp"), ["endpoint_id"], edges, ["endpoint_id"])
    shares = drift.normalize(drift.counts_array(hist, ["endpoint_id"]))
    return shares.select("endpoint_id", "column", F.posexplode("p").alias("bin", "share")).withColumn("share", money("share", 9))


@query(
    "drift_per_feature",
    f'{DRIFT_CTE} SELECT endpoint_id, "column", round(tvd, 6) AS tvd, round(hellinger, 6) AS hellinger, round(kld, 6) AS kld FROM f',
)
def drift_per_feature(spark, sf_dir):
    return _features(spark, sf_dir).withColumns({m: money(m, 6) for m in drift.METRICS})


GENERAL = """SELECT endpoint_id, round(avg(tvd), 6) AS tvd_mean, round(avg(hellinger), 6) AS hellinger_mean, round(avg(kld), 6) AS kld_mean,
      round((avg(tvd) + avg(hellinger)) / 2, 6) AS general_drift, CASE WHEN (avg(tvd) + avg(hellinger)) / 2 >= {d} THEN 2
        WHEN (avg(tvd) + avg(hellinger)) / 2 >= {p} THEN 1 ELSE 0 END::INT AS status FROM f GROUP BY 1"""


@query("drift_general", f"{DRIFT_CTE} {GENERAL.format(d=0.7, p=0.5)}")
def drift_general(spark, sf_dir):
    out = drift.general(_features(spark, sf_dir), ["endpoint_id"])
    return out.withColumns({c: money(c, 6) for c in ("tvd_mean", "hellinger_mean", "kld_mean", "general_drift")})


@query(
    "drift_classify",
    """SELECT p_partkey, round((p_size - 1) / 49, 6) AS value, CASE WHEN (p_size - 1) / 49 >= 0.7 THEN 2
      WHEN (p_size - 1) / 49 >= 0.5 THEN 1 ELSE 0 END::INT AS status FROM part""",
)
def drift_classify(spark, sf_dir):
    value = (F.col("p_size") - 1) / 49
    return table(spark, sf_dir, "part").select("p_partkey", money(value, 6).alias("value"), drift.classify(value).alias("status"))


@query(
    "drift_table",
    f"""{DRIFT_CTE}, s AS (SELECT endpoint_id, feature AS "column", avg(x) FILTER (WHERE ts < TIMESTAMP '{CUT}') AS sm, min(x) FILTER (WHERE ts < TIMESTAMP '{CUT}') AS si,
        max(x) FILTER (WHERE ts < TIMESTAMP '{CUT}') AS sx, avg(x) FILTER (WHERE ts >= TIMESTAMP '{CUT}') AS im,
        min(x) FILTER (WHERE ts >= TIMESTAMP '{CUT}') AS ii, max(x) FILTER (WHERE ts >= TIMESTAMP '{CUT}') AS ix FROM x GROUP BY ALL)
    SELECT endpoint_id, "column", round(tvd, 6) AS tvd, round(hellinger, 6) AS hellinger, round(kld, 6) AS kld, round(sm, 6) AS sample_mean, si AS sample_min,
      sx AS sample_max, round(im, 6) AS input_mean, ii AS input_min, ix AS input_max,
      CASE WHEN (tvd + hellinger) / 2 >= 0.1 THEN 2 WHEN (tvd + hellinger) / 2 >= 0.05 THEN 1 ELSE 0 END::INT AS status
    FROM f JOIN s USING (endpoint_id, "column")""",
)
def drift_table(spark, sf_dir):
    reference, sample = _halves(_log(spark, sf_dir))
    out = drift.drift_table(
        stats.describe_groups(reference, ["endpoint_id"], ["value", "k"]),
        stats.describe_groups(sample, ["endpoint_id"], ["value", "k"]),
        _features(spark, sf_dir), potential=0.05, detected=0.1, groups=["endpoint_id"],
    )
    return out.withColumns({c: money(c, 6) for c in (*drift.METRICS, "sample_mean", "input_mean")})


@query(
    "sample_set_stats",
    """SELECT 'c_acctbal' AS "column", count(*) AS count, round(avg(c_acctbal), 4) AS mean, min(c_acctbal) AS min, max(c_acctbal) AS max FROM customer
    UNION ALL SELECT 'c_nationkey', count(*), round(avg(c_nationkey), 4), min(c_nationkey), max(c_nationkey) FROM customer
    UNION ALL SELECT 'label', count(*), 1.0, 1.0, 1.0 FROM customer""",
)
def sample_set_stats(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    out = monitoring.sample_set_stats(customer, ["c_custkey"], ["label"], {"label": 1})
    return out.select("column", "count", money("mean", 4).alias("mean"), "min", "max")


def _endpoints(log):
    return log.groupBy("endpoint_id").agg(
        F.min("timestamp").alias("first_request"), F.max("timestamp").alias("last_request")
    ).withColumns({
        "application": F.lit("drift"),
        "last_analyzed": F.when(F.col("endpoint_id") == "view", F.unix_seconds(F.lit("2024-01-20 00:00:07").cast("timestamp"))),
        "active": F.col("endpoint_id") != "signup",
        "is_router": F.col("endpoint_id") == "click",
    })


STEP = 4 * 3600
BOUNDS = f"""WITH e AS (SELECT event_type AS endpoint_id, epoch_us(min(ts)) // 1000000 AS first, epoch_us(max(ts)) // 1000000 - 60 AS stop FROM events GROUP BY 1),
      b AS (SELECT endpoint_id, stop, CASE WHEN endpoint_id = 'view' THEN epoch_us(TIMESTAMP '2024-01-20 00:00:07') // 1000000
        ELSE greatest(first, stop - 86400) END AS start FROM e)"""


@query(
    "batch_intervals",
    f"""{BOUNDS} SELECT endpoint_id, 'drift' AS application, make_timestamp(s * 1000000) AS start_time, make_timestamp((s + {STEP}) * 1000000) AS end_time
    FROM (SELECT endpoint_id, unnest(range(start, stop - {STEP} + 1, {STEP})) AS s FROM b)""",
)
def batch_intervals(spark, sf_dir):
    out = monitoring.batch_intervals(_endpoints(_log(spark, sf_dir)), STEP, grace=60)
    return out.select("endpoint_id", "application", "start_time", "end_time")


@query(
    "batch_last_analyzed",
    f"""{BOUNDS} SELECT endpoint_id, start + (stop - start) // {STEP} * {STEP} AS last_analyzed FROM b""",
)
def batch_last_analyzed(spark, sf_dir):
    return monitoring.last_analyzed(_endpoints(_log(spark, sf_dir)), STEP, grace=60).select("endpoint_id", "last_analyzed")


@query(
    "batch_window_select",
    f"""{BOUNDS}, i AS (SELECT endpoint_id, make_timestamp(s * 1000000) AS start_time, make_timestamp((s + {STEP}) * 1000000) AS end_time
        FROM (SELECT endpoint_id, unnest(range(start, stop - {STEP} + 1, {STEP})) AS s FROM b))
    SELECT i.endpoint_id, start_time, end_time, ts AS timestamp, value FROM i JOIN events ON event_type = i.endpoint_id AND ts > start_time AND ts <= end_time
    WHERE i.endpoint_id NOT IN ('signup', 'click')""",
)
def batch_window_select(spark, sf_dir):
    log = _log(spark, sf_dir)
    rows = monitoring.select_windows(log, _endpoints(log), STEP, grace=60)
    return rows.select("endpoint_id", "start_time", "end_time", "timestamp", "value")


@query(
    "record_results",
    """SELECT o_orderkey, o_totalprice, 'batch-model' AS endpoint_id, CASE WHEN o_orderstatus = 'P' THEN TIMESTAMP '2024-01-01' ELSE o_orderdate END AS timestamp FROM orders""",
)
def record_results(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("when")
    )
    return monitoring.record_rows(rows, "batch-model", "when", "2024-01-01 00:00:00").drop("when")


def _windows(spark, sf_dir):
    day = F.date_trunc("day", "timestamp")
    return _log(spark, sf_dir).withColumn("window_start", day).drop("timestamp")


def _shift(key, features: pd.DataFrame) -> pd.DataFrame:
    """A user application: mean shift of each feature and how many rows fell into the first bin."""
    return pd.DataFrame(
        {
            "name": features["column"] + "_shift",
            "value": (features["mean"] - 50).round(6),
            "low": [int(h[0]) for h in features["hist"]],
        }
    )


@query(
    "custom_app",
    """SELECT event_type AS endpoint_id, date_trunc('day', ts) AS window_start, 'k_shift' AS name, round(avg((props::JSON ->> 'k')::DOUBLE) - 50, 6) AS value,
      count(*) FILTER (WHERE (props::JSON ->> 'k')::DOUBLE < 50) AS low FROM events GROUP BY 1, 2
    UNION ALL SELECT event_type, date_trunc('day', ts), 'value_shift', round(avg(value) - 50, 6), count(*) FILTER (WHERE value < 25) FROM events GROUP BY 1, 2""",
)
def custom_app(spark, sf_dir):
    edges = {"value": [0.0, 25.0, 50.0, 1000.0], "k": [0.0, 50.0, 100.0]}
    out = monitoring.run_app(
        _windows(spark, sf_dir), ["endpoint_id", "window_start"], edges, _shift, "name string, value double, low long"
    )
    return out.withColumn("value", money("value", 6))


@query(
    "udf_app",
    """SELECT event_type AS endpoint_id, date_trunc('day', ts) AS window_start, 'rows' AS name, count(value)::DOUBLE AS value FROM events GROUP BY 1, 2""",
)
def udf_app(spark, sf_dir):
    """An application returning one metric per window."""

    def tracking(key, features):
        return pd.DataFrame({"name": ["rows"], "value": [float(features["count"].max())]})

    return monitoring.run_app(
        _windows(spark, sf_dir).drop("k"), ["endpoint_id", "window_start"], {"value": [0.0, 10.0, 1000.0]}, tracking, "name string, value double"
    )


def _results(spark, sf_dir):
    """Daily result per endpoint: mean value scaled to [0, 1], with its status."""
    value = F.least(F.round(F.avg("value") / 30, 4), F.lit(1.0))
    day = F.date_trunc("day", "timestamp")
    rows = _log(spark, sf_dir).groupBy("endpoint_id", day.alias("start_infer_time")).agg(value.alias("result_value"))
    return rows.select(
        "endpoint_id",
        F.lit("drift_app").alias("application_name"),
        "start_infer_time",
        (F.col("start_infer_time") + F.expr("INTERVAL 1 DAY")).alias("end_infer_time"),
        F.lit("general_drift").alias("result_name"),
        "result_value",
        F.lit(0).alias("result_kind"),
        drift.classify(F.col("result_value"), 0.6, 0.7).alias("result_status"),
    )


RESULTS = """(SELECT event_type AS endpoint_id, 'drift_app' AS application_name, date_trunc('day', ts) AS start_infer_time,
      date_trunc('day', ts) + INTERVAL 1 DAY AS end_infer_time, 'general_drift' AS result_name, least(round(avg(value) / 30, 4), 1.0) AS result_value,
      0 AS result_kind, CASE WHEN least(round(avg(value) / 30, 4), 1.0) >= 0.7 THEN 2 WHEN least(round(avg(value) / 30, 4), 1.0) >= 0.6 THEN 1 ELSE 0 END::INT AS result_status
    FROM events GROUP BY event_type, date_trunc('day', ts))"""


def _metrics(spark, sf_dir):
    """Daily metrics per endpoint: mean and max latency."""
    day = F.date_trunc("day", "timestamp")
    rows = _log(spark, sf_dir).groupBy("endpoint_id", day.alias("start_infer_time")).agg(
        F.round(F.avg("value"), 6).alias("mean-latency"), F.max("value").alias("max-latency")
    )
    long = rows.unpivot(["endpoint_id", "start_infer_time"], ["mean-latency", "max-latency"], "metric_name", "metric_value")
    return long.withColumns({
        "application_name": F.lit("latency_app"),
        "end_infer_time": F.col("start_infer_time") + F.expr("INTERVAL 1 DAY"),
    })


METRICS = """(SELECT event_type AS endpoint_id, 'latency_app' AS application_name, date_trunc('day', ts) + INTERVAL 1 DAY AS end_infer_time,
      m AS metric_name, CASE m WHEN 'mean-latency' THEN round(avg(value), 6) ELSE max(value) END AS metric_value
    FROM events, (SELECT unnest(['mean-latency', 'max-latency']) AS m) GROUP BY event_type, date_trunc('day', ts), m)"""


def _event_json(spark, sf_dir):
    fields = ["result_name", "result_value", "result_kind", "result_status"]
    results = _results(spark, sf_dir)
    broken = F.when(F.dayofmonth("start_infer_time") == 13, F.lit(None)).otherwise(F.col("result_name"))
    data = F.to_json(F.struct(broken.alias("result_name"), *fields[1:]))
    kind = F.when(F.dayofmonth("start_infer_time") % 2 == 0, F.lit("result"))
    return results.select(*monitoring.BASE_FIELDS, kind.alias("event_kind"), data.alias("data"))


@query(
    "results_normalize",
    f"""SELECT endpoint_id, application_name, end_infer_time, CASE WHEN day(start_infer_time) <> 13 THEN result_name END AS result_name,
      CASE WHEN day(start_infer_time) <> 13 THEN result_value END AS result_value, day(start_infer_time) = 13 AS bad FROM {RESULTS}""",
)
def results_normalize(spark, sf_dir):
    good, _, bad = monitoring.normalize_results(_event_json(spark, sf_dir))
    columns = ["endpoint_id", "application_name", "end_infer_time"]
    return good.select(*columns, "result_name", "result_value", F.lit(False).alias("bad")).unionByName(
        bad.select(*columns, F.lit(True).alias("bad")), allowMissingColumns=True
    )


@query(
    "results_alert_kind",
    f"""SELECT CASE result_status WHEN 2 THEN 'data_drift_detected' ELSE 'data_drift_suspected' END AS event_kind,
      endpoint_id || '.drift_app.result.general_drift' AS entity, end_infer_time AS time, result_value FROM {RESULTS} WHERE result_status > 0""",
)
def results_alert_kind(spark, sf_dir):
    return monitoring.alert_events(_results(spark, sf_dir))


@query(
    "ts_realtime_metrics",
    """SELECT m AS metric, ts AS time, CASE m WHEN 'value' THEN value ELSE (props::JSON ->> 'k')::DOUBLE END AS value
    FROM events, (SELECT unnest(['value', 'k']) AS m) WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-12'""",
)
def ts_realtime_metrics(spark, sf_dir):
    return series.realtime_metrics(
        _log(spark, sf_dir), "view", ["value", "k"], "timestamp", "2024-01-10", "2024-01-12"
    )


@query(
    "ts_read_metrics",
    f"""SELECT application_name, metric_name AS name, end_infer_time AS time, metric_value AS value, true AS data FROM {METRICS}
    WHERE endpoint_id = 'view' AND end_infer_time >= TIMESTAMP '2024-01-05' AND end_infer_time <= TIMESTAMP '2024-01-15'
    UNION ALL SELECT 'latency_app', 'absent', NULL, NULL, false""",
)
def ts_read_metrics(spark, sf_dir):
    pairs = [("latency_app", n) for n in ("mean-latency", "max-latency", "absent")]
    return series.read_series(
        _metrics(spark, sf_dir), "view", pairs, "metric_name", "metric_value", "2024-01-05", "2024-01-15"
    )


@query(
    "ts_read_results",
    f"""SELECT application_name, result_name AS name, end_infer_time AS time, result_value AS value, result_kind, result_status, true AS data FROM {RESULTS}
    WHERE endpoint_id = 'error'""",
)
def ts_read_results(spark, sf_dir):
    return series.read_series(
        _results(spark, sf_dir), "error", [("drift_app", "general_drift")], "result_name", "result_value",
        kind_column="result_kind", status_column="result_status",
    )


def _predictions(spark, sf_dir):
    return _log(spark, sf_dir).select("endpoint_id", F.col("timestamp").alias("time"), F.col("value").alias("latency"))


@query(
    "ts_read_predictions",
    """SELECT make_timestamp(epoch_us(ts) // 21600000000 * 21600000000) AS time, round(avg(value), 6) AS value FROM events
    WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-20' GROUP BY 1""",
)
def ts_read_predictions(spark, sf_dir):
    out = series.read_predictions(_predictions(spark, sf_dir), "click", "2024-01-03", "2024-01-20", "avg", "6h")
    return out.withColumn("value", money("value", 6))


@query(
    "ts_last_request",
    "SELECT event_type AS endpoint_id, max(ts) AS last_request, arg_max(value, ts) AS last_latency FROM events GROUP BY 1",
)
def ts_last_request(spark, sf_dir):
    return series.last_request(_predictions(spark, sf_dir))


@query(
    "ts_drift_status",
    f"""SELECT endpoint_id, max(result_status) AS result_status FROM {RESULTS}
    WHERE end_infer_time >= TIMESTAMP '2024-01-10' AND end_infer_time <= TIMESTAMP '2024-01-11' GROUP BY 1""",
)
def ts_drift_status(spark, sf_dir):
    import datetime as dt

    return series.drift_status(_results(spark, sf_dir), now=dt.datetime(2024, 1, 11, tzinfo=dt.timezone.utc))


@query("ts_metrics_metadata", f"SELECT DISTINCT endpoint_id, application_name, metric_name FROM {METRICS}")
def ts_metrics_metadata(spark, sf_dir):
    return series.metrics_metadata(_metrics(spark, sf_dir))


@query("ts_results_metadata", f"SELECT DISTINCT endpoint_id, application_name, result_name, result_kind FROM {RESULTS}")
def ts_results_metadata(spark, sf_dir):
    return series.results_metadata(_results(spark, sf_dir))


@query(
    "ts_error_count",
    """SELECT 'user-' || (user_id % 20) AS endpoint_id, count(*) AS error_count FROM events
    WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-02' AND ts <= TIMESTAMP '2024-01-09' GROUP BY 1""",
)
def ts_error_count(spark, sf_dir):
    errors = table(spark, sf_dir, "events").where("event_type = 'error'").select(
        F.concat(F.lit("user-"), (F.col("user_id") % 20).cast("string")).alias("endpoint_id"), "ts", F.col("props").alias("model_error")
    )
    return series.error_count(errors, "ts", "2024-01-02", "2024-01-09")


@query(
    "ts_avg_latency",
    """SELECT event_type AS endpoint_id, round(avg(value), 6) AS avg_latency FROM events WHERE ts >= TIMESTAMP '2024-01-02' GROUP BY 1""",
)
def ts_avg_latency(spark, sf_dir):
    return series.avg_latency(_predictions(spark, sf_dir), "2024-01-02").withColumn("avg_latency", money("avg_latency", 6))


def _error_events(spark, sf_dir):
    """Errors matched to alerts: one alert per listed user, and one for all users."""
    events = table(spark, sf_dir, "events")
    errors = events.where("event_type = 'error'").select(
        F.col("event_type").alias("event_kind"), F.col("user_id").cast("string").alias("entity"), "ts", "event_id"
    )
    users = events.select(F.col("user_id").cast("string").alias("u")).distinct()
    each = users.select(
        F.concat(F.lit("user-"), "u").alias("alert"), F.lit("error").alias("event_kind"), F.array("u").alias("entities")
    )
    everyone = spark.range(1).select(
        F.lit("all").alias("alert"), F.lit("error").alias("event_kind"), F.array(F.lit("*")).alias("entities")
    )
    return alerts.match_alerts(errors, each.unionByName(everyone)).drop("entity")


ALERTS = """WITH a AS (SELECT 'user-' || user_id AS alert, event_type AS event_kind, ts, event_id FROM events WHERE event_type = 'error'
        UNION ALL SELECT 'all', event_type, ts, event_id FROM events WHERE event_type = 'error'),
      p AS (SELECT *, row_number() OVER w AS pos, lag(ts, 4) OVER w AS earlier FROM a WINDOW w AS (PARTITION BY alert ORDER BY ts, event_id)),
      c AS (SELECT * FROM p WHERE epoch_us(ts) - epoch_us(earlier) < 3 * 86400000000)"""


@query("alert_window", f"{ALERTS} SELECT alert, event_kind, ts, event_id FROM c")
def alert_window(spark, sf_dir):
    return alerts.fire(_error_events(spark, sf_dir), ["alert"], "ts", "event_id", 5, "3d")


@query(
    "alert_window_manual",
    f"{ALERTS} SELECT alert, event_kind, ts, event_id FROM c QUALIFY row_number() OVER (PARTITION BY alert ORDER BY pos) = 1",
)
def alert_window_manual(spark, sf_dir):
    return alerts.fire(_error_events(spark, sf_dir), ["alert"], "ts", "event_id", 5, "3d", "manual")


@query(
    "alert_window_auto",
    ALERTS.replace("WITH a AS", "WITH RECURSIVE a AS") + """,
      nxt AS (SELECT x.alert, x.pos, min(y.pos) AS after FROM c x JOIN c y ON y.alert = x.alert AND y.pos >= x.pos + 5 GROUP BY 1, 2),
      r AS (SELECT alert, min(pos) AS pos FROM c GROUP BY 1 UNION ALL SELECT r.alert, nxt.after FROM r JOIN nxt ON nxt.alert = r.alert AND nxt.pos = r.pos)
    SELECT alert, event_kind, ts, event_id FROM c JOIN r USING (alert, pos)""",
)
def alert_window_auto(spark, sf_dir):
    return alerts.fire(_error_events(spark, sf_dir), ["alert"], "ts", "event_id", 5, "3d", "auto")


@query(
    "monitoring_job",
    f"""{BOUNDS}, i AS (SELECT endpoint_id, s AS start, make_timestamp(s * 1000000) AS start_time, make_timestamp((s + {STEP}) * 1000000) AS end_time
        FROM (SELECT endpoint_id, unnest(range(start, stop - {STEP} + 1, {STEP})) AS s FROM b) WHERE endpoint_id NOT IN ('signup', 'click')),
      x AS (SELECT event_type AS endpoint_id, 'value' AS feature, value AS x, ts FROM events
        UNION ALL SELECT event_type, 'k', (props::JSON ->> 'k')::DOUBLE, ts FROM events),
      m AS (SELECT endpoint_id, feature, min(x) AS mn, max(x) AS mx FROM x WHERE ts < TIMESTAMP '{CUT}' GROUP BY 1, 2),
      y AS (SELECT endpoint_id, feature, ts, CASE WHEN x < mn THEN 0 WHEN x > mx THEN 21
        ELSE least(floor((x - mn) / ((mx - mn) / 20))::INT, 19) + 1 END AS bin FROM x JOIN m USING (endpoint_id, feature)),
      rc AS (SELECT endpoint_id, feature, bin, count(*) AS n FROM y WHERE ts < TIMESTAMP '{CUT}' GROUP BY 1, 2, 3),
      rq AS (SELECT endpoint_id, feature, bin, n / sum(n) OVER (PARTITION BY endpoint_id, feature) AS q FROM rc),
      sc AS (SELECT endpoint_id, end_time, feature, bin, count(*) AS n FROM y JOIN i USING (endpoint_id) WHERE ts > start_time AND ts <= end_time GROUP BY 1, 2, 3, 4),
      sp AS (SELECT endpoint_id, end_time, feature, bin, n / sum(n) OVER (PARTITION BY endpoint_id, end_time, feature) AS p FROM sc),
      g AS (SELECT DISTINCT endpoint_id, end_time, feature, bins.bin FROM sp, (SELECT unnest(range(22))::INT AS bin) bins),
      pq AS (SELECT endpoint_id, end_time, feature, coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM g
        LEFT JOIN sp USING (endpoint_id, end_time, feature, bin) LEFT JOIN rq USING (endpoint_id, feature, bin)),
      f AS (SELECT endpoint_id, end_time, feature, sum(abs(p - q)) / 2 AS tvd, sqrt(greatest(1 - sum(sqrt(p * q)), 0)) AS h FROM pq GROUP BY 1, 2, 3),
      r AS (SELECT endpoint_id, end_time, (avg(tvd) + avg(h)) / 2 AS v FROM f GROUP BY 1, 2)
    SELECT endpoint_id, 'drift' AS application_name, end_time AS end_infer_time, round(v, 6) AS result_value,
      CASE WHEN v >= 0.6 THEN 2 WHEN v >= 0.4 THEN 1 ELSE 0 END::INT AS result_status,
      CASE WHEN v >= 0.6 THEN 'data_drift_detected' WHEN v >= 0.4 THEN 'data_drift_suspected' END AS event_kind FROM r""",
)
def monitoring_job(spark, sf_dir):
    """Log to intervals, drift per interval, status and alert kind, in one plan."""
    log = _log(spark, sf_dir)
    features = ["value", "k"]
    reference, _ = _halves(log)
    edges = _edges_by_endpoint(reference, features)
    counts = reference_counts(reference.drop("timestamp"), edges)
    found = drift_job(log, _endpoints(log), edges, counts, features, STEP, grace=60, potential=0.4, detected=0.6)
    kind = monitoring.alert_kind(F.col("result_kind"), F.col("result_status"))
    return found.results.select(
        "endpoint_id", "application_name", "end_infer_time", money("result_value", 6).alias("result_value"),
        "result_status", kind.alias("event_kind"),
    )
