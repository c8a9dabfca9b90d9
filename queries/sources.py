"""Sources, sinks and ingest."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions.keys import static_store_key
from tidemark.functions.time import duration_micros
from tidemark.plans.ingest import Target, ingest, ingest_increment, read_latest
from tidemark.session import fresh_path
from tidemark.sinks import custom as committed
from tidemark.sinks import external as sink_options
from tidemark.sinks import files as sink_files
from tidemark.sinks import buckets, tables
from tidemark.sources import custom, files
from tidemark.specs import FeatureSet
from tidemark.streaming import run

from .base import money, query, schema_of, table

UTC = dt.timezone.utc
ORDER_FIELDS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate"


@query(
    "src_parquet",
    """SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity, l_discount FROM lineitem
    WHERE l_shipdate > TIMESTAMP '1997-01-01' AND l_shipdate <= TIMESTAMP '1998-01-01'
      AND l_returnflag IN ('A', 'R') AND l_discount >= 0.03""",
)
def src_parquet(spark, sf_dir):
    return table(
        spark, sf_dir, "lineitem",
        columns=["l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_discount"],
        time_field="l_shipdate", start="1997-01-01", end="1998-01-01",
        filters=[("l_returnflag", "in", ["A", "R"]), ("l_discount", ">=", 0.03)],
    )


@query("src_csv", f"SELECT {ORDER_FIELDS} FROM orders WHERE o_orderdate > TIMESTAMP '1996-06-01'")
def src_csv(spark, sf_dir):
    path = fresh_path(spark, "csv")
    sink_files.write_csv(table(spark, sf_dir, "orders").select(*ORDER_FIELDS.split(", ")), path)
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate string"
    return files.read_csv(spark, path, schema, time_field="o_orderdate", start="1996-06-01")


@query(
    "src_json",
    """SELECT event_id, ts, event_type, value FROM events
    WHERE ts > TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20 12:00:00'""",
)
def src_json(spark, sf_dir):
    path = fresh_path(spark, "json")
    events = table(spark, sf_dir, "events")
    sink_files.write_json(events, path)
    return files.read_json(
        spark, path, events.schema, ["event_id", "ts", "event_type", "value"], "ts",
        "2024-01-05", "2024-01-20T12:00:00",
    )


@query("src_dataframe", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_acctbal > 0")
def src_dataframe(spark, sf_dir):
    frame = table(spark, sf_dir, "customer")
    fs = FeatureSet("customer", ("c_custkey",), df=frame)
    return files.to_dataframe(fs, ["c_mktsegment", "c_acctbal"], filters=[("c_acctbal", ">", 0)])


@query("src_stream", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def src_stream(spark, sf_dir):
    stream = files.stream_files(spark, f"{sf_dir}/events.parquet*", schema_of(spark, sf_dir, "events"))
    return run.drain(stream, "src-stream")


@query(
    "src_custom",
    """WITH span AS (SELECT epoch_us(min(ts)) // 3600000000 AS a, epoch_us(max(ts)) // 3600000000 AS b FROM events),
      hours AS (SELECT unnest(range(a, b + 1)) AS h FROM span)
    SELECT make_timestamp(h * 3600000000) AS window_start, make_timestamp((h + 1) * 3600000000) AS window_end, count(event_id) AS n
    FROM hours LEFT JOIN events ON epoch_us(ts) // 3600000000 = h GROUP BY h""",
)
def src_custom(spark, sf_dir):
    """Events per hour of a calendar, empty hours included."""
    events = table(spark, sf_dir, "events")
    first, last = events.agg(F.unix_seconds(F.min("ts")), F.unix_seconds(F.max("ts"))).first()
    hours = custom.read_custom(spark, custom.Calendar, start=first, end=last, step="1h", windows_per_partition=200)
    counted = events.groupBy(F.date_trunc("hour", "ts").alias("window_start")).agg(F.count(F.lit(1)).alias("n"))
    return hours.join(counted, "window_start", "left").select("window_start", "window_end", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "src_custom_stream",
    """WITH span AS (SELECT epoch_us(min(ts)) // 3600000000 AS a, epoch_us(max(ts)) // 3600000000 AS b FROM events),
      hours AS (SELECT unnest(range(a, b + 1)) AS h FROM span)
    SELECT make_timestamp(h * 3600000000) AS window_start, make_timestamp((h + 1) * 3600000000) AS window_end, 1::BIGINT AS n FROM hours""",
)
def src_custom_stream(spark, sf_dir):
    """A calendar that grows over three resumed runs: how often each window was read."""
    first, last = table(spark, sf_dir, "events").agg(F.unix_seconds(F.min("ts")), F.unix_seconds(F.max("ts"))).first()
    base = fresh_path(spark, "calendar")
    for end in (first + (last - first) // 3, first + 2 * (last - first) // 3, last):
        hours = custom.stream_custom(spark, custom.Calendar, start=first, end=end, step="1h", windows_per_partition=200)
        read = run.drain(hours, "calendar", base=base)
    return read.groupBy("window_start", "window_end").agg(F.count(F.lit(1)).alias("n"))


@query(
    "duration",
    "SELECT event_type, make_timestamp(epoch_us(ts) // 5400000000 * 5400000000) AS window_start, count(*) AS n FROM events GROUP BY ALL",
)
def duration(spark, sf_dir):
    """Windows of a length given as text."""
    micros = duration_micros("90m")
    at = F.unix_micros("ts")
    start = F.timestamp_micros(at - F.pmod(at, F.lit(micros)))
    return table(spark, sf_dir, "events").groupBy("event_type", start.alias("window_start")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "scan_named_view",
    "SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 6) AS avg_price FROM part GROUP BY p_brand",
)
def scan_named_view(spark, sf_dir):
    files.register_view(table(spark, sf_dir, "part"), "part_scan")
    return spark.sql(
        "SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 6) AS avg_price FROM part_scan GROUP BY p_brand"
    )


@query(
    "scan_passthrough",
    """SELECT s_suppkey, s_nationkey, round(s_acctbal * 2, 2) AS doubled FROM supplier WHERE s_acctbal > 1000""",
)
def scan_passthrough(spark, sf_dir):
    fs = FeatureSet(
        "supplier", ("s_suppkey",),
        steps=(lambda df: df.withColumn("doubled", money(F.col("s_acctbal") * 2)),),
        reader=lambda: table(spark, sf_dir, "supplier"),
    )
    return files.to_dataframe(fs, ["s_nationkey", "doubled"], filters=[("s_acctbal", ">", 1000)])


@query("scan_offline_target", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_offline_target(spark, sf_dir):
    base = fresh_path(spark, "offline")
    nation = table(spark, sf_dir, "nation")
    targets = {
        "csv": sink_files.write_csv(nation, f"{base}/csv"),
        "parquet": sink_files.write_parquet(nation, f"{base}/parquet"),
    }
    return files.read_offline(spark, targets)


@query(
    "fs_to_dataframe",
    """SELECT user_id, ts, value FROM events WHERE event_type = 'purchase'
    AND ts > TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20'""",
)
def fs_to_dataframe(spark, sf_dir):
    fs = FeatureSet("events", ("user_id",), "ts", df=table(spark, sf_dir, "events"))
    return files.to_dataframe(
        fs, ["value"], "2024-01-10", "2024-01-20", filters=[("event_type", "==", "purchase")]
    )


@query(
    "sink_parquet",
    """SELECT event_id, ts, year(ts)::INT AS year, month(ts)::INT AS month, day(ts)::INT AS day, hour(ts)::INT AS hour
    FROM events WHERE ts > TIMESTAMP '2024-01-03 10:30:00' AND ts <= TIMESTAMP '2024-01-25 04:00:00'""",
)
def sink_parquet(spark, sf_dir):
    path = fresh_path(spark, "hours")
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    sink_files.write_parquet(events, path, ts="ts", unit="hour")
    return files.read_parquet(
        spark, path, time_field="ts", start="2024-01-03T10:30:00", end="2024-01-25T04:00:00"
    )


@query("sink_key_bucket", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def sink_key_bucket(spark, sf_dir):
    base = fresh_path(spark, "buckets")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    sink_files.write_parquet(customer, f"{base}/hashed", keys=["c_custkey"], key_buckets=8)
    hashed = files.read_parquet(spark, f"{base}/hashed", columns=customer.columns)
    sink_files.write_parquet(hashed, f"{base}/by_key", keys=["c_nationkey"], key_buckets=0)
    return files.read_parquet(spark, f"{base}/by_key", columns=customer.columns)


@query(
    "sink_csv",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts_text, event_type FROM events""",
)
def sink_csv(spark, sf_dir):
    path = fresh_path(spark, "csv")
    sink_files.write_csv(table(spark, sf_dir, "events").select("event_id", "ts", "event_type"), path)
    schema = "event_id long, ts_text string, event_type string"
    return spark.read.option("header", True).option("enforceSchema", True).schema(schema).csv(path)


@query(
    "sink_latest_kv",
    """SELECT user_id, event_type, ts, event_id, value, event_type AS sort_key FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
)
def sink_latest_kv(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return tables.latest_table(events, ["user_id", "event_type"], "ts")


@query(
    "sink_latest_buckets",
    """SELECT user_id, event_type, ts, event_id, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
)
def sink_latest_buckets(spark, sf_dir):
    """The latest row per key, upserted in three parts; every part rewrites the buckets of its keys only."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    path, keys = fresh_path(spark, "latest-buckets"), ["user_id", "event_type"]
    for part in range(3):
        batch = events.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == part)
        buckets.upsert(batch, path, keys, buckets.keep_newest(keys, "ts"), 16, part)
    return buckets.read_buckets(spark, path)


@query(
    "sink_redis_key",
    """SELECT l_orderkey, l_linenumber,
      l_orderkey || '.' || sha1(l_linenumber || l_returnflag || l_linestatus) || '}:static' AS store_key
    FROM lineitem""",
)
def sink_redis_key(spark, sf_dir):
    keys = ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"]
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", static_store_key(keys).alias("store_key")
    )


@query(
    "sink_kafka",
    """SELECT c_custkey::VARCHAR AS key,
      '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_mktsegment":"' || c_mktsegment || '"}' AS value
    FROM customer""",
)
def sink_kafka(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return sink_options.kafka_rows(customer, "c_custkey")


@query(
    "sink_timeseries",
    """SELECT event_type, date_trunc('minute', ts) AS time, count(value) AS count, round(avg(value), 6) AS avg
    FROM events GROUP BY ALL""",
)
def sink_timeseries(spark, sf_dir):
    """Two increments appended to one series target."""
    fs = FeatureSet("events", ("event_type",), "ts")
    events = table(spark, sf_dir, "events").select("event_type", "ts", "value")
    targets = [Target("series", "series", fresh_path(spark, "series"))]
    first = ingest(fs, events, targets, end="2024-01-15")
    last = ingest_increment(fs, events, targets, first, dt.datetime(2030, 1, 1, tzinfo=UTC))
    series = files.read_parquet(spark, last.paths["series"])
    rollup = tables.series_rollup(series, "time", ["event_type"], "value")
    return rollup.withColumn("avg", money("avg", 6))


@query("sink_dataframe", "SELECT r_regionkey, upper(r_name) AS r_name FROM region")
def sink_dataframe(spark, sf_dir):
    fs = FeatureSet("region", ("r_regionkey",), steps=(lambda d: d.withColumn("r_name", F.upper("r_name")),))
    return fs.transform(table(spark, sf_dir, "region"))


@query(
    "sink_custom",
    "SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY user_id",
)
def sink_custom(spark, sf_dir):
    stream = files.stream_files(spark, f"{sf_dir}/events.parquet*", schema_of(spark, sf_dir, "events"))
    counted = stream.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    out = run.drain_table(counted, "sink-custom", "update", run.replace_keys(["user_id"]))
    return out.withColumn("total", money("total"))


@query(
    "write_mode",
    "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '1996-01-01'",
)
def write_mode(spark, sf_dir):
    base = fresh_path(spark, "modes")
    fs = FeatureSet("orders", ("o_orderkey",), "o_orderdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    targets = [Target("offline", "parquet", f"{base}/offline")]
    first = ingest(fs, orders, targets)
    second = ingest(fs, orders, targets, first, start="1996-01-01", end="1999-01-01")
    third = ingest(fs, orders, targets, second, overwrite=False, start="1999-01-01")
    return files.read_parquet(spark, third.paths["offline"])


@query(
    "incremental_ingest",
    """SELECT user_id, ts, event_id, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def incremental_ingest(spark, sf_dir):
    base = fresh_path(spark, "increments")
    fs = FeatureSet("events", ("user_id",), "ts")
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    targets = [Target("offline", "parquet", f"{base}/offline", unit="day"), Target("online", "latest", f"{base}/online")]
    status = ingest(fs, events, targets, end="2024-01-08")
    for day in (dt.datetime(2024, 1, 20, tzinfo=UTC), dt.datetime(2030, 1, 1, tzinfo=UTC)):
        status = ingest_increment(fs, events, targets, status, day)
    return read_latest(spark, status.paths["online"])


@query("special_columns_check", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def special_columns_check(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    FeatureSet("customer", ("c_custkey",), label_column="c_acctbal").check_special_columns(df.columns)
    return df


@query(
    "sink_committed",
    """SELECT o_custkey, o_orderkey, o_totalprice, o_orderdate >= DATE '1995-01-01' AS late FROM orders""",
)
def sink_committed(spark, sf_dir):
    """Two appends to a user target, each one commit, and what its manifest names."""
    orders = table(spark, sf_dir, "orders")
    late = F.col("o_orderdate") >= F.lit("1995-01-01").cast("date")
    rows = orders.select("o_custkey", "o_orderkey", "o_totalprice", late.alias("late"))
    path = fresh_path(spark, "committed")
    for part in (~F.col("late"), F.col("late") | F.col("late").isNull()):
        committed.write_committed(rows.where(part), path)
    return committed.read_committed(spark, path, rows.schema)
