"""Streaming queries: drained with availableNow and compared with the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.union import union_all
from ..sources.tables import since
from ..sources.workspace import shared_folder
from ..streaming import feeds
from .fixtures import AS_OF_SQL, as_of, outbox, sql, table
from .registry import query

BATCHES = 4


def feed_files(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _stage(spark: SparkSession, rows: DataFrame, path: str | None = None) -> str:
    """Lays a feed out as files; their number follows the cluster."""
    path = path or shared_folder(spark)
    rows.repartition(feed_files(spark)).write.mode("append").parquet(path)
    return path


def _stream(spark: SparkSession, rows: DataFrame, path: str | None = None) -> DataFrame:
    path = path or _stage(spark, rows)
    return feeds.read_feed(spark, path, rows.schema, files_per_batch=max(1, feed_files(spark) // BATCHES))


def _log(spark: SparkSession, schema: T.StructType) -> feeds.ChangeLog:
    return feeds.ChangeLog(spark, shared_folder(spark), schema)


def _keep(log: feeds.ChangeLog):
    return lambda rows, batch: log.write(rows, batch)


@query("a4_streamed_poll", "SELECT * FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00'")
def streamed_poll(spark, folder):
    events = table(spark, folder, "events")
    log = _log(spark, events.schema)
    feeds.drain(since(_stream(spark, events), "ts", as_of()), _keep(log), shared_folder(spark))
    return log.rows().drop("batch")


_ORDER = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_orderstatus", T.StringType())])


def _envelopes(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    row = F.struct("o_orderkey", "o_orderstatus")
    changed = F.struct("o_orderkey", F.lit("X").alias("o_orderstatus"))
    none = F.lit(None).cast(_ORDER)

    def envelope(df, op, at, before, after):
        return df.select(F.to_json(F.struct(
            F.lit(op).alias("op"), (F.lit(at) + F.col("o_orderkey")).alias("ts_ms"), before.alias("before"),
            after.alias("after"))).alias("value"))

    base = 1_700_000_000_000
    broken = [  # later than what is right, so that none of them could be taken in unseen
        envelope(orders.filter("o_orderkey % 52 = 0"), "x", base + 3_000_000_000, none, changed),
        envelope(orders.filter("o_orderkey % 52 = 13"), "u", base + 3_000_000_000, row, none),
        envelope(orders.filter("o_orderkey % 52 = 26"), "u", base + 3_000_000_000, row, changed).select(
            F.regexp_replace("value", '"ts_ms":[0-9]*', '"ts_ms":"soon"').alias("value")),
        envelope(orders.filter("o_orderkey % 52 = 39"), "d", base + 3_000_000_000, row, none).select(
            F.substring("value", 1, 20).alias("value"))]
    return union_all(
        envelope(orders, "c", base, none, row), envelope(orders.filter("o_orderkey % 7 = 0"), "u", base + 1_000_000_000, row, changed),
        envelope(orders.filter("o_orderkey % 10 = 1"), "d", base + 2_000_000_000, row, none), *broken)


_ENVELOPE_SQL = (
    "SELECT 'insert' AS operation, 1700000000000 + o_orderkey AS ms, o_orderkey, o_orderstatus FROM orders UNION ALL SELECT "
    "'update', 1701000000000 + o_orderkey, o_orderkey, 'X' FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT 'deactivate', "
    "1702000000000 + o_orderkey, o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 10 = 1")


_CHANGE = T.StructType([T.StructField("operation", T.StringType()), T.StructField("source_updated_at", T.TimestampType()), *_ORDER.fields])
_BROKEN = T.StructType([T.StructField("envelope", T.StringType()), T.StructField("errors", T.ArrayType(T.StringType()))])


def _changes(spark, folder, reduce=None):
    """(good, broken) logs of a feed in which some envelopes are broken."""
    good, bad = _log(spark, _CHANGE), _log(spark, _BROKEN)
    feeds.drain(feeds.decode_envelope(_stream(spark, _envelopes(spark, folder)), _ORDER), feeds.route(good, bad, reduce=reduce),
                shared_folder(spark))
    return good, bad


@query("a6_envelope_source", sql("SELECT operation, ms, o_orderkey, o_orderstatus FROM e", extra={"e": _ENVELOPE_SQL}))
def envelope_source(spark, folder):
    good, _ = _changes(spark, folder)
    return good.rows().select("operation", F.unix_millis("source_updated_at").alias("ms"), "o_orderkey", "o_orderstatus")


@query("a6_broken_envelopes", (
    "SELECT errors, count(*) AS envelopes FROM (SELECT CASE o_orderkey % 52 WHEN 0 THEN 'no known operation' WHEN 13 THEN 'no row image' "
    "WHEN 26 THEN 'no time of change' ELSE 'no known operation;no time of change;no row image' END AS errors FROM orders WHERE o_orderkey "
    "% 13 = 0) GROUP BY errors"))
def broken_envelopes(spark, folder):
    """What cannot be read is set apart with all that is wrong with it."""
    _, bad = _changes(spark, folder)
    return bad.rows().groupBy(F.array_join("errors", ";").alias("errors")).agg(F.count("*").alias("envelopes"))


@query("j2_resumable_cursor", "SELECT event_id, 1::BIGINT AS times FROM events")
def resumable_cursor(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type")
    log, path, checkpoint = _log(spark, events.schema), shared_folder(spark), shared_folder(spark)
    for part in ("event_type IN ('click', 'view')", "event_type NOT IN ('click', 'view')"):
        _stage(spark, events.filter(part), path)
        feeds.drain(_stream(spark, events, path), _keep(log), checkpoint)
    return log.rows().groupBy("event_id").agg(F.count("*").alias("times"))


@query("j3_idempotent_replay", "SELECT event_id, 1::BIGINT AS times FROM events")
def idempotent_replay(spark, folder):
    """Every event once: repeats come in the same run and in a later one, together with events that are weeks late."""
    sent = table(spark, folder, "events").selectExpr("event_id", "event_type", "CAST(ts AS TIMESTAMP) AS ts")
    late = (F.col("event_type") == "error") | (F.col("event_id") % 10 == 0)
    log, path, checkpoint = _log(spark, sent.schema), shared_folder(spark), shared_folder(spark)
    first = sent.filter(~late)
    for part in (union_all(first, first.filter("event_type = 'click'")), union_all(sent.filter(late), sent.filter("event_id % 3 = 0"))):
        _stage(spark, part, path)
        feeds.drain(feeds.distinct_events(_stream(spark, sent, path), ["event_id"]), _keep(log), checkpoint)
    return log.rows().groupBy("event_id").agg(F.count("*").alias("times"))


@query("j4_out_of_order_guard", (
    "SELECT user_id, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) "
    "AS n FROM events) WHERE n = 1"))
def out_of_order_guard(spark, folder):
    events = table(spark, folder, "events").select("user_id", "event_id", "ts", "value")
    log = _log(spark, events.schema)
    feeds.drain(_stream(spark, events), feeds.apply_changes(log, feeds.newest_in_batch(["user_id"], "ts", "event_id")),
                shared_folder(spark))
    return feeds.applied(log, ["user_id"], "ts", "event_id")


@query("j5_poison_rows", (
    "SELECT event_id, CASE WHEN event_type = 'error' AND value > 10 THEN 'unsupported event;value too high' WHEN event_type = "
    "'error' THEN 'unsupported event' ELSE '' END AS errors FROM events"))
def poison_rows(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type", "value")

    def check(rows):
        bad = F.col("event_type") == "error"
        errors = F.array(F.when(bad, F.lit("unsupported event")), F.when(bad & (F.col("value") > 10), F.lit("value too high")))
        return rows.withColumn("errors", F.filter(errors, lambda e: e.isNotNull()))

    good = _log(spark, events.schema)
    bad = _log(spark, T.StructType([*events.schema.fields, T.StructField("errors", T.ArrayType(T.StringType()))]))
    feeds.drain(_stream(spark, events), feeds.route(good, bad, check), shared_folder(spark))
    return good.rows().select("event_id", F.lit("").alias("errors")).unionByName(
        bad.rows().select("event_id", F.array_join("errors", ";").alias("errors")))


@query("j6_delayed_retry", sql(
    f"SELECT event_id, CASE WHEN available_at <= {AS_OF_SQL} THEN 'delivered' WHEN available_at <= {AS_OF_SQL} + INTERVAL '1' DAY THEN "
    "'delivered on a quiet feed' ELSE 'waiting' END AS state FROM outbox_base", "outbox_base"))
def delayed_retry(spark, folder):
    """The feed ends; a day later, without a new file, what is due by then leaves."""
    box = outbox(spark, folder).select("event_id", "available_at", "created_at")
    delivered, waiting = _log(spark, box.schema), _log(spark, box.schema)
    path, checkpoint, ends = _stage(spark, box), shared_folder(spark), []
    for days in (0, 1):
        handle = feeds.hold_until_due(delivered, waiting, lambda rows, days=days: as_of() + F.make_dt_interval(F.lit(days)))
        feeds.drain(feeds.with_heartbeat(_stream(spark, box, path)), handle, checkpoint)
        ends.append(waiting.rows().agg(F.max("batch")).first()[0])  # one number
    when = F.when(F.col("batch") <= ends[0], "delivered").otherwise("delivered on a quiet feed")
    return delivered.rows().select("event_id", when.alias("state")).unionByName(
        feeds.still_waiting(delivered, waiting).select("event_id", F.lit("waiting").alias("state")))


@query("j7_throughput", (
    "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS events FROM events GROUP BY 1, 2"))
def throughput(spark, folder):
    events = table(spark, folder, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    counted = feeds.throughput(_stream(spark, events), "ts", "1 hour", "event_type", "60 days")
    log = _log(spark, counted.schema)
    feeds.drain(counted, _keep(log), shared_folder(spark), "update")
    latest = log.rows().groupBy("window_start", "event_type").agg(F.max("events").alias("events"))
    return latest.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("j8_change_apply", sql(
    "SELECT o_orderkey, o_orderstatus, operation <> 'deactivate' AS active FROM (SELECT *, row_number() OVER (PARTITION BY "
    "o_orderkey ORDER BY ms DESC) AS n FROM e) WHERE n = 1", extra={"e": _ENVELOPE_SQL}))
def change_apply(spark, folder):
    good, _ = _changes(spark, folder, feeds.newest_in_batch(["o_orderkey"], "source_updated_at"))
    current = feeds.applied(good, ["o_orderkey"], "source_updated_at")
    return current.select("o_orderkey", "o_orderstatus", (F.col("operation") != "deactivate").alias("active"))
