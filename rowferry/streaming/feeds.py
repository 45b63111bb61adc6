"""Streaming sources, the per-batch change log and the delivery loop.

State is kept as a change log: every micro-batch writes its own folder, named by the batch id, and a
repeated batch overwrites that folder. A batch therefore costs what it brings, not the size of the
table; `applied` reads the current state and `compact` folds old folders into one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordering import first_per_key, latest_per_key
from ..operators.union import union_all
from ..sources.workspace import is_missing

# Fixed value: pause of the delivery loop.
INTERVAL_SECONDS = 300

# Operation codes of change envelopes.
OPERATIONS = {"c": "insert", "r": "insert", "u": "update", "d": "deactivate"}


def read_feed(
    spark: SparkSession, path: str, schema: T.StructType | str, format: str = "parquet", files_per_batch: int | None = None
) -> DataFrame:
    reader = spark.readStream.format(format).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def read_topic(spark: SparkSession, servers: str, topic: str, options: dict[str, str] | None = None) -> DataFrame:
    """Topic of change envelopes. Needs the Kafka connector on the class path."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic) \
        .options(**(options or {})).load().select(F.col("value").cast("string").alias("value"))


def decode_envelope(feed: DataFrame, row: T.StructType | str, value: str = "value") -> DataFrame:
    """Change envelopes ``{op, ts_ms, before, after}`` to rows with operation and source_updated_at.

    A deletion carries its last row image and becomes a deactivation. An envelope that cannot be read, has no
    known operation, time or row image is no change. All rows come back, with the raw envelope and an `errors` array, for
    `route`.
    """
    inner = row if isinstance(row, str) else row.simpleString()
    schema = T._parse_datatype_string(f"struct<op:string,ts_ms:bigint,before:{inner},after:{inner}>")
    codes = F.create_map(*[F.lit(x) for pair in OPERATIONS.items() for x in pair])
    parsed = feed.select(F.col(value).alias("envelope"), F.from_json(value, schema).alias("e"))
    image = F.when(F.col("e.op") == "d", F.col("e.before")).otherwise(F.col("e.after"))
    decoded = parsed.select("envelope", codes[F.col("e.op")].alias("operation"),
                            F.timestamp_millis("e.ts_ms").alias("source_updated_at"), image.alias("row"))
    errors = F.filter(F.array(
        F.when(F.col("operation").isNull(), F.lit("no known operation")),
        F.when(F.col("source_updated_at").isNull(), F.lit("no time of change")),
        F.when(F.col("row").isNull(), F.lit("no row image"))), lambda e: e.isNotNull())
    return decoded.select("operation", "source_updated_at", "row.*", "envelope", errors.alias("errors"))


def drain(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> None:
    """Handles everything that is there and stops; a later call goes on from the checkpoint."""
    stream.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start().awaitTermination()


def keep_running(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, seconds: int = INTERVAL_SECONDS
):
    """Starts the delivery loop; stopping the returned query ends it between batches."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint) \
        .trigger(processingTime=f"{seconds} seconds").start()


class ChangeLog:
    """Batch folders of one table."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType):
        self.spark = spark
        self.root = root.rstrip("/")
        self.schema = schema

    def write(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/batch={batch}")

    def write_base(self, rows: DataFrame) -> None:
        """State from before the first batch, in a folder no batch number reaches."""
        self.write(rows, -1)

    def batch(self, number: int) -> DataFrame:
        """Rows of one batch, which must have been written."""
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/batch={number}")

    def rows(self) -> DataFrame:
        """All rows with their batch number; none before the first batch."""
        schema = T.StructType([*self.schema.fields, T.StructField("batch", T.LongType())])
        try:
            return self.spark.read.schema(schema).parquet(self.root)
        except AnalysisException as error:
            if not is_missing(error):
                raise
            return self.spark.createDataFrame([], schema)


def applied(log: ChangeLog, keys: Sequence[str], time: str, *ties: str) -> DataFrame:
    """Current state: the newest row per key; equal times take the later batch."""
    return latest_per_key(log.rows(), keys, time, "batch", *ties).drop("batch")


def compact(log: ChangeLog, keys: Sequence[str], time: str, *ties: str, into: ChangeLog) -> None:
    """Writes the current state as the base of another log; a stream that starts there at batch 0 leaves it alone."""
    into.write_base(applied(log, keys, time, *ties))


def newest_in_batch(keys: Sequence[str], time: str, *ties: str) -> Callable[[DataFrame], DataFrame]:
    """Reduces a batch to one row per key before it is written."""
    return lambda rows: latest_per_key(rows, keys, time, *ties)


def apply_changes(
    log: ChangeLog, reduce: Callable[[DataFrame], DataFrame]
) -> Callable[[DataFrame, int], None]:
    """Batch handler that keeps a keyed table current."""
    return lambda rows, batch: log.write(reduce(rows), batch)


def route(
    good: ChangeLog, bad: ChangeLog, check: Callable[[DataFrame], DataFrame] | None = None,
    reduce: Callable[[DataFrame], DataFrame] | None = None,
) -> Callable[[DataFrame, int], None]:
    """Batch handler that writes rows without errors to one log and the others, with their errors, to a second one.

    `check` adds the errors where the rows do not have them yet; `reduce` may bring the good rows down to one per key.
    """
    def handle(rows: DataFrame, batch: int) -> None:
        checked = (check(rows) if check else rows).persist()
        sound = checked.filter(F.size("errors") == 0).select(*good.schema.names)
        good.write(reduce(sound) if reduce else sound, batch)
        bad.write(checked.filter(F.size("errors") > 0).select(*bad.schema.names), batch)
        checked.unpersist()

    return handle


def hold_until_due(
    delivered: ChangeLog, waiting: ChangeLog, clock: Callable[[DataFrame], Column]
) -> Callable[[DataFrame, int], None]:
    """Batch handler that delivers due events and carries the others to the next batch.

    Only the events still waiting are rewritten. The clock is read once per batch, and the batch is split by that moment
    in one frame that is read twice, so no event falls between the two logs. An event without a due time waits.
    """
    def handle(rows: DataFrame, batch: int) -> None:
        pending = union_all(rows, waiting.batch(batch - 1)) if batch > 0 else rows
        moment = fixed_clock(rows.sparkSession, clock(rows), pending.schema["available_at"].dataType)
        marked = pending.withColumn("_due", F.coalesce(F.col("available_at") <= moment, F.lit(False))).persist()
        delivered.write(marked.filter("_due").drop("_due"), batch)
        waiting.write(marked.filter("not _due").drop("_due"), batch)
        marked.unpersist()

    return handle


def fixed_clock(spark: SparkSession, clock: Column, kind: T.DataType) -> Column:
    """The moment a clock column shows now, as a literal."""
    shown = spark.range(1).select(clock.cast(kind).cast("string").alias("now")).first()[0]
    return F.lit(shown).cast(kind)


def with_heartbeat(stream: DataFrame) -> DataFrame:
    """The stream with a source beside it that has something in every trigger but adds no rows.

    A batch then runs although the feed is quiet, so what waits for its time leaves at the next trigger.
    """
    beat = stream.sparkSession.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
    nothing = beat.filter(F.col("value") < 0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema.fields])
    return stream.unionByName(nothing)


def still_waiting(delivered: ChangeLog, waiting: ChangeLog, key: str = "event_id") -> DataFrame:
    """Events that are not delivered yet, each once."""
    held = first_per_key(waiting.rows(), [key], [F.col("batch").desc()]).drop("batch")
    return held.join(delivered.rows().select(key), key, "left_anti")


# Fixed value: the state store that keeps its keys on disk.
_ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def distinct_events(stream: DataFrame, keys: Sequence[str], time: str | None = None, delay: str | None = None) -> DataFrame:
    """Drops re-delivered events.

    Without a delay every key is remembered, so nothing is lost however late it comes. Keys live in the state store on
    the disks of the executors, dealt by key, and only changes go to the checkpoint: a batch costs what it brings, not what was seen
    before. With a time and a delay the state is kept for the delay only, and later events are dropped by Spark.
    """
    if delay is not None:
        return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))
    conf = stream.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", _ON_DISK)
    conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return stream.dropDuplicates(list(keys))


def throughput(events: DataFrame, time: str, width: str, by: str, delay: str | None = None) -> DataFrame:
    """Events per time window and status; with a delay it is a bounded streaming aggregate."""
    source = events.withWatermark(time, delay) if delay else events
    counted = source.groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("events"))
    return counted.select(F.col("w.start").alias("window_start"), by, "events")
