"""Feeds over several batches, with repeats and restarts."""

import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from rowferry.queries import loops
from rowferry.sources.workspace import shared_folder
from rowferry.streaming import delivering, feeds
from rowferry.streaming.commits import MOST_FOLDERS, Commits

SCHEMA = "event_id bigint, k int, ts timestamp, v string"


def events(spark, *numbers):
    start = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(n, n % 3, start + dt.timedelta(minutes=n), f"v{n}") for n in numbers], SCHEMA)


def test_repeated_batch_leaves_the_same_state(spark):
    log = feeds.ChangeLog(spark, shared_folder(spark), events(spark, 1).schema)
    handle = feeds.apply_changes(log, feeds.newest_in_batch(["k"], "ts", "event_id"))
    handle(events(spark, *range(10)), 0)
    handle(events(spark, 20, 21), 1)
    once = sorted(tuple(r) for r in feeds.applied(log, ["k"], "ts").collect())
    handle(events(spark, 20, 21), 1)
    handle(events(spark, 2, 3), 2)
    assert sorted(tuple(r) for r in feeds.applied(log, ["k"], "ts").collect()) == once
    folded = feeds.ChangeLog(spark, shared_folder(spark), log.schema)
    feeds.compact(log, ["k"], "ts", into=folded)
    assert sorted(tuple(r) for r in feeds.applied(folded, ["k"], "ts").collect()) == once


def test_restart_goes_on_from_the_checkpoint(spark):
    path, checkpoint = shared_folder(spark), shared_folder(spark)
    schema = events(spark, 1).schema
    log = feeds.ChangeLog(spark, shared_folder(spark), schema)
    seen = []

    def handle(rows, batch):
        seen.append(batch)
        log.write(rows, batch)

    for part in ([1, 2, 3], [4, 5]):
        events(spark, *part).coalesce(1).write.mode("append").parquet(path)
        feeds.drain(feeds.read_feed(spark, path, schema, files_per_batch=1), handle, checkpoint)
    assert sorted(r.event_id for r in log.rows().collect()) == [1, 2, 3, 4, 5]
    assert seen == [0, 1]


def test_held_events_are_delivered_when_due(spark):
    schema = "event_id bigint, available_at timestamp_ntz"
    day = [dt.datetime(2024, 1, d) for d in range(1, 8)]
    frames = [spark.createDataFrame(r, schema) for r in ([(1, day[0]), (2, day[4])], [(3, day[1])], [(4, day[6])])]
    delivered = feeds.ChangeLog(spark, shared_folder(spark), frames[0].schema)
    waiting = feeds.ChangeLog(spark, shared_folder(spark), frames[0].schema)
    for batch, now in enumerate((day[0], day[1], day[5])):
        feeds.hold_until_due(delivered, waiting, lambda rows, now=now: F.lit(now).cast("timestamp_ntz"))(frames[batch], batch)
    assert sorted((r.event_id, r.batch) for r in delivered.rows().collect()) == [(1, 0), (2, 2), (3, 1)]
    assert [r.event_id for r in feeds.still_waiting(delivered, waiting).collect()] == [4]


def test_duplicates_over_batches_are_dropped(spark):
    path = shared_folder(spark)
    for part in ([1, 2, 3], [2, 3, 4], [4, 5, 5]):
        events(spark, *part).coalesce(1).write.mode("append").parquet(path)
    schema = events(spark, 1).schema
    stream = feeds.distinct_events(feeds.read_feed(spark, path, schema, files_per_batch=1), ["event_id"], "ts", "1 hour")
    log = feeds.ChangeLog(spark, shared_folder(spark), schema)
    feeds.drain(stream, lambda rows, batch: log.write(rows, batch), shared_folder(spark))
    assert sorted(r.event_id for r in log.rows().collect()) == [1, 2, 3, 4, 5]


def test_continuous_loop_stops_between_batches(spark):
    path = shared_folder(spark)
    events(spark, 1, 2).write.parquet(path)
    schema = events(spark, 1).schema
    log = feeds.ChangeLog(spark, shared_folder(spark), schema)
    loop = feeds.keep_running(feeds.read_feed(spark, path, schema), lambda rows, batch: log.write(rows, batch),
                              shared_folder(spark), 1)
    loop.processAllAvailable()
    loop.stop()
    assert log.rows().count() == 2


def test_a_lost_batch_is_an_error(spark):
    schema = spark.createDataFrame([], "event_id bigint, available_at timestamp_ntz").schema
    delivered = feeds.ChangeLog(spark, shared_folder(spark), schema)
    waiting = feeds.ChangeLog(spark, shared_folder(spark), schema)
    assert waiting.rows().count() == 0
    handle = feeds.hold_until_due(delivered, waiting, lambda rows: F.current_timestamp())
    with pytest.raises(AnalysisException):
        handle(spark.createDataFrame([], schema), 1)


def test_nothing_is_lost_however_late(spark):
    path, checkpoint = shared_folder(spark), shared_folder(spark)
    schema = events(spark, 1).schema
    log = feeds.ChangeLog(spark, shared_folder(spark), schema)
    for part in ([900_000, 900_001], [1, 900_000], [2, 1, 2], [900_001, 3]):  # minutes: the second batch is 20 months late
        events(spark, *part).coalesce(1).write.mode("append").parquet(path)
        stream = feeds.distinct_events(feeds.read_feed(spark, path, schema, files_per_batch=1), ["event_id"])
        feeds.drain(stream, lambda rows, batch: log.write(rows, batch), checkpoint)
    assert sorted(r.event_id for r in log.rows().collect()) == [1, 2, 3, 900_000, 900_001]


def test_a_due_event_leaves_a_quiet_feed(spark):
    schema = "event_id bigint, available_at timestamp_ntz"
    path, checkpoint = shared_folder(spark), shared_folder(spark)
    day = [dt.datetime(2024, 1, d) for d in range(1, 6)]
    frame = spark.createDataFrame([(1, day[0]), (2, day[2]), (3, day[4]), (4, None)], schema)
    frame.coalesce(1).write.parquet(path)
    delivered = feeds.ChangeLog(spark, shared_folder(spark), frame.schema)
    waiting = feeds.ChangeLog(spark, shared_folder(spark), frame.schema)
    left = []
    for now in (day[0], day[1], day[3]):  # one file in the feed, three runs
        handle = feeds.hold_until_due(delivered, waiting, lambda rows, now=now: F.lit(now).cast("timestamp_ntz"))
        feeds.drain(feeds.with_heartbeat(feeds.read_feed(spark, path, frame.schema)), handle, checkpoint)
        left.append(sorted(r.event_id for r in delivered.rows().collect()))
    assert left == [[1], [1], [1, 2]]
    assert sorted(r.event_id for r in feeds.still_waiting(delivered, waiting).collect()) == [3, 4]


def _numbered(spark, rows):
    return spark.createDataFrame(rows, "k bigint, v string")


def test_commits_show_whole_batches(spark):
    store = Commits(spark, shared_folder(spark), {"a": ["k"], "b": ["k"]})
    assert store.batches() == []
    store.start({"a": _numbered(spark, [(k, "old") for k in range(100)]), "b": _numbered(spark, [])})
    store.start({"a": _numbered(spark, []), "b": _numbered(spark, [])})  # it is there already
    expected = {k: "old" for k in range(100)}
    for batch in range(20):
        rows = {(batch * 7 + j) % 130: f"{batch}.{j}" for j in range(5)}
        assert store.commit(batch, {"a": _numbered(spark, list(rows.items()))})
        assert not store.commit(batch, {"a": _numbered(spark, [(1, "again")])})
        expected |= rows
        assert dict(map(tuple, store.read()["a"].collect())) == expected
    assert store.read()["b"].count() == 0 and len(store._manifest(19)["a"]) <= MOST_FOLDERS
    # A batch that failed after writing a folder but before its manifest leaves nothing to see.
    store._store("a", 20, _numbered(spark, [(1, "lost")]))
    assert dict(map(tuple, store.read()["a"].collect())) == expected
    assert dict(map(tuple, store.read(before=19)["a"].collect())) != expected


def same_rows(a, b):
    columns = sorted(a.columns)
    return sorted(map(str, a.select(columns).collect())) == sorted(map(str, b.select(columns).collect()))


def test_the_loop_in_passes_equals_one_pass(spark, folder):
    """A limit that takes several passes, and every batch twice: the same tables as one pass, but for allocated ids."""
    whole, parts = loops.looped(spark, folder), loops.looped(spark, folder, limit=700, again=True)
    assert len(parts.batches()) > len(whole.batches())
    one, many = whole.read(), parts.read()
    for name in ("account", "quarantine", "audit"):
        assert same_rows(one[name], many[name])
    assert same_rows(one["envelope"], many["envelope"]) and same_rows(one["outbox"], many["outbox"])
    for name in ("order_head", "order_note", "account_detail"):
        ids = [c for c in ("id", "head_id") if c in one[name].columns]
        assert same_rows(one[name].drop(*ids), many[name].drop(*ids))
        assert many[name].select("id").distinct().count() == many[name].count()
    links = lambda frames: frames[delivering._CROSSWALK].drop("target_id")
    assert same_rows(links(one), links(many))


def test_the_loop_with_nothing_to_do(spark, folder):
    commits = loops.looped(spark, folder)
    before = {n: df.count() for n, df in commits.read().items()}
    last = commits.batches()[-1]
    empty = loops._feed(spark, folder)[0].limit(0)
    switch = spark.createDataFrame([("customer", "CRM", False)], "source_entity string, target_system string, enabled boolean")
    delivering.pass_over(commits, switch, [loops._CUSTOMER], loops._MODEL, loops._PROFILE, "SRC", loops.as_of)(empty, last + 1)
    assert {n: df.count() for n, df in commits.read().items()} == before and commits.done(last + 1)


def test_a_backlog_takes_few_passes(spark, folder):
    """Workers side by side: passes by the logarithm of the backlog, every event claimed once and older ones first."""
    commits = loops.looped(spark, folder, limit=200)
    now = commits.read()
    assert len(commits.batches()) <= 6  # one worker at a time would need nine passes and the start
    assert now["audit"].count() == now["audit"].select("event_id").distinct().count()
    assert now["outbox"].filter("status = 'pending'").isEmpty()


def test_many_changed_rows_are_written_once(spark, monkeypatch):
    """Rows that outnumber the table go into the new base at once, one row per key, and an empty base is not carried on."""
    store = Commits(spark, shared_folder(spark), {"a": ["k"]})
    store.start({"a": _numbered(spark, [])})
    written = []
    plain = Commits._store
    monkeypatch.setattr(Commits, "_store", lambda self, name, *rest: written.append(name) or plain(self, name, *rest))
    expected = {}
    for batch, keys in enumerate((range(10), range(5, 40), range(3), range(30, 90))):
        store.commit(batch, {"a": _numbered(spark, [(k, f"{batch}.{k}") for k in keys] * 2)})
        expected |= {k: f"{batch}.{k}" for k in keys}
        assert sorted(map(tuple, store.read()["a"].collect())) == sorted(expected.items())
    assert len(written) == 4 and [len(store._manifest(b)["a"]) for b in range(4)] == [1, 1, 2, 1]


def test_arrived_events(spark):
    """Repeats once, events that the outbox has not at all; the whole rows of other events meet no shuffle."""
    box, rows = events(spark, 1, 2, 50), events(spark, 2, 3, 3, 4, 7)
    assert sorted(r.event_id for r in delivering.arrived(rows, box).collect()) == [3, 4, 7]
    unknown = rows.withColumn("event_id", F.when(F.col("event_id") != 3, F.col("event_id")))
    assert sorted(str(r.event_id) for r in delivering.arrived(unknown, box).collect()) == ["4", "7", "None"]
