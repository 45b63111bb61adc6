"""The composed jobs: two runs, hot keys, isolation of failures."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from rowferry.operators import validation
from rowferry.plans import delivery
from rowferry.queries import jobs
from rowferry.queries.fixtures import MODEL, SYSTEM, as_of, fixture


def same(a, b):
    columns = sorted(a.columns)
    return sorted(map(str, a.select(columns).collect())) == sorted(map(str, b.select(columns).collect()))


def test_second_delivery_changes_nothing(spark, folder):
    first = jobs._delivered(spark, folder)
    again = delivery.deliver_events(
        jobs._outbox(spark, folder), spark.createDataFrame(
            [("customer", "CRM", True)], "source_entity string, target_system string, enabled boolean"),
        first.target, first.quarantine, first.envelope, jobs.CUSTOMER, MODEL, jobs.PROFILE, SYSTEM, as_of())
    for name in first.target.tables:
        assert same(first.target.tables[name], again.target.tables[name])
    assert same(first.target.crosswalk, again.target.crosswalk)
    assert same(first.quarantine, again.quarantine)
    assert same(first.envelope, again.envelope)


def test_refresh_twice_keeps_accounts_and_no_orphans(spark, folder):
    source = fixture(spark, folder, "src_customer")
    once, failed, _ = delivery.refresh_entity(
        source, jobs._state(spark, folder), jobs.CUSTOMER, MODEL, jobs.PROFILE, SYSTEM)
    twice, _, deleted = delivery.refresh_entity(source, once, jobs.CUSTOMER, MODEL, jobs.PROFILE, SYSTEM)
    assert same(once.tables["account"], twice.tables["account"])
    details = twice.tables["account_detail"]
    assert same(once.tables["account_detail"].drop("id"), details.drop("id"))
    assert validation.orphans(details, "account_id", twice.tables["account"], "id").count() == 0
    assert {r.target_table: r.deleted for r in deleted.collect()}["account_detail"] == details.count()
    assert details.count() + failed.count() == source.count()


def test_delivery_without_rows(spark, folder):
    state = jobs._state(spark, folder)
    after, failed, _ = delivery.refresh_entity(
        fixture(spark, folder, "src_customer").filter("c_custkey < 0"), state, jobs.CUSTOMER, MODEL, jobs.PROFILE, SYSTEM)
    assert same(after.tables["account"], state.tables["account"])
    assert failed.count() == 0 and after.tables["account_detail"].count() == 0


def test_disabled_entity_is_not_delivered(spark, folder):
    off = spark.createDataFrame([("customer", "CRM", False)], "source_entity string, target_system string, enabled boolean")
    held = spark.createDataFrame([], "event_id bigint, errors array<string>, payload_snapshot string")
    box = jobs._outbox(spark, folder)
    state = jobs._state(spark, folder)
    first = jobs._delivered(spark, folder)
    done = delivery.deliver_events(box, off, state, held, first.envelope.filter(F.lit(False)), jobs.CUSTOMER, MODEL,
                                   jobs.PROFILE, SYSTEM, as_of())
    assert same(done.outbox, box) and same(done.target.tables["account"], state.tables["account"])


def test_entity_without_mapping_is_quarantined(spark, folder):
    on = spark.createDataFrame([("customer", "CRM", True)], "source_entity string, target_system string, enabled boolean")
    held = spark.createDataFrame([], "event_id bigint, errors array<string>, payload_snapshot string")
    envelope = spark.createDataFrame([], (
        "event_id string, external_reference string, source_entity string, operation string, source_updated_at timestamp_ntz, "
        "payload_checksum string, active boolean, accepted_at timestamp_ntz"))
    bare = delivery.Entity("customer", "erp", ("c_custkey",), (), jobs.ROW)
    state = jobs._state(spark, folder)
    done = delivery.deliver_events(jobs._outbox(spark, folder), on, state, held, envelope, bare, MODEL, jobs.PROFILE, SYSTEM,
                                   as_of())
    due = jobs._outbox(spark, folder).filter("status = 'pending'").count()
    assert done.quarantine.count() == due and done.envelope.count() == 0
    assert {tuple(r.errors) for r in done.quarantine.collect()} == {(delivery.NO_MAPPING,)}
    assert same(done.target.tables["account"], state.tables["account"])


def _event(spark, number, reference, names, minute, **values):
    row = {"c_custkey": 1, "c_name": "A", "c_mktsegment": "AUTOMOBILE", "c_acctbal": 1.0, "c_nationkey": 1, "opened_on": "2020-01-01"} | values
    payload = json.dumps({n: row[n] for n in names})
    at = dt.datetime(2024, 1, 1, 0, minute)
    return (number, reference, "customer", "CRM", "update", payload, "x", "pending", 0, at, at, at, None, None, None)


_BOX = ("event_id bigint, external_reference string, source_entity string, target_system string, operation string, payload string, "
        "payload_checksum string, status string, attempts int, created_at timestamp_ntz, available_at timestamp_ntz, source_updated_at "
        "timestamp_ntz, processed_at timestamp_ntz, last_error_code string, last_error_message string")


def test_events_of_a_row_are_applied_in_order(spark, folder):
    """One pass over all events equals a pass for each event, also where most events are of one row."""
    rng = random.Random(3)
    names = ["c_acctbal", "c_mktsegment", "c_name", "c_nationkey", "opened_on"]
    references = [f"ref{k}" for k in (0, 0, 0, 1, 2)]
    box = []
    for number in range(11):
        # Every row begins with a whole event; names are distinct, so that no row is taken for another one.
        reference = f"ref{number}" if number < 3 else rng.choice(references)
        given = ["c_custkey", *names] if number < 3 else ["c_custkey", *[n for n in names if rng.random() < 0.4]]
        segment = rng.choice(["AUTOMOBILE", "BUILDING", "HOUSEHOLD"])
        box.append(_event(spark, 100 - number if number > 2 else number, reference, given, number, c_name=f"{reference}.{number}",
                          c_mktsegment=segment, c_acctbal=float(number), c_nationkey=rng.choice([1, 2, 3]), opened_on=f"2020-01-{1 + number % 28:02}"))
    on = spark.createDataFrame([("customer", "CRM", True)], "source_entity string, target_system string, enabled boolean")
    held = spark.createDataFrame([], "event_id bigint, errors array<string>, payload_snapshot string")
    letters = jobs._delivered(spark, folder).envelope.limit(0)
    empty = jobs._state(spark, folder)
    empty.tables["account"] = empty.tables["account"].limit(0)

    def after(state, events):
        done = delivery.deliver_events(spark.createDataFrame(events, _BOX), on, state, held, letters, jobs.CUSTOMER, MODEL, jobs.PROFILE,
                                       SYSTEM, as_of())
        assert done.outbox.filter("status <> 'delivered'").count() == 0
        return delivery.durable(done.target)

    together = after(empty, box)
    one_by_one = after(empty, box[:3])
    for event in box[3:]:
        one_by_one = after(one_by_one, [event])
    for name in ("account", "account_detail"):
        assert same(together.tables[name], one_by_one.tables[name])
    assert same(together.crosswalk, one_by_one.crosswalk)


def test_rows_that_share_an_id_leave_one_row(spark, folder):
    """Two references with one recorded id: the last event writes, and the table keeps one row."""
    state = jobs._state(spark, folder)
    links = state.crosswalk.limit(1).select("source_system", F.lit("customer").alias("source_entity"), F.explode(F.array(
        F.lit("ref1"), F.lit("ref2"))).alias("external_reference"), "target_system", F.lit("account").alias("target_table"), F.lit("1003").alias("target_id"))
    state.crosswalk = state.crosswalk.filter("target_table = 'nation'").unionByName(links)
    names = ["c_custkey", "c_name", "c_mktsegment", "c_acctbal", "opened_on"]
    box = [_event(spark, 1, "ref2", names, 5, c_name="late"), _event(spark, 2, "ref1", names, 1, c_name="early")]
    on = spark.createDataFrame([("customer", "CRM", True)], "source_entity string, target_system string, enabled boolean")
    held = spark.createDataFrame([], "event_id bigint, errors array<string>, payload_snapshot string")
    done = delivery.deliver_events(spark.createDataFrame(box, _BOX), on, state, held, jobs._delivered(spark, folder).envelope.limit(0),
                                   jobs.CUSTOMER, MODEL, jobs.PROFILE, SYSTEM, as_of())
    assert [r.name for r in done.target.tables["account"].filter("id = 1003").collect()] == ["late"]
