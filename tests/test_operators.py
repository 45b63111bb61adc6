"""Operators against brute force, and their invariants."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.functions.keys import external_reference
from rowferry.operators import compare, diagnose, drift, events, lookups, matching, merge, metrics, ordering, skew, validation
from rowferry.sources import contracts as contract_sources
from rowferry.sources.snapshots import Snapshots, rebuild
from rowferry.sources.workspace import materialise, shared_folder


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_repairs_are_as_if_applied_one_after_another(spark):
    """Contested ids, repeated errors, refused repairs, a crosswalk row without an id, and empty plans."""
    rng = random.Random(11)
    plan = []
    for error in range(200):
        entity, number = f"e{rng.randrange(4)}", str(rng.randrange(30))
        safe = rng.random() < 0.7
        plan.append((error, "SRC", entity, "t", number, f"{entity}:{number}", safe, [] if safe else [diagnose.TARGET_GONE]))
    before = [("SRC", "e0", f"e0:{k}", "DST", "t", None, "old", "kept") for k in range(5)] + [
        ("SRC", "e9", "other", "DST", "t", "900", "old", "kept")]
    owner, done = {}, []
    for error, _, entity, _, number, reference, safe, _ in plan:
        mine = safe and owner.setdefault(number, (entity, reference)) == (entity, reference)
        done.append((error, mine, [] if mine else [diagnose.CLAIMED if safe else diagnose.TARGET_GONE]))
    after = {(b[1], b[2]): (b[5], b[6], b[7]) for b in before}
    for number, key in owner.items():
        after[key] = (number, "new", after[key][2] if key in after else None)
    planned = spark.createDataFrame(plan, "error_id long, source_system string, source_entity string, target_table string, target_id string, "
                                    "external_reference string, safe_to_repair boolean, reasons array<string>")
    crosswalk = spark.createDataFrame(before, "source_system string, source_entity string, external_reference string, target_system string, "
                                      "target_table string, target_id string, updated_at string, note string")
    renewed, audit, outcome = diagnose.apply_repairs(planned, crosswalk, "DST", "me", F.lit("new"))
    assert {(r["source_entity"], r["external_reference"]): (r["target_id"], r["updated_at"], r["note"]) for r in renewed.collect()} == after
    assert renewed.columns == crosswalk.columns and renewed.count() == len(after)
    assert rows(outcome.select("error_id", "applied", "reasons"), "error_id") == done
    assert sorted((r["source_entity"], json.loads(r["details"])["target_id"]) for r in audit.collect()) == sorted(
        (entity, number) for number, (entity, _) in owner.items())
    # A second pass over the same plan changes nothing, and an empty plan neither.
    again, _, _ = diagnose.apply_repairs(planned, renewed, "DST", "me", F.lit("new"))
    assert rows(again, *again.columns) == rows(renewed, *again.columns)
    same, none, _ = diagnose.apply_repairs(planned.limit(0), crosswalk, "DST", "me", F.lit("new"))
    assert rows(same, *same.columns) == rows(crosswalk, *same.columns) and none.count() == 0


def test_spread_join_equals_join(spark):
    hot = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 11 = 0 THEN NULL ELSE id % 100 END AS k")
    other = spark.range(90).selectExpr("id AS k", "id * 10 AS v")
    for how in ("left", "inner", "left_semi", "left_anti"):
        columns = ["id", "k", "v"] if how in ("left", "inner") else ["id", "k"]
        plain = hot.join(other, "k", how).select(columns)
        spread = skew.spread_join(hot, other, "k", how, ["id"], copies=8).select(columns)
        assert rows(plain, "id") == rows(spread, "id")
    assert rows(skew.heavy_keys(hot, "k"), "k") == [(None,), (7,)]
    even = spark.range(1000).selectExpr("id", "id % 100 AS k")
    assert skew.heavy_keys(even, "k").count() == 0
    assert rows(skew.spread_join(even, other, "k"), "id") == rows(even.join(other, "k", "left"), "id")
    with pytest.raises(ValueError):
        skew.spread_join(hot, other, "k", "full")


def test_allocation_is_dense_ordered_and_stable(spark):
    keys = spark.range(5000).select(F.sha1(F.col("id").cast("string")).alias("ref"))
    first = ordering.allocate_ids(keys, "ref", "id", 100)
    got = rows(first.select("ref", "id"), "ref")
    assert [i for _, i in got] == list(range(100, 5100))
    again = ordering.allocate_ids(keys.repartition(13), "ref", "id", 100, ranges=3)
    assert rows(again.select("ref", "id"), "ref") == got


def test_match_or_allocate_is_idempotent(spark):
    source = spark.range(60).select(
        F.sha1(F.col("id").cast("string")).alias("external_reference"), F.concat(F.lit("n"), F.col("id") % 20).alias("name"))
    target = spark.createDataFrame([(5, "n3"), (6, "n4"), (9, "n4")], "id bigint, name string")
    links = spark.createDataFrame([], "external_reference string, target_id string")
    first = lookups.match_or_allocate(source, links, target, "id", 1000, ["name"]).persist()
    by_name = {}
    for r in first.collect():
        by_name.setdefault(r.name, set()).add(r.target_id)
    assert all(len(ids) == 1 for ids in by_name.values())
    assert by_name["n3"] == {5} and by_name["n4"] == {6}
    assert sorted(i for ids in by_name.values() for i in ids if i >= 1000) == list(range(1000, 1018))
    inserted = first.filter("action = 'insert'").selectExpr("target_id AS id", "name")
    after = target.unionByName(inserted)
    known = first.selectExpr("external_reference", "CAST(target_id AS STRING) AS target_id")
    second = lookups.match_or_allocate(source, known, after, "id", 1000, ["name"])
    assert rows(second.select("external_reference", "target_id"), "external_reference") == \
        rows(first.select("external_reference", "target_id"), "external_reference")
    assert {r.action for r in second.collect()} == {"update"}


def test_stale_crosswalk_allocates_again(spark):
    source = spark.createDataFrame([("aa", "x"), ("bb", "y")], "external_reference string, name string")
    target = spark.createDataFrame([(1, "x")], "id bigint, name string")
    links = spark.createDataFrame([("aa", "1"), ("bb", "77")], "external_reference string, target_id string")
    got = lookups.match_or_allocate(source, links, target, "id", 10)
    assert rows(got.select("external_reference", "target_id", "action"), "external_reference") == [
        ("aa", 1, "update"), ("bb", 10, "insert")]


def test_lookup_by_values_equals_brute_force(spark):
    rng = random.Random(5)
    lookup = [(i, rng.choice("abc"), rng.choice("xyz"), rng.choice([1, 2, None])) for i in range(30)]
    asked = [(i, rng.choice(["a", "b", None]), rng.choice(["x", "q", None]), rng.choice([1, None])) for i in range(60)]
    left = spark.createDataFrame(asked, "n int, a string, b string, c int")
    right = spark.createDataFrame(lookup, "pk int, a string, b string, c int")
    got = {r.n: r.target_id for r in lookups.resolve_by_values(left, ["a", "b", "c"], right, "pk").collect()}
    for n, *values in asked:
        given = [(i, v) for i, v in enumerate(values) if v is not None]
        hits = [row[0] for row in lookup if given and all(row[i + 1] == v for i, v in given)]
        assert got[n] == (min(hits) if hits else None)


def score_columns(source, targets):
    def norm(name):
        return name.lower().replace("_", "").replace(" ", "")

    exact = [t for t in targets if norm(t[2]) == norm(source)]
    near = [t for t in targets if norm(source) and (norm(source) in norm(t[2]) or norm(t[2]) in norm(source))]
    if exact:
        return (*exact[0][1:], 0.6)
    return (*near[0][1:], 0.5) if near else (None, None, 0.0)


def test_match_columns_equals_brute_force(spark):
    names = ["cust_id", "CustId", "id", "name", "full name", "email_addr", "email", "phone", "x", "created_at", "created"]
    targets = [(i, f"t{i % 3}", n) for i, n in enumerate(reversed(names))] + [(50, "t9", "custidentifier")]
    sources = [("s", n) for n in ["CUST_ID", "mail", "fullname", "zzz", "created_at_utc", "phone_no", "c"]]
    got = matching.match_columns(spark.createDataFrame(sources, "source_table string, source_column string"),
                                 spark.createDataFrame(targets, "position int, target_table string, target_column string"))
    for r in got.collect():
        assert (r.target_table, r.target_column, r.confidence) == score_columns(r.source_column, targets)


def test_rank_tables_equals_brute_force(spark):
    rng = random.Random(3)
    parts = ["user", "type", "school", "data", "station", "x"]
    targets = [(i, "_".join(rng.sample(parts, rng.randint(1, 2)))) for i in range(40)]
    sources = ["user", "user_type", "data", "school_data_x", "nothing", "_odd", "STATION"]
    got = matching.rank_tables(spark.createDataFrame([(s,) for s in sources], "source_table string"),
                               spark.createDataFrame(targets, "position int, target_table string"))
    found = {}
    for r in got.orderBy("source_table", "rank").collect():
        found.setdefault(r.source_table, []).append((r.target_table, r.score))
    for s in sources:
        def score(name, low=s.lower()):
            if low == name:
                return 1.0
            if low in name or name in low:
                return 0.7
            return 0.4 if any(p in name for p in low.split("_")) else 0.0

        expected = sorted(((score(n), i, n) for i, n in targets), key=lambda x: (-x[0], x[1]))[:5]
        assert found[s] == [(n, v) for v, _, n in expected]


def test_newer_wins_in_any_order(spark):
    at = [dt.datetime(2024, 1, d) for d in range(1, 8)]
    current = spark.createDataFrame([(1, at[3], "old"), (2, None, "none"), (3, at[1], "stay")],
                                    "k int, ts timestamp_ntz, v string")
    batch = [(1, at[2], "late", 1), (1, at[3], "tie", 2), (2, at[0], "dated", 3), (4, at[5], "a", 4), (4, at[6], "b", 5)]
    results = []
    for order in (batch, batch[::-1]):
        df = spark.createDataFrame(order, "k int, ts timestamp_ntz, v string, n int")
        merged = merge.upsert_newer(current, df, ["k"], "ts", ["n"])
        twice = merge.upsert_newer(merged, df, ["k"], "ts", ["n"])
        assert rows(merged, "k") == rows(twice, "k")
        results.append([(r[0], r[2]) for r in rows(merged, "k")])
    assert results[0] == results[1] == [(1, "tie"), (2, "dated"), (3, "stay"), (4, "b")]


def test_last_wins_and_key_only_rows(spark):
    current = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    batch = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, None, 1)], "k int, v string, n int")
    assert rows(merge.upsert_last(current, batch, ["k"], ["n"]), "k") == [(1, "a"), (2, "y"), (3, None)]
    keys = current.select("k")
    assert rows(merge.upsert_last(keys, batch.select("k"), ["k"]), "k") == [(1,), (2,), (3,)]


def test_scoped_delete_spares_lookups_and_others(spark):
    tables = {"school": (spark.createDataFrame([(1,), (2,), (3,)], "id int"), "id"),
              "region": (spark.createDataFrame([(1,)], "id int"), "id")}
    links = spark.createDataFrame([
        ("e", "S", "school", "1"), ("e", "S", "region", "1"), ("other", "S", "school", "2"), ("e", "S", "legacy", "9")],
        "source_entity string, target_system string, target_table string, target_id string")
    left, crosswalk, counts = merge.scoped_delete(tables, links, "e", "S", ["region"])
    assert rows(left["school"], "id") == [(2,), (3,)] and left["region"].count() == 1
    assert rows(counts, "target_table") == [("school", 1)]
    assert sorted(r.target_table for r in crosswalk.collect()) == ["legacy", "region", "school"]


def test_snapshot_changes(spark):
    before = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    after = spark.createDataFrame([(2, "b"), (3, "C"), (4, "d")], "k int, v string")
    got = {r.k: (r.operation, json.loads(r.payload)) for r in merge.snapshot_changes(
        before, after, ["k"], F.lit("2024-01-01")).collect()}
    assert got == {1: ("deactivate", {"k": 1, "v": "a", "active": False, "deactivated_at": "2024-01-01"}),
                   3: ("update", {"k": 3, "v": "C"}), 4: ("insert", {"k": 4, "v": "d"})}


def test_backoff_series(spark):
    df = spark.range(1, 13)
    got = [r[0] for r in df.orderBy("id").select(events.backoff_seconds(F.col("id"))).collect()]
    assert got == [min(3600, 15 * 2 ** min(n, 10)) for n in range(1, 13)]


CATALOG = "table_name string, position int, column_name string, data_type string, nullable boolean, is_primary_key boolean"


def catalog(spark, *columns):
    return spark.createDataFrame([(t, i, c, d, n, p) for i, (t, c, d, n, p) in enumerate(columns)], CATALOG)


@pytest.mark.parametrize("old, new, kind, breaking", [
    ([], [("t", "c", "string", True, False)], "table_added", False),
    ([("t", "c", "string", True, False)], [], "table_removed", True),
    ([("t", "c", "string", True, False)], [("t", "c", "integer", True, False)], "column_changed", True),
    ([("t", "c", "string", True, False)], [("t", "c", "string", True, True)], "column_changed", True),
    ([("t", "c", "string", True, False)], [("t", "c", "string", False, False)], "column_changed", True),
    ([("t", "c", "string", False, False)], [("t", "c", "string", True, False)], "column_changed", False),
    ([("t", "c", "string", True, False)], [("t", "c", "string", True, False), ("t", "d", "string", True, False)],
     "column_added", False),
    ([("t", "c", "string", True, False)], [("t", "c", "string", True, False), ("t", "d", "string", False, False)],
     "column_added", True),
    ([("t", "c", "string", True, False), ("t", "d", "string", True, False)], [("t", "c", "string", True, False)],
     "column_removed", True),
])
def test_breaking_rules(spark, old, new, kind, breaking):
    got = drift.contract_changes(catalog(spark, *old), catalog(spark, *new)).collect()
    assert [(r.kind, r.breaking) for r in got] == [(kind, breaking)]


def test_fingerprint_equals_python(spark):
    import hashlib

    df = catalog(spark, ("b", "x", "string", True, False), ("a", "id", "integer", False, True), ("a", "né", "text", True, False))

    def column(name, kind, nullable, key):
        return {"name": name, "data_type": kind, "nullable": nullable, "is_primary_key": key, "is_foreign_key": False,
                "references": None, "enum_values": None, "description": "", "sample_values": []}

    document = {"system_name": "SYS", "version": "1", "tables": [
        {"name": "a", "columns": [column("id", "integer", False, True), column("né", "text", True, False)]},
        {"name": "b", "columns": [column("x", "string", True, False)]}]}
    expected = hashlib.sha256(json.dumps(document, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    feet = spark.createDataFrame([("e", "a"), ("e", "b"), ("f", "gone")], "source_entity string, table_name string")
    assert rows(drift.entity_fingerprints(df, feet, "SYS"), "source_entity") == [("e", expected)]
    moved = drift.entity_fingerprints(df.withColumn("nullable", F.lit(True)), feet, "SYS")
    assert moved.first().fingerprint != expected


def test_unrelated_tables_do_not_move_a_fingerprint(spark):
    df = catalog(spark, ("a", "id", "integer", False, True))
    wider = df.unionByName(catalog(spark, ("z", "id", "integer", False, True)))
    feet = spark.createDataFrame([("e", "a")], "source_entity string, table_name string")
    assert rows(drift.entity_fingerprints(df, feet, "S"), "source_entity") == \
        rows(drift.entity_fingerprints(wider, feet, "S"), "source_entity")


def test_file_states(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    stored = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4")], "path string, fingerprint string")
    assert [(r.path, r.state) for r in drift.file_drift(files, stored).orderBy("path").collect()] == [
        ("a", "match"), ("b", "drifted"), ("c", "unversioned"), ("d", "missing")]


@pytest.mark.parametrize("text, expected", [
    ('duplicate key value violates unique constraint "school_pkey"\nDETAIL:  Key (id)=(42) already exists.',
     ("duplicate_key", "school", "id", "42")),
    ("1062 (23000): Duplicate entry '42' for key 'school.PRIMARY'", ("duplicate_key", None, "id", "42")),
    ("Duplicate entry '42' for key 'school_pkey'", ("duplicate_key", "school", "id", "42")),
    ("no row in reference table area matches {'code': '17', 'name': 'x'}", ("reference_match_missing", "area", "code", "17")),
    ("area.id='77' does not exist; area is read-only", ("read_only_reference_missing", "area", "id", "77")),
    ("area.id=77 does not exist; other is read-only", ("unknown", None, None, None)),
    ("user.birth date year 20203 is outside supported range", ("data_quality", "user", "birth", "20203")),
    ("connection reset", ("unknown", None, None, None)),
])
def test_error_texts(spark, text, expected):
    r = diagnose.classify(spark.createDataFrame([(text,)], "error string")).first()
    assert (r.category, r.target_table, r.target_column, r.target_id) == expected


def test_missing_columns_are_all_listed(spark):
    text = "not deployable:\n  - a.id is required but no source column maps to it\n  - b.name is required but no source column maps to it"
    r = diagnose.classify(spark.createDataFrame([(text,)], "error string")).first()
    assert r.category == "missing_required_mapping" and r.detail == ["a.id", "b.name"]


def test_flatten_names_and_order(spark):
    a = spark.createDataFrame([(1, "x")], "id int, name string")
    b = spark.createDataFrame([(1, "y")], "id int, name string")
    got = compare.flatten({"a": a, "b": b}, "a", [("a", "id", "b", "id")], [("a", "name"), ("b", "name"), ("b", "name")])
    assert got.columns == ["name", "b_name", "b_name_2"] and tuple(got.first()) == ("x", "y", "y")
    with pytest.raises(ValueError, match="before"):
        compare.flatten({"a": a, "b": b}, "a", [("b", "id", "a2", "id")], [("a", "id")])


def test_page_is_clamped(spark):
    df = spark.range(250).withColumnRenamed("id", "k")
    assert ordering.page(df, "k", "asc", 0, 1000, "k").count() == 100
    assert ordering.page_info(df.limit(0), 10).first().pages == 1
    with pytest.raises(ValueError, match="unknown sort"):
        ordering.page(df, "k; drop", "asc", 1, 10, "k")
    with pytest.raises(ValueError, match="direction"):
        ordering.page(df, "k", "sideways", 1, 10, "k")


def test_export_and_discovery_catalogs(spark):
    document = '{"customers":[{"name":"id","type":"INT","nullable":false,"primary_key":true},{"name":"note"}]}'
    got = contract_sources.from_export(spark.createDataFrame([(document,)], "d string"), "d")
    assert rows(got, "position") == [("customers", 0, "id", "integer", False, True), ("customers", 1, "note", "string", True, False)]
    found = spark.createDataFrame([("t", 1, "id", "bigint", "no", "PRI"), ("t", 2, "x", "varchar(3)", None, None)],
                                  "table_name string, ordinal_position int, column_name string, data_type string, "
                                  "is_nullable string, column_key string")
    assert rows(contract_sources.from_discovery(found), "position") == [
        ("t", 1, "id", "integer", False, True), ("t", 2, "x", "string", True, False)]


def test_snapshots_keep_the_last_version(spark):
    store = Snapshots(spark, shared_folder(spark))
    assert store.current() is None
    store.publish(spark.range(3))
    before = store.current()
    store.publish(before.union(spark.range(10, 12)))
    assert before.count() == 3 and store.current().count() == 5 and store.version() == 2
    broken = spark.range(1).select(F.raise_error(F.lit("boom")).alias("id"))
    with pytest.raises(Exception, match="boom"):
        store.publish(broken)
    assert store.version() == 2 and store.current().count() == 5
    other = Snapshots(spark, shared_folder(spark))
    other.publish(spark.range(4))
    assert rebuild({"a": store, "b": other}, {"a": spark.range(0), "b": spark.range(0)}, {"b"}) == ["a"]
    assert store.current().count() == 0 and other.current().count() == 4


def test_materialise_keeps_rows(spark):
    df = spark.range(100).selectExpr("id", "named_struct('a', id) AS s")
    assert rows(materialise(df), "id") == rows(df, "id")


def test_hot_natural_key_shares_one_id(spark):
    source = spark.range(900).select(
        F.sha1(F.col("id").cast("string")).alias("external_reference"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 10 == 1, None)
        .otherwise(F.concat(F.lit("n"), F.col("id") % 50)).alias("name"), (F.col("id") % 2).alias("side"))
    target = spark.createDataFrame([(3, "n7", 1), (4, "hot", 0)], "id bigint, name string, side bigint")
    links = spark.createDataFrame([], "external_reference string, target_id string")
    got = lookups.match_or_allocate(source, links, target, "id", 100, ["name", "side"]).collect()
    assert len(got) == 900 and len({r.external_reference for r in got}) == 900
    ids = {}
    for r in got:
        ids.setdefault((r.name, r.side), set()).add(r.target_id)
    assert all(len(v) == 1 for v in ids.values())
    assert ids[("hot", 0)] == {4} and ids[("n7", 1)] == {3}
    assert ids[(None, 1)] == {3} and (None, 0) not in ids or ids[(None, 0)] == {4}
    fresh = sorted({i for v in ids.values() for i in v if i >= 100})
    assert fresh == list(range(100, 100 + len(fresh)))
    assert sum(r.action == "insert" for r in got) == len(fresh)


def test_hot_reference_value(spark):
    rows_in = spark.range(600).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 5 WHEN id % 7 = 1 THEN NULL ELSE id % 40 END AS fk")
    parents = spark.range(0, 40, 2).selectExpr("id AS pk", "id + 1000 AS tid")
    links = parents.select(
        F.lit("a").alias("source_entity"), external_reference("S", "x", "a", [(F.col("pk"), T.LongType())])
        .alias("external_reference"), F.col("tid").cast("string").alias("target_id")).unionByName(
        spark.createDataFrame([(5,)], "pk bigint").select(
            F.lit("b").alias("source_entity"), external_reference("S", "x", "b", [(F.col("pk"), T.LongType())])
            .alias("external_reference"), F.lit("1005").alias("target_id")))
    target = spark.range(1000, 1040).withColumnRenamed("id", "tid").filter("tid <> 1004")
    got = lookups.resolve_references(rows_in, "fk", "out", links, target, "tid", ["b", "a"], "S", "x", ["id"])
    for r in got.collect():
        alive = r.fk is not None and (r.fk == 5 or (r.fk % 2 == 0 and r.fk != 4))
        assert r.out == (1000 + r.fk if alive else None)
    assert got.count() == 600


def test_orphans_of_a_hot_key(spark):
    child = spark.range(300).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 99 WHEN id % 3 = 1 THEN 1 END AS fk")
    lost = validation.orphans(
        child, "fk", spark.createDataFrame([(1,)], "k bigint"), "k")
    assert rows(lost.select("id"), "id") == [(i,) for i in range(0, 300, 3)]


def test_observed_counts_come_with_the_write(spark):
    df = spark.createDataFrame([("delivered",), ("delivered",), ("retry",), ("quarantined",)], "outcome string")
    watched, seen = metrics.observed(df)
    watched.write.format("noop").mode("overwrite").save()
    assert seen.get == {"claimed": 4, "delivered": 2, "quarantined": 1, "retried": 1}
    assert metrics.run_summary(df).first().asDict() == seen.get


def test_job_failures_in_every_place(spark):
    results = ['{"results":[{"entity":"a","status":"FAILED"},{"entity":"b","status":"ok"}]}',
               '{"redeliver":{"entities":[{"table":"c","status":"done","error":"late"}]},"entities":[{"source_table":"d","status":"skipped"}]}',
               '{"results":{"results":[],"entities":[{"entity":"e","status":"error"}]}}', "no json", None]
    df = spark.createDataFrame(list(enumerate(results)), "job_id int, result string")
    got = metrics.job_failures(df).select("job_id", "entity", "status", "error")
    assert rows(got, "job_id", "entity") == [
        (0, "a", "FAILED", None), (1, "c", "done", "late"), (1, "d", "skipped", None), (2, "e", "error", None)]


@pytest.mark.parametrize("broadcast", ["10485760", "-1"])
def test_lookup_by_any_given_values(spark, broadcast):
    """Random sets of given values, some of few different values, against comparing all pairs; without broadcast also through the shuffle."""
    rng = random.Random(4)
    columns = [f"c{k}" for k in range(8)]
    value = lambda k: rng.choice([None, *range(1 + k)])
    lookup = [(n, *[value(k) for k in range(8)]) for n in range(60)]
    asked = [(n, *[value(k) if rng.random() < 0.5 else None for k in range(8)]) for n in range(300)]
    schema = ", ".join(["id bigint", *[f"{c} int" for c in columns]])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        source = spark.createDataFrame(asked, schema).withColumnRenamed("id", "n").withColumn("external_reference", F.col("n").cast("string"))
        got = lookups.resolve_by_values(source, columns, spark.createDataFrame(lookup, schema), "id", weigh=source)
        found = dict(rows(got.select("n", "target_id"), "n"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for n, *given in asked:
        fits = [i for i, *have in lookup if any(g is not None for g in given) and all(g is None or g == h for g, h in zip(given, have))]
        assert found[n] == min(fits, default=None)


def test_ids_of_any_keys(spark):
    keys = ["", "a", "a" * 300, "zz", "é", "漢", *[f"same-{k:05}" for k in range(2000)], *[str(k) for k in range(500)]]
    df = spark.createDataFrame([(k,) for k in keys], "ref string").repartition(6)
    expected = [(k, i) for i, k in enumerate(sorted(keys, key=str.encode), 7)]
    for ranges in (None, 1, 5, 64):
        got = ordering.allocate_ids(df, "ref", "id", 7, ranges=ranges)
        assert sorted(map(tuple, got.select("ref", "id").collect()), key=lambda r: r[1]) == expected


def test_small_shares_are_split(spark):
    """A key with 1.9 % of the rows gets parts, more of them the larger its share is."""
    skewed = spark.range(200_000).selectExpr("id", "CASE WHEN id % 53 = 0 THEN -1 WHEN id % 3 = 0 THEN -2 ELSE id END AS k")
    shares = dict(skew.key_shares(skewed, "k", 0.01))
    assert set(shares) == {-1, -2} and abs(shares[-1] - 1 / 53) < 0.001
    other = spark.createDataFrame([(-1, "x"), (-2, "y"), (5, "z")], "k bigint, v string")
    joined = skew.spread_join(skewed, other, "k", "inner", ["id"], share=0.01)
    assert joined.count() == skewed.join(other, "k").count()


def test_a_column_is_held_by_bits_of_its_values(spark):
    """More columns than one whole number has bits for, and no sets of columns kept per value."""
    wide = spark.createDataFrame([tuple(range(k, k + 70)) for k in (0, 70)] + [(None,) * 70], ", ".join(f"x_{k} int" for k in range(70)))
    keys = spark.createDataFrame([(k, str(k)) for k in [*range(0, 60), *range(65, 200)] * 2], "x_5 bigint, x_text string")
    frames = {"keyed": keys, "wide": wide, "empty": keys.limit(0).select(F.col("x_5").alias("x_0"))}
    found = contract_sources.inclusions(frames, {"keyed": "x_5", "wide": "x_5"})
    expected = [("wide", f"x_{k}", "keyed", "x_5") for k in range(70) if not 60 <= k < 65]
    assert sorted(rows(found, "table_name")) == sorted(expected)
    assert rows(contract_sources.foreign_keys(frames, {"keyed": "x_5"}), "column_name") == [("wide", "x_5", "keyed", "x_5")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "collect_set" not in plan


def test_events_of_one_entity_are_claimed_in_many_tasks(spark):
    box = spark.range(0, 4000, 1, 8).selectExpr(
        "id AS event_id", "CASE WHEN id % 100 = 0 THEN 'other' ELSE 'one' END AS source_entity", "'T' AS target_system", "'pending' AS status",
        "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS available_at")
    control = spark.createDataFrame([("one", "T", True), ("other", "T", False)], "source_entity string, target_system string, enabled boolean")
    due = events.claimable(box, control, F.expr("TIMESTAMP_NTZ '2024-01-02 00:00:00'"))
    held = [r["n"] for r in due.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(held) == 3960 and max(held) <= 500


@pytest.mark.parametrize("n", [1, 40, 41, 90, 300, 900])
def test_the_oldest_of_many_are_not_brought_into_one_task(spark, n, monkeypatch):
    monkeypatch.setattr(ordering, "ROWS_PER_RANGE", 40)
    monkeypatch.setattr(ordering, "is_small", lambda df: False)
    at = [None if k % 50 == 0 else dt.datetime(2024, 1, 1 + k * 7 % 5) for k in range(400)]
    box = spark.createDataFrame([(k, t, "p" * k) for k, t in enumerate(at)], "event_id bigint, at timestamp_ntz, payload string")
    found = ordering.oldest(box, "at", "event_id", n)
    order = sorted(range(400), key=lambda k: (at[k] is not None, at[k] or dt.datetime.min, k))
    assert sorted(r.event_id for r in found.collect()) == sorted(order[:n]) and found.columns == box.columns
    assert ("TakeOrdered" in found._jdf.queryExecution().executedPlan().toString()) == (n <= 40)


def test_only_ages_are_numbered_for_the_oldest(spark, monkeypatch):
    """Whole rows are taken where they lie, and of rows of one age no more than asked for."""
    numbered = []
    plain = ordering.allocate_ids
    monkeypatch.setattr(ordering, "ROWS_PER_RANGE", 40)
    monkeypatch.setattr(ordering, "allocate_ids", lambda keys, *rest: numbered.append(keys.columns) or plain(keys, *rest))
    box = spark.range(300).selectExpr("id DIV 3 AS event_id", "CAST(NULL AS TIMESTAMP_NTZ) AS at", "'p' || id AS payload")
    for n in (60, 61, 62, 299, 301):
        found = ordering.oldest(box, "at", "event_id", n).collect()
        assert sorted(r.event_id for r in found) == [k // 3 for k in range(min(n, 300))]
        assert len({r.payload for r in found}) == len(found)
    assert numbered == [["_age"]] * 5


@pytest.mark.parametrize("small", [False, True])
def test_rows_apart_by_repeated_keys(spark, monkeypatch, small):
    monkeypatch.setattr(ordering, "is_small", lambda df: small)
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (None, "c"), (None, "c"), (2, None)], "k bigint, v string")
    single, several = ordering.by_repeats(df, "k", "v")
    assert sorted(map(str, single.collect())) == ([] if small else ["Row(k=1, v='a')", "Row(k=2, v=None)"])
    assert single.count() + several.count() == 6
    assert all(ordering.by_repeats(df.dropDuplicates(), "k", "v")[small].count() == n for n in [4])


@pytest.mark.parametrize("small", [False, True])
def test_rows_of_asked_keys(spark, monkeypatch, small):
    monkeypatch.setattr(lookups, "is_small", lambda df: small)
    held = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k bigint, v string")
    asked = spark.createDataFrame([(1,), (1,), (None,), (9,)], "k bigint")
    assert sorted(r.v for r in lookups.rows_of(held, asked, "k").collect()) == ["a", "b"]
    assert lookups.rows_of(held, asked.filter("k = 9"), "k").collect() == []
