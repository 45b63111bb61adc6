"""Validation, quarantine and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..contracts import FieldMapping
from ..operators import matching, validation
from .fixtures import (
    MODEL, REMAP, REMAP_SQL, STRIP_SQL, as_of, catalog, fixture, outbox, sql, table,
)
from .registry import query

_MAPPINGS = (
    FieldMapping("c_custkey", "account", "id"), FieldMapping("c_name", "account", "name", "trim"),
    FieldMapping("c_mktsegment", "account", "segment", REMAP),
    FieldMapping("code_txt", "account", "code", "cast:str->int"),
    FieldMapping("c_acctbal", "account", "balance"),
)
_CHECKED = {
    "checked": (
        f"SELECT c_custkey, {STRIP_SQL} AS name, {REMAP_SQL} AS segment, c_acctbal AS balance, "
        "CASE WHEN code_txt IN ('12.5', 'abc') THEN 'transform failed for code_txt -> code: invalid literal for int() "
        "with base 10: ''' || code_txt || '''' END AS e1, "
        f"CASE WHEN COALESCE({STRIP_SQL}, '') = '' THEN 'required target field ''name'' is missing or null' END AS e2, "
        f"CASE WHEN {REMAP_SQL} NOT IN ('AUTO', 'BLDG', 'HOUSEHOLD', 'MACHINERY') THEN '''' || {REMAP_SQL} || "
        "''' is not a valid value for enum ''segment''' END AS e3 FROM src_customer"),
}


def _checked(spark, folder):
    return validation.transform_rows(fixture(spark, folder, "src_customer"), _MAPPINGS, MODEL, ["c_custkey"])


def _only(rows, pattern):
    return rows.select("c_custkey", F.explode("errors").alias("error")).filter(F.col("error").rlike(pattern))


@query("c1_required", sql("SELECT c_custkey, e2 AS error FROM checked WHERE e2 IS NOT NULL", "src_customer",
                          extra=_CHECKED))
def required(spark, folder):
    return _only(_checked(spark, folder), "^required target field")


@query("c2_enum_domain", sql("SELECT c_custkey, e3 AS error FROM checked WHERE e3 IS NOT NULL", "src_customer",
                             extra=_CHECKED))
def enum_domain(spark, folder):
    return _only(_checked(spark, folder), "is not a valid value")


@query("c3_transform_errors", sql("SELECT c_custkey, e1 AS error FROM checked WHERE e1 IS NOT NULL", "src_customer",
                                  extra=_CHECKED))
def transform_errors(spark, folder):
    return _only(_checked(spark, folder), "^transform failed")


@query("c4_unknown_columns", sql(
    "SELECT source_table, source_column, target_table, target_column FROM proposals p WHERE target_column IS NOT NULL AND "
    "NOT EXISTS (SELECT 1 FROM catalog_v2_kept c WHERE c.table_name = p.target_table AND c.column_name = p.target_column)",
    "proposals", "catalog_v2_kept"))
def unknown_columns(spark, folder):
    mapping = fixture(spark, folder, "proposals").filter("target_column IS NOT NULL").drop("confidence")
    return validation.unknown_columns(mapping, fixture(spark, folder, "catalog_v2_kept"))


@query("c5_error_lists", sql(
    "SELECT c_custkey, concat_ws('; ', e1, e2, e3) AS errors FROM checked", "src_customer", extra=_CHECKED))
def error_lists(spark, folder):
    return _checked(spark, folder).select("c_custkey", F.array_join("errors", "; ").alias("errors"))


@query("c6_good_rows", sql(
    "SELECT c_custkey, name, segment, balance FROM checked WHERE e1 IS NULL AND e2 IS NULL AND e3 IS NULL",
    "src_customer", extra=_CHECKED))
def good_rows(spark, folder):
    return validation.split(_checked(spark, folder))[0].select("c_custkey", "name", "segment", "balance")


@query("c6_split_counts", sql(
    "SELECT count(*) FILTER (WHERE e1 IS NULL AND e2 IS NULL AND e3 IS NULL) AS good, count(*) FILTER (WHERE e1 IS NOT NULL "
    "OR e2 IS NOT NULL OR e3 IS NOT NULL) AS failed, count(*) AS total FROM checked", "src_customer", extra=_CHECKED))
def split_counts(spark, folder):
    size = F.size("errors")
    return _checked(spark, folder).agg(F.count_if(size == 0).alias("good"), F.count_if(size > 0).alias("failed"),
                                       F.count("*").alias("total"))


def _failures(spark, folder):
    return outbox(spark, folder).filter("source_entity = 'error'").select(
        "event_id", F.array(F.lit("bad type"), F.concat(F.lit("value of "), F.col("payload"))).alias("errors"),
        F.col("payload").alias("payload_snapshot"))


@query("c7_quarantine_write", sql(
    "SELECT o.event_id, CASE WHEN o.source_entity = 'error' THEN 'bad type; value of ' || payload ELSE 'old' END AS errors, "
    "CASE WHEN o.event_id % 6 = 4 THEN 'before' ELSE payload END AS payload_snapshot FROM outbox o "
    "WHERE o.source_entity = 'error' OR o.event_id % 6 = 4", "outbox"))
def quarantine_write(spark, folder):
    held = outbox(spark, folder).filter("status = 'quarantined'").select(
        "event_id", F.array(F.lit("old")).alias("errors"), F.lit("before").alias("payload_snapshot"))
    merged = validation.quarantine_upsert(held, _failures(spark, folder))
    return merged.select("event_id", F.array_join("errors", "; ").alias("errors"), "payload_snapshot")


@query("c7_quarantine_status", sql(
    "SELECT event_id, CASE WHEN source_entity = 'error' THEN 'quarantined' ELSE status END AS status, CASE WHEN "
    "source_entity = 'error' THEN 'VALIDATION' ELSE last_error_code END AS last_error_code, CASE WHEN source_entity = 'error' "
    "THEN 'bad type; value of ' || payload ELSE last_error_message END AS last_error_message, CASE WHEN source_entity = "
    "'error' THEN TIMESTAMP '2024-01-15 00:00:00' ELSE processed_at END AS processed_at FROM outbox", "outbox"))
def quarantine_status(spark, folder):
    marked = validation.mark_quarantined(outbox(spark, folder), _failures(spark, folder), as_of())
    return marked.select("event_id", "status", "last_error_code", "last_error_message", "processed_at")


# The catalog with the flags coverage needs; every table's second column refers to the next table.
_FLAGS = ("table_name", "column_name", "nullable", "is_primary_key",
          "position = 5 AS has_default", "position = 0 AND table_name LIKE '%0' AS generated")
_KEYS = ("table_name", "column_name",
         "'tbl_' || CAST(CAST(substr(table_name, 5) AS BIGINT) + 1 AS STRING) AS ref_table")
_COVER = {
    "cat": f"SELECT {', '.join(_FLAGS)} FROM catalog_v1",
    "fks": f"SELECT {', '.join(_KEYS)} FROM catalog_v1 WHERE position = 1",
    "maps": "SELECT target_table, target_column FROM proposals WHERE target_column IS NOT NULL AND target_column <> '?' "
            "AND confidence > 0.3 AND target_table NOT LIKE '%3' UNION ALL SELECT source_table, 'stray' FROM proposals WHERE source_table LIKE '%7' "
            "UNION ALL SELECT target_table, 'stray' FROM proposals WHERE target_table LIKE '%5'",
}


def _coverage_inputs(spark, folder):
    cat = catalog(spark, folder, 1).selectExpr(*_FLAGS)
    fks = catalog(spark, folder, 1).filter("position = 1").selectExpr(*_KEYS)
    p = fixture(spark, folder, "proposals")
    maps = p.filter("target_column IS NOT NULL AND target_column <> '?' AND confidence > 0.3 AND target_table NOT LIKE '%3'") \
        .select("target_table", "target_column") \
        .unionByName(p.filter("source_table LIKE '%7'").selectExpr("source_table AS target_table", "'stray' AS target_column")) \
        .unionByName(p.filter("target_table LIKE '%5'").selectExpr("target_table", "'stray' AS target_column"))
    return cat, fks, maps


_COVER_LISTS = {
    **_COVER,
    "mapped": "SELECT DISTINCT target_table AS t, target_column AS c FROM maps",
    "tabs": "SELECT DISTINCT target_table AS t, EXISTS (SELECT 1 FROM cat WHERE table_name = target_table) AS there FROM maps",
    "sys": "SELECT DISTINCT c.table_name AS t, c.column_name AS c FROM cat c WHERE EXISTS (SELECT 1 FROM fks f WHERE "
           "f.table_name = c.table_name AND f.column_name = c.column_name) OR (c.table_name = 'tbl_1' AND c.is_primary_key)",
    "l_mapped": "SELECT t, string_agg(c, ',' ORDER BY c) AS v FROM mapped GROUP BY t",
    "l_unknown": "SELECT t, string_agg(c, ',' ORDER BY c) AS v FROM mapped m WHERE NOT EXISTS (SELECT 1 FROM cat WHERE "
                 "table_name = t AND column_name = c) GROUP BY t",
    "l_missing": "SELECT table_name AS t, string_agg(column_name, ',' ORDER BY column_name) AS v FROM cat WHERE NOT nullable "
                 "AND NOT has_default AND NOT generated AND NOT EXISTS (SELECT 1 FROM sys WHERE t = table_name AND c = "
                 "column_name) AND NOT EXISTS (SELECT 1 FROM mapped WHERE t = table_name AND c = column_name) GROUP BY 1",
    "l_system": "SELECT t, string_agg(c, ',' ORDER BY c) AS v FROM sys GROUP BY t",
    "report": "SELECT tabs.t AS table_name, there AS table_exists, CASE WHEN there THEN COALESCE(a.v, '') ELSE '' END AS "
              "mapped_columns, CASE WHEN there THEN COALESCE(b.v, '') ELSE '' END AS unknown_columns, CASE WHEN there THEN "
              "COALESCE(d.v, '') ELSE '' END AS required_missing, CASE WHEN there THEN COALESCE(e.v, '') ELSE '' END AS "
              "system_handled FROM tabs LEFT JOIN l_mapped a ON a.t = tabs.t LEFT JOIN l_unknown b ON b.t = tabs.t "
              "LEFT JOIN l_missing d ON d.t = tabs.t LEFT JOIN l_system e ON e.t = tabs.t",
}
_UNSATISFIED = (
    "SELECT DISTINCT f.table_name, f.column_name, f.ref_table FROM fks f JOIN cat c ON c.table_name = f.table_name AND "
    "c.column_name = f.column_name WHERE NOT c.nullable AND NOT c.has_default AND f.ref_table <> f.table_name AND f.table_name "
    "IN (SELECT target_table FROM maps) AND NOT EXISTS (SELECT 1 FROM maps m WHERE m.target_table = f.table_name AND "
    "m.target_column = f.column_name) AND f.ref_table NOT IN (SELECT target_table FROM maps) AND f.ref_table NOT IN "
    "(SELECT 'tbl_' || CAST(s_suppkey AS VARCHAR) FROM supplier)")


@query("c8_mapping_coverage", sql("SELECT * FROM report", "catalog_v1", "proposals", extra=_COVER_LISTS))
def mapping_coverage(spark, folder):
    report = matching.coverage(*_coverage_inputs(spark, folder), app_assigned=["tbl_1"])
    return report.select("table_name", "table_exists", *[
        F.array_join(c, ",").alias(c) for c in ("mapped_columns", "unknown_columns", "required_missing", "system_handled")])


def _unsatisfied(spark, folder):
    cat, fks, maps = _coverage_inputs(spark, folder)
    seeded = table(spark, folder, "supplier").selectExpr("'tbl_' || CAST(s_suppkey AS STRING) AS table_name")
    return matching.unsatisfiable_keys(cat, fks, maps, seeded)


@query("c8_blocking", sql(
    "SELECT table_name, 'target table ''' || table_name || ''' does not exist in the target schema' AS problem FROM report "
    "WHERE NOT table_exists UNION ALL SELECT table_name, table_name || '.' || c || ' is not a column of ' || table_name FROM "
    "(SELECT table_name, unnest(string_split(unknown_columns, ',')) AS c FROM report WHERE unknown_columns <> '') UNION ALL "
    "SELECT table_name, table_name || '.' || c || ' is required but no source column maps to it' FROM (SELECT table_name, "
    "unnest(string_split(required_missing, ',')) AS c FROM report WHERE required_missing <> '') UNION ALL SELECT table_name, "
    "table_name || '.' || column_name || ' requires a ' || ref_table || ' row, but ' || ref_table || ' is neither written by "
    "this mapping nor seeded' FROM unsat", "catalog_v1", "proposals", extra={**_COVER_LISTS, "unsat": _UNSATISFIED}))
def blocking(spark, folder):
    report = matching.coverage(*_coverage_inputs(spark, folder), app_assigned=["tbl_1"])
    return matching.blocking(report, _unsatisfied(spark, folder))


@query("c9_unsatisfiable_keys", sql(_UNSATISFIED, "catalog_v1", "proposals", extra=_COVER))
def unsatisfiable_keys(spark, folder):
    return _unsatisfied(spark, folder)


_GATE = ("CASE WHEN target_column IS NULL OR target_column = '?' OR confidence = 0 THEN 'rejected' WHEN confidence >= 0.95 "
         "THEN 'accepted' ELSE 'pending' END")


@query("c10_confidence_gate", sql(
    "SELECT source_table, source_column, " + _GATE + " AS gate, CASE WHEN confidence >= 0.95 THEN 'accepted' WHEN confidence = 0 "
    "OR target_column IS NULL OR target_column = '?' THEN 'rejected' ELSE 'pending' END AS review FROM proposals", "proposals"))
def confidence_gate(spark, folder):
    c, t = F.col("confidence"), F.col("target_column")
    return fixture(spark, folder, "proposals").select(
        "source_table", "source_column", matching.gate(c, t).alias("gate"), matching.review_status(c, t).alias("review"))


@query("c10_gate_counts", sql(
    "SELECT source_table, count(*) FILTER (WHERE g = 'accepted') AS auto_approved, count(*) FILTER (WHERE g = 'pending') AS "
    "needs_review, count(*) FILTER (WHERE g = 'rejected') AS rejected, CASE WHEN count(*) FILTER (WHERE g = 'pending') = 0 THEN "
    "'auto_approved' ELSE 'needs_review' END AS status FROM gated GROUP BY source_table", "proposals",
    extra={"gated": f"SELECT source_table, {_GATE} AS g FROM proposals"}))
def gate_counts(spark, folder):
    return matching.gate_counts(fixture(spark, folder, "proposals"), "source_table")


@query("c11_unmet_required", sql(
    "SELECT table_name, column_name FROM catalog_v1 WHERE NOT nullable AND column_name NOT IN (SELECT target_column FROM "
    "proposals WHERE target_column IS NOT NULL AND target_column <> '?' AND confidence >= 0.5)", "catalog_v1", "proposals"))
def unmet_required(spark, folder):
    mapped = fixture(spark, folder, "proposals").filter(
        "target_column IS NOT NULL AND target_column <> '?' AND confidence >= 0.5")
    return matching.unmet_required(catalog(spark, folder, 1), mapped)


@query("c12_orphans", (
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 20 <> 0)"))
def orphans(spark, folder):
    parents = table(spark, folder, "customer").filter("c_custkey % 20 <> 0")
    return validation.orphans(table(spark, folder, "orders"), "o_custkey", parents, "c_custkey").select(
        "o_orderkey", "o_custkey")


_LINKS = (("lineitem", "l_orderkey", "orders", "o_orderkey", "o_orderkey % 10 <> 0"),
          ("lineitem", "l_suppkey", "supplier", "s_suppkey", "s_suppkey % 10 <> 0"),
          ("orders", "o_custkey", "customer", "c_custkey", "c_custkey % 20 <> 0"),
          ("customer", "c_nationkey", "nation", "n_nationkey", "n_nationkey % 6 <> 0"))


@query("c12_referential_report", " UNION ALL ".join(
    f"SELECT '{c}.{k}' AS child, '{p}.{pk}' AS parent, count(*) AS orphans, count(DISTINCT {k}) AS missing_keys FROM {c} "
    f"WHERE {k} NOT IN (SELECT {pk} FROM {p} WHERE {cond})" for c, k, p, pk, cond in _LINKS))
def referential_report(spark, folder):
    return validation.referential_report([
        (c, table(spark, folder, c), k, p, table(spark, folder, p).filter(cond), pk) for c, k, p, pk, cond in _LINKS])
