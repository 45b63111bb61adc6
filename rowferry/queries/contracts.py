"""Contracts as data: fingerprints, drift and the jobs over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift
from ..plans import contract_jobs
from ..sources import tables
from ..sources.workspace import shared_folder
from .fixtures import TARGET, catalog, fixture, footprints, sql, table
from .joins import _MATCH, _SOURCE_NAMES, _TARGET_NAMES
from .registry import query

_COLUMN_JSON = (
    "'{\"data_type\":\"' || data_type || '\",\"description\":\"\",\"enum_values\":null,\"is_foreign_key\":false,"
    "\"is_primary_key\":' || CAST(is_primary_key AS VARCHAR) || ',\"name\":\"' || column_name || '\",\"nullable\":' || "
    "CAST(nullable AS VARCHAR) || ',\"references\":null,\"sample_values\":[]}'")


def _docs(view):
    return (f"SELECT table_name, '{{\"columns\":[' || string_agg({_COLUMN_JSON}, ',' ORDER BY position) || '],\"name\":\"' || "
            f"table_name || '\"}}' AS doc FROM {view} GROUP BY table_name")


def _hash(docs):
    return f"sha256('{{\"system_name\":\"{TARGET}\",\"tables\":[' || {docs} || '],\"version\":\"1\"}}')"


@query("e10_table_fingerprint", sql(f"SELECT table_name, {_hash('doc')} AS fingerprint FROM docs", "catalog_v1",
                                    extra={"docs": _docs("catalog_v1")}))
def table_fingerprint(spark, folder):
    return drift.table_fingerprints(catalog(spark, folder, 1), TARGET)


def _entity_hash(docs):
    listed = _hash("string_agg(doc, ',' ORDER BY table_name)")
    return f"SELECT source_entity, {listed} AS fingerprint FROM footprints JOIN {docs} USING (table_name) GROUP BY 1"


@query("e10_entity_fingerprint", sql(_entity_hash("docs"), "catalog_v1", "footprints",
                                     extra={"docs": _docs("catalog_v1")}))
def entity_fingerprint(spark, folder):
    return drift.entity_fingerprints(catalog(spark, folder, 1), footprints(spark, folder), TARGET)


_CHANGES = {
    "joined": "SELECT COALESCE(a.table_name, b.table_name) AS t, COALESCE(a.column_name, b.column_name) AS c, a.table_name IS NOT "
            "NULL AS had, b.table_name IS NOT NULL AS has, a.data_type AS t0, b.data_type AS t1, a.nullable AS n0, b.nullable AS "
            "n1, a.is_primary_key AS p0, b.is_primary_key AS p1 FROM catalog_v1 a FULL OUTER JOIN catalog_v2 b ON a.table_name = "
            "b.table_name AND a.column_name = b.column_name",
    "tabs": "SELECT t, bool_or(had) AS had, bool_or(has) AS has FROM joined GROUP BY t",
    "changes": "SELECT t AS table_name, NULL AS column_name, CASE WHEN had THEN 'table_removed' ELSE 'table_added' END AS kind, had "
               "AS breaking, '' AS changes FROM tabs WHERE NOT had OR NOT has UNION ALL SELECT t, c, CASE WHEN NOT b.had THEN "
               "'column_added' WHEN NOT b.has THEN 'column_removed' ELSE 'column_changed' END, CASE WHEN NOT b.had THEN NOT n1 "
               "WHEN NOT b.has THEN true ELSE t0 <> t1 OR p0 <> p1 OR (n0 AND NOT n1) END, CASE WHEN b.had AND b.has THEN "
               "concat_ws(';', CASE WHEN t0 <> t1 THEN 'data_type:' || t0 || '>' || t1 END, CASE WHEN n0 <> n1 THEN 'nullable:' "
               "|| CAST(n0 AS VARCHAR) || '>' || CAST(n1 AS VARCHAR) END, CASE WHEN p0 <> p1 THEN 'is_primary_key:' || CAST(p0 AS "
               "VARCHAR) || '>' || CAST(p1 AS VARCHAR) END) ELSE '' END FROM joined b JOIN tabs USING (t) WHERE tabs.had AND "
               "tabs.has AND (NOT b.had OR NOT b.has OR t0 <> t1 OR n0 <> n1 OR p0 <> p1)",
}


def _changes(spark, folder):
    return drift.contract_changes(catalog(spark, folder, 1), catalog(spark, folder, 2))


@query("i1_contract_diff", sql("SELECT * FROM changes", "catalog_v1", "catalog_v2", extra=_CHANGES))
def contract_diff(spark, folder):
    text = F.transform("changes", lambda c: F.concat(c["attribute"], F.lit(":"), c["before"], F.lit(">"), c["after"]))
    return _changes(spark, folder).withColumn("changes", F.array_join(text, ";"))


_STRUCTURE = {
    **{k: _CHANGES[k] for k in ("joined", "tabs")},
    "structure": "SELECT t AS table_name, CASE WHEN NOT bool_or(had) THEN 'added' WHEN NOT bool_or(has) THEN 'removed' ELSE "
                 "'changed' END AS state, CASE WHEN bool_or(had) AND bool_or(has) THEN COALESCE(string_agg(c, ',' ORDER BY c) FILTER "
                 "(WHERE NOT had), '') ELSE '' END AS added_columns, CASE WHEN bool_or(had) AND bool_or(has) THEN COALESCE("
                 "string_agg(c, ',' ORDER BY c) FILTER (WHERE NOT has), '') ELSE '' END AS removed_columns, CASE WHEN bool_or(had) "
                 "AND bool_or(has) THEN COALESCE(string_agg(c, ',' ORDER BY c) FILTER (WHERE had AND has AND (t0 <> t1 OR n0 <> "
                 "n1)), '') ELSE '' END AS changed_columns FROM joined GROUP BY t HAVING count(*) FILTER (WHERE NOT had OR NOT has OR "
                 "t0 <> t1 OR n0 <> n1) > 0",
}
_LISTS = ("added_columns", "removed_columns", "changed_columns")


@query("i2_structural_diff", sql("SELECT * FROM structure", "catalog_v1", "catalog_v2", extra=_STRUCTURE))
def structural_diff(spark, folder):
    found = drift.structural_changes(catalog(spark, folder, 1), catalog(spark, folder, 2))
    return found.select("table_name", "state", *[F.array_join(c, ",").alias(c) for c in _LISTS])


_EVEN = "CAST(substr(table_name, 5) AS BIGINT) % 2 = 0"


@query("i3_source_diff", sql(
    "SELECT e AS source_entity, NOT COALESCE(live, false) AS missing_table, COALESCE(added, '') AS added_columns, COALESCE(gone, '') "
    "AS removed_columns, COALESCE(changed, '') AS changed_columns, CASE WHEN CAST(substr(e, 5) AS BIGINT) % 2 = 0 THEN 'document' "
    "ELSE 'approved_columns' END AS contract_source, NOT COALESCE(live, false) OR COALESCE(gone, '') <> '' OR COALESCE(changed, '') "
    "<> '' AS affected FROM ents LEFT JOIN grouped USING (e)", "catalog_v1", "catalog_v2", extra={
        "ents": "SELECT DISTINCT table_name AS e FROM catalog_v1",
        "old": f"SELECT table_name AS e, column_name AS c, data_type AS t, nullable AS n, false AS names FROM catalog_v1 WHERE "
               f"{_EVEN} UNION ALL SELECT table_name, column_name, NULL, NULL, true FROM catalog_v1 WHERE NOT {_EVEN} AND "
               "position <> 2",
        "now_": "SELECT table_name AS e, column_name AS c, data_type AS t, nullable AS n FROM catalog_v2 WHERE table_name IN "
                "(SELECT e FROM ents)",
        "b": "SELECT COALESCE(o.e, n.e) AS e, COALESCE(o.c, n.c) AS c, o.e IS NOT NULL AS had, n.e IS NOT NULL AS has, NOT o.names "
             "AND (o.t <> n.t OR o.n <> n.n) AS retyped FROM old o FULL OUTER JOIN now_ n ON o.e = n.e AND o.c = n.c",
        "grouped": "SELECT e, bool_or(has) AS live, string_agg(c, ',' ORDER BY c) FILTER (WHERE NOT had) AS added, string_agg(c, "
                   "',' ORDER BY c) FILTER (WHERE NOT has) AS gone, string_agg(c, ',' ORDER BY c) FILTER (WHERE had AND has AND "
                   "retyped) AS changed FROM b GROUP BY e",
    }))
def source_diff(spark, folder):
    old = catalog(spark, folder, 1).withColumnRenamed("table_name", "source_entity")
    even = "CAST(substr(source_entity, 5) AS BIGINT) % 2 = 0"
    found = drift.source_changes(
        old.select("source_entity").distinct(), old.filter(even), old.filter("position <> 2"), catalog(spark, folder, 2))
    return found.select("source_entity", "missing_table", *[F.array_join(c, ",").alias(c) for c in _LISTS],
                        "contract_source", "affected")


_CONTROL = ("source_entity", "s_suppkey % 13 <> 0 AS enabled", "CASE WHEN s_suppkey % 13 = 0 THEN 'manual' END AS paused_reason")
_VERSIONS = ("source_entity", "CASE WHEN s_suppkey % 4 = 0 THEN 'superseded' ELSE 'approved' END AS status")
_IMPACTED = {
    **_CHANGES,
    "impacted": "SELECT DISTINCT source_entity FROM footprints WHERE table_name IN (SELECT table_name FROM changes WHERE breaking)",
}


@query("i4_drift_pause", sql(
    "SELECT source_entity, CASE WHEN i.source_entity IS NOT NULL THEN false ELSE s_suppkey % 13 <> 0 END AS enabled, CASE WHEN "
    "i.source_entity IS NOT NULL THEN 'Breaking schema drift abcdef012345' WHEN s_suppkey % 13 = 0 THEN 'manual' END AS "
    "paused_reason, CASE WHEN s_suppkey % 4 = 0 THEN 'superseded' WHEN i.source_entity IS NOT NULL THEN 'paused' ELSE 'approved' "
    "END AS mapping_status FROM entities LEFT JOIN impacted i USING (source_entity)", "catalog_v1", "catalog_v2", "footprints",
    "entities", extra=_IMPACTED))
def drift_pause(spark, folder):
    entities = fixture(spark, folder, "entities")
    impacted = drift.impacted_by_breaking(_changes(spark, folder), footprints(spark, folder))
    control, versions = drift.pause_entities(
        entities.selectExpr(*_CONTROL), entities.selectExpr(*_VERSIONS), impacted, F.lit("abcdef0123456789"))
    return control.join(versions.withColumnRenamed("status", "mapping_status"), "source_entity")


_STORED = {
    "docs1": _docs("catalog_v1"), "docs2": _docs("catalog_v2"),
    "hash1": _entity_hash("docs1"), "hash2": _entity_hash("docs2"),
    "src1": f"SELECT 'ent_' || substr(table_name, 5) AS source_entity, {_hash('doc')} AS fingerprint FROM docs1",
    "src2": f"SELECT 'ent_' || substr(table_name, 5) AS source_entity, {_hash('doc')} AS fingerprint FROM docs2 WHERE table_name "
            "LIKE 'tbl_%'",
    "flags": "SELECT e.source_entity, s_suppkey % 9 <> 0 AND a.fingerprint IS NOT NULL AND a.fingerprint IS DISTINCT FROM "
             "b.fingerprint AS source_drift, s_suppkey % 9 <> 0 AND c.fingerprint IS NOT NULL AND c.fingerprint IS DISTINCT FROM "
             "d.fingerprint AS target_drift, s_suppkey % 9 = 0 AS rebaseline_required FROM entities e LEFT JOIN src1 a USING "
             "(source_entity) LEFT JOIN src2 b USING (source_entity) LEFT JOIN hash1 c USING (source_entity) LEFT JOIN hash2 d "
             "USING (source_entity)",
}


def _entity_of_table(prints):
    return prints.filter("table_name LIKE 'tbl_%'").select(
        F.concat(F.lit("ent_"), F.expr("substr(table_name, 5)")).alias("source_entity"), "fingerprint")


def _stored(spark, folder):
    entities = fixture(spark, folder, "entities").selectExpr(
        "source_entity", "CASE WHEN s_suppkey % 9 = 0 THEN 1 ELSE 2 END AS scope_version")
    before = catalog(spark, folder, 1)
    source = _entity_of_table(drift.table_fingerprints(before, TARGET)).withColumnRenamed("fingerprint", "source_fingerprint")
    target = drift.entity_fingerprints(before, footprints(spark, folder), TARGET).withColumnRenamed(
        "fingerprint", "target_fingerprint")
    return entities.join(source, "source_entity", "left").join(target, "source_entity", "left")


@query("i5_fingerprint_monitor", sql(
    "SELECT source_entity, source_drift, target_drift, source_drift OR target_drift AS paused, rebaseline_required FROM flags",
    "catalog_v1", "catalog_v2", "footprints", "entities", extra=_STORED))
def fingerprint_monitor(spark, folder):
    after = catalog(spark, folder, 2)
    return drift.monitor(_stored(spark, folder), _entity_of_table(drift.table_fingerprints(after, TARGET)),
                         drift.entity_fingerprints(after, footprints(spark, folder), TARGET))


_FILE = "CAST(floor(CAST(substr(table_name, 5) AS BIGINT) / 20) AS BIGINT)"


@query("i11_file_fingerprint", sql(
    "SELECT f AS file, CASE f % 4 WHEN 0 THEN 'match' WHEN 1 THEN 'drifted' WHEN 2 THEN 'missing' ELSE 'unversioned' END AS state "
    f"FROM (SELECT DISTINCT {_FILE} AS f FROM catalog_v1)", "catalog_v1"))
def file_fingerprint(spark, folder):
    documents = drift.table_documents(catalog(spark, folder, 1)).withColumn("file", F.expr(_FILE))

    def written(rows):
        path = shared_folder(spark)
        # One file holds twenty tables, so files grow in number, not in size.
        rows.repartition("file").sortWithinPartitions("file", "table_name").select("file", "document") \
            .write.partitionBy("file").text(path)
        return tables.file_hashes(spark, path).select(
            F.regexp_extract("path", r"file=(\d+)", 1).alias("path"), "sha256")

    stored = written(documents.filter("file % 4 <> 3")).withColumnRenamed("sha256", "fingerprint")
    changed = F.when(F.col("file") % 4 == 1, F.concat("document", F.lit(" "))).otherwise(F.col("document"))
    now = written(documents.filter("file % 4 <> 2").withColumn("document", changed))
    return drift.file_drift(now, stored).select(F.col("path").cast("bigint").alias("file"), "state")


@query("k7_contract_scan", sql(
    "SELECT source_entity FROM impacted UNION SELECT source_entity FROM flags WHERE source_drift OR target_drift", "catalog_v1",
    "catalog_v2", "footprints", "entities", extra={**_IMPACTED, **_STORED}))
def contract_scan(spark, folder):
    after = catalog(spark, folder, 2)
    _, _, paused = contract_jobs.contract_scan(
        catalog(spark, folder, 1), after, _stored(spark, folder), footprints(spark, folder),
        _entity_of_table(drift.table_fingerprints(after, TARGET)), TARGET)
    return paused


def _proposal(spark, folder):
    source = table(spark, folder, "part").selectExpr(*_SOURCE_NAMES)
    target = table(spark, folder, "supplier").selectExpr(*_TARGET_NAMES)
    required = target.selectExpr("target_table AS table_name", "target_column AS column_name", "position % 3 = 0 AS nullable")
    return contract_jobs.propose_mapping(source, target, required)


@query("k8_mapping_proposal", sql(
    "SELECT source_table, source_column, target_table, target_column, CASE WHEN kind IS NULL THEN 'rejected' ELSE 'pending' END AS "
    "status FROM srcs LEFT JOIN best ON n = lower(replace(replace(source_column, '_', ''), ' ', ''))", extra=_MATCH))
def mapping_proposal(spark, folder):
    return _proposal(spark, folder)[0].drop("confidence")


@query("k8_unmet_required", sql(
    "SELECT target_table AS table_name, target_column AS column_name FROM tgts WHERE position % 3 <> 0 AND target_column NOT IN "
    "(SELECT best.target_column FROM srcs JOIN best ON n = lower(replace(replace(source_column, '_', ''), ' ', '')))",
    extra=_MATCH))
def proposal_unmet(spark, folder):
    return _proposal(spark, folder)[2]


@query("k10_change_impact", sql(
    "SELECT source_entity, string_agg(DISTINCT table_name, ',' ORDER BY table_name) AS affected_tables FROM footprints WHERE "
    "table_name IN (SELECT table_name FROM structure) GROUP BY 1", "catalog_v1", "catalog_v2", "footprints", extra=_STRUCTURE))
def change_impact(spark, folder):
    _, entities = contract_jobs.change_impact(catalog(spark, folder, 1), catalog(spark, folder, 2), footprints(spark, folder))
    return entities.withColumn("affected_tables", F.array_join("affected_tables", ","))
