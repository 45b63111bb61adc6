"""The queries of the training-text operators, with SQL where it can give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.union import separate_union_inputs
from ..sources.workspace import shared_folder
from .shipping import ship
from . import (
    byte_bpe, exact_dedup, hard_negatives, html_extract, license_scan, mixing, ngram_join, quality_classifier, quality_rules,
    secrets, token_counts, vector_codes, warc,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def prepare(spark: SparkSession) -> None:
    """What the operators need of a session, settings and code; calls after the first cost nothing."""
    separate_union_inputs(spark)
    ship(spark)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        def prepared(spark: SparkSession, folder: str) -> DataFrame:
            prepare(spark)
            return run(spark, folder)

        QUERIES[name] = prepared
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def vocabulary(name: str) -> bytes:
    """A vocabulary file, read by the driver: its size is fixed, and tasks get it with their code."""
    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


@query("op1_quality_rules")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality_rules.ledger(documents(spark, folder), keep=["doc_id"])
    policy = quality_rules.POLICIES[quality_rules.CURRENT]
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_rules.passes(quality_rules.BASE)).alias("base_failed"), quality_rules.passes(policy).alias("kept"),
        "failed_bits", F.lit(policy.version).alias("policy"))


@query("op2_byte_bpe")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    ranks = vocabulary("byte_bpe_multi_50k.tiktoken")
    rows = byte_bpe.encode(documents(spark, folder), ranks, decoded=True, keep=["doc_id"])
    return rows.select("doc_id", *byte_bpe.digests())


@query("op3_quality_classifier")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = quality_classifier.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return quality_classifier.score(docs, model, keep=["doc_id"]).select(
        "doc_id", quality_classifier.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op4_ngram_jaccard_join")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.similar_documents(documents(spark, folder))


@query("op5_license_scans")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    rows = license_scan.scan(docs.withColumn("path", license_scan.document_path()), license_scan.STATEMENTS)
    return rows.select("doc_id", "license", "score", "passages", "license_file", "effective_license", "licensed_by")


@query("op6_mixing", """
    WITH sized AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
            ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS draw
        FROM documents),
    sources AS (
        SELECT source, sum(size)::BIGINT AS source_size,
            [5, 2, 1][1 + ((row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3)::INTEGER] AS weight
        FROM sized GROUP BY source),
    marks AS (
        SELECT *, sum(3 * source_size) OVER w - 3 * source_size AS full_words, sum(weight) OVER w - weight AS full_weight,
            sum(source_size) OVER () AS total, sum(weight) OVER () AS weights
        FROM sources WINDOW w AS (ORDER BY 3 * source_size / weight, source ROWS UNBOUNDED PRECEDING)),
    level AS (
        SELECT (total - full_words)::DOUBLE / (weights - full_weight) AS level FROM marks
        WHERE (3 * source_size)::DOUBLE >= weight * ((total - full_words)::DOUBLE / (weights - full_weight))
        ORDER BY 3 * source_size / weight, source LIMIT 1),
    planned AS (
        SELECT source, source_size,
            CASE WHEN (3 * source_size)::DOUBLE < weight * level THEN (3 * source_size)::DOUBLE ELSE weight * level END AS target
        FROM sources, level),
    split AS (
        SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM planned),
    placed AS (
        SELECT sized.doc_id, sized.size, source_size, target, whole, target - whole * source_size AS rest,
            coalesce(sum(sized.size) OVER (PARTITION BY sized.source ORDER BY draw, sized.doc_id, sized.size
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM sized JOIN split ON sized.source IS NOT DISTINCT FROM split.source)
    SELECT doc_id, size, source_size, target,
        whole + CASE WHEN size > 0 AND 2 * before + size <= 2 * rest THEN 1 ELSE 0 END AS copies,
        (whole + CASE WHEN size > 0 AND 2 * before + size <= 2 * rest THEN 1 ELSE 0 END) * size AS taken
    FROM placed
""")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(documents(spark, folder))


@query("op7_token_counts")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    rows = token_counts.count_tokens(documents(spark, folder), vocabulary("byte_bpe_50k.json"), keep=["doc_id"])
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


@query("op8_html_extraction")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    rows = html_extract.main_text(pages, keep=["page_id", "url"])
    return rows.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query("op9_secret_scans")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    rows = secrets.scan(documents(spark, folder))
    spans = F.col("spans")
    return rows.select(
        "doc_id", *[secrets.count_kind(spans, kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(secrets.spelled(secrets.base_only(spans)), 256).alias("base_sha256"),
        secrets.spelled(spans).alias("spans"), secrets.count_kind(spans, "random").alias("n_random"))


@query("op10_exact_dedup", """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
        doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, folder))


def _lloyd_sql(rounds: int) -> str:
    """Complete Lloyd rounds: `a0` to `a{rounds}` are the assignments, `b0` to `b{rounds}` the codebooks."""
    steps = []
    for k in range(rounds + 1):
        if k:
            steps.append(f"""
    m{k} AS (
        SELECT p, e, o, floor(sum(v[o]) / count(*)) AS x
        FROM parts JOIN a{k - 1} USING (r, p), generate_series(1, 16) AS g(o) GROUP BY p, e, o),
    b{k} AS (
        SELECT b.p, b.e, coalesce(n.c, b.c) AS c
        FROM b{k - 1} AS b LEFT JOIN (SELECT p, e, list(x ORDER BY o) AS c FROM m{k} GROUP BY p, e) AS n USING (p, e))""")
        steps.append(f"""
    a{k} AS (
        SELECT r, p, key % 256 AS e, key // 256 AS d FROM (
            SELECT r, p, min((list_dot_product(v, v) - 2 * list_dot_product(v, c) + list_dot_product(c, c))::BIGINT * 256 + e) AS key
            FROM parts JOIN b{k} USING (p) GROUP BY r, p))""")
    return ",".join(steps)


@query("op11_vector_codes", f"""
    WITH kept AS (
        SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, * FROM (
            SELECT vec_id, label, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)),
    parts AS (SELECT r, p, v[16 * p + 1 : 16 * p + 16] AS v FROM kept, generate_series(0, 3) AS g(p)),
    b0 AS (SELECT p, r - 1 AS e, v AS c FROM parts WHERE r <= 256),{_lloyd_sql(vector_codes.ROUNDS)},
    coded AS (
        SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{vector_codes.ROUNDS} GROUP BY r),
    digest AS (
        SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY p, e, o)) AS codebooks_sha256
        FROM (SELECT p, e, unnest(c) AS x, generate_subscripts(c, 1) AS o FROM b{vector_codes.ROUNDS}))
    SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
    FROM kept JOIN coded USING (r), digest
""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    found = vector_codes.compress(vectors)
    if found is None:
        return spark.createDataFrame([], vectors.select("vec_id").schema.add("code", "string").add("error", "bigint").add(
            "label_error", "bigint").add("codebooks_sha256", "string"))
    rows = found.rows.select(F.col("id").alias("vec_id"), "label", vector_codes.code_string(F.col("codes")).alias("code"),
                             vector_codes.total_error(F.col("errors")).alias("error"))
    return vector_codes.with_label_error(rows).select(
        "vec_id", "code", "error", "label_error", F.lit(vector_codes.books_digest(found.books)).alias("codebooks_sha256"))


NEGATIVES = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


@query("op12_hard_negatives", """
    WITH kept AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    scored AS (
        SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
        FROM kept AS a JOIN kept AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
    positives AS (
        SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
    ranked AS (
        SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
            id AS negative_id, positive_score, score AS negative_score
        FROM positives JOIN scored USING (anchor_id)
        WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
    SELECT * FROM ranked WHERE rank <= 3
""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hard_negatives.mine(rows, label=label, anchors=F.col("id") % 50 == 0)
    return spark.createDataFrame([], NEGATIVES) if found is None else found


@query("op13_warc", """
    WITH sized AS (
        SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
    grouped AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS first FROM sized)
    SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
        CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
    FROM grouped
""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    path = shared_folder(spark)
    warc.write(pages, path)
    needed = ["record_type", "record_id", "concurrent_to", "refers_to", "payload", "payload_bytes", "payload_sha1", "error"]
    captures = warc.assemble(warc.read(spark, path, payload_of=("metadata",)).select(*needed))
    page = warc.metadata_field("page_id").cast(pages.schema["page_id"].dataType)
    size, digest = F.col("capture.payload_bytes"), F.col("capture.payload_sha1")
    rows = warc.with_targets(captures.withColumn("page_id", page), {"page_id": F.col("page_id"), "size": size, "digest": digest})
    revisit = F.col("capture.record_type") == "revisit"
    return rows.select(
        "page_id", F.when(revisit, F.col("target.size")).otherwise(size).alias("payload_bytes"),
        F.when(revisit, F.col("target.digest")).otherwise(digest).alias("payload_digest"),
        F.col("capture.record_type").alias("record_type"), F.col("target.page_id").alias("refers_to"))
