import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from rowferry.llm import mixing, ngram_join, quality_classifier
from rowferry.llm.queries import ORACLES, QUERIES
from rowferry.sources.workspace import materialise
from tests.llm.test_duplicates import brute_force
from tests.test_queries import TYPES, _key


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(name, spark, folder):
    duck = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = QUERIES[name](spark, folder)
    result = duck.execute(ORACLES[name])
    described = {d[0]: str(d[1]) for d in result.description}
    assert {c: TYPES[t] for c, t in df.dtypes} == described
    expected = sorted(_key(dict(zip(described, row, strict=True))[c] for c in df.columns) for row in result.fetchall())
    assert sorted(_key(row) for row in df.collect()) == expected


def levels(sizes, weights, most):
    """Targets by pouring: excess of full sources is shared again until none is above its cap."""
    total, full = sum(sizes), set()
    while True:
        left = total - sum(most * sizes[k] for k in full)
        open_weights = sum(w for k, w in enumerate(weights) if k not in full)
        targets = [most * s if k in full else left * weights[k] / open_weights for k, s in enumerate(sizes)]
        above = {k for k, t in enumerate(targets) if t > most * sizes[k]}
        if not above:
            return targets
        full |= above


def test_mix(docs_of):
    words = {"a": 3, "b": 400, "c": 90, None: 500, "d": 0}
    rows = [(n, "w " * (1 + n % 40) if n < words[s] else None, "en", s) for s in words for n in range(max(1, words[s]))]
    rows += [(None, "x y", "en", "a"), (1, "w w", "en", "a"), (1, "w w", "en", "a"), (77, "word " * 20000, None, "c")]
    df = docs_of(rows, clashing=True)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    order = ["a", "b", "c", "d", None]
    sizes = [sum(len((t or "").split()) for _, t, _, s in rows if s == source) for source in order]
    targets = levels(sizes, [5, 2, 1, 5, 2], 3)
    by_size = dict(zip(sizes, targets, strict=True))
    assert {r["source_size"]: pytest.approx(r["target"]) for r in got} == by_size
    for size, target in by_size.items():
        mine = [r for r in got if r["source_size"] == size]
        assert abs(sum(r["taken"] for r in mine) - target) <= max([r["size"] for r in mine]) / 2 + 1e-6
        assert all(r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] for r in mine)
    assert sorted(map(str, mixing.mix(df.repartition(7)).collect())) == sorted(map(str, got))
    repeated = Counter((r["doc_id"], r["source"]) for r in mixing.repeat(df).collect())
    assert sum(repeated.values()) == sum(r["copies"] for r in got if r["size"]) + sum(r["copies"] for r in got if not r["size"])


def test_empty_tables(docs_of):
    assert mixing.mix(docs_of([])).collect() == [] and mixing.repeat(docs_of([])).collect() == []


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    scores = quality_classifier.score(docs, quality_classifier.train(docs, spark.read.parquet(f"{folder}/labels.parquet")), keep=["doc_id"])
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        after = materialise(stage(spark, docs, folder))
        ids = Counter(r["doc_id"] for r in after.select("doc_id").collect())
        if number < 4:
            assert after.columns == columns, name
        if number == 0:
            assert set(ids) == {r["doc_id"] for r in scores.filter("predicted = 1").collect()}
        elif number == 1:
            keep = {}
            for i, r in before.items():
                keep[r["text"]] = max(i, keep.get(r["text"], i))
            assert set(ids) == set(keep.values()) and max(ids.values()) == 1
        elif number == 2:
            assert set(ids) == {c for _, c, _ in brute_force([(i, r["text"]) for i, r in before.items()])}
        elif number == 3:
            taken = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect() if r["copies"]}
            assert ids == taken and max(ids.values()) <= 3
        else:
            assert after.columns == ["doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256"]
            assert sum(ids.values()) == docs.count()
        docs = after
    whole = corpus_pipeline.run(spark, folder).select("doc_id", "ids_sha256").collect()
    assert Counter(map(tuple, whole)) == Counter(map(tuple, docs.select("doc_id", "ids_sha256").collect()))


def test_pipeline_with_awkward_rows(spark, docs_of, tmp_path):
    from tests.llm.conftest import ROWS

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (ROWS, []):
        docs = docs_of(rows, clashing=True)
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
            # Without labels nothing is good enough, so the later stages get all rows instead.
            done = materialise(stage(spark, docs, str(tmp_path)))
            docs = docs if number == 0 else done
    assert re.fullmatch("[0-9a-f]{64}", materialise(corpus_pipeline.STAGES[4][1](spark, docs_of(ROWS), "")).first()["ids_sha256"])


def test_links_are_not_lost_between_large_buckets(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    usual = {tuple(r) for r in ngram_join.similar_documents(docs).collect()}
    monkeypatch.setattr(ngram_join, "PAIRED", 1)
    assert {tuple(r) for r in ngram_join.similar_documents(docs).collect()} == usual
