"""From raw documents to an encoded, deduplicated and mixed corpus, in five stages."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowferry.llm import byte_bpe, exact_dedup, mixing, ngram_join, quality_classifier
from rowferry.llm.queries import prepare, vocabulary
from rowferry.sources.workspace import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(run: Stage) -> Stage:
    @wraps(run)
    def prepared(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        prepare(spark)
        return run(spark, docs, sf_dir)

    return prepared


@_stage
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from these documents and the labels, takes for good."""
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_classifier.score(docs, model)
    return scored.filter("predicted = 1").select(*docs.columns)


@_stage
def one_of_equal_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest id."""
    return exact_dedup.without_duplicates(docs).select(*docs.columns)


@_stage
def one_of_similar_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near-duplicate texts the one with the smallest id; documents without an id stay."""
    classes = ngram_join.similar_documents(docs)
    surplus = classes.filter(F.col("doc_id") != F.col("class_id")).select("doc_id").distinct()
    return docs.join(surplus, "doc_id", "left_anti").select(*docs.columns)


@_stage
def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.repeat(docs)


@_stage
def encoded_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the bytes they decode to."""
    ranks = vocabulary("byte_bpe_multi_50k.tiktoken")
    rows = byte_bpe.encode(docs, ranks, decoded=True, keep=["doc_id", "lang", "source"])
    return rows.select("doc_id", "lang", "source", *byte_bpe.digests())


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_quality),
    ("exact dedup", one_of_equal_texts),
    ("n-gram Jaccard join", one_of_similar_texts),
    ("mixing sources to target weights", mixed_sources),
    ("byte-level BPE", encoded_texts),
]

ORACLE_SQL = None
"""SQL can express neither the learnt scores nor the encoding; the stages are tested against brute force."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
