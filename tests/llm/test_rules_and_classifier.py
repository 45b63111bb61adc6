import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowferry.llm import quality_classifier, quality_rules
from rowferry.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[k:k + 8]) for k in range(len(words) - 7)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    inside = {k + d for k, w in enumerate(windows) if w in often for d in range(8)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
            sum(line in lines[:k] for k, line in enumerate(lines)), len(inside))


def test_measures(documents, docs_of, spark, folder):
    odd = [(1, "a b c d e f g h " * 3, None, None), (2, None, None, None), (3, "", None, None), (4, "x\n\nx\n \nx", None, None),
           (5, "w " * 40, None, None), (6, "İstanbul # é🙂 " * 30, None, None), (6, "İstanbul # é🙂 " * 30, None, None)]
    for df in (docs_of(odd, clashing=True), documents.limit(60)):
        texts = {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
        rows = quality_rules.ledger(df, keep=["doc_id"]).collect()
        assert len(rows) == df.count()
        for r in rows:
            got = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
            assert got == measured(texts[r["doc_id"]])
            failed = got[0] < 20 or 100 * got[4] > 30 * got[0]
            assert failed == bool(r["failed_bits"] & quality_rules.mask(quality_rules.BASE))
    base = QUERIES["op1_quality_rules"](spark, folder)
    assert base.filter("base_failed and kept").isEmpty()


def test_good_texts_are_kept(spark, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    kept = QUERIES["op1_quality_rules"](spark, folder).join(labels, "doc_id")
    shares = {r["quality"]: r["share"] for r in kept.filter("not base_failed").groupBy("quality").agg(
        F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert shares[1] > 0.97 and shares.get(0, 0) < 0.3


def test_ablations_need_only_bits(docs_of):
    rows = [(k, "one two " * (k % 7) + "#" * (k % 3) * 5, None, None) for k in range(60)]
    ledger = quality_rules.ledger(docs_of(rows)).cache()
    policy = quality_rules.POLICIES["v1"]
    bits = [r["failed_bits"] & quality_rules.mask(policy) for r in ledger.collect()]
    places = {r.name: 1 << r.bit for r in quality_rules.rules()}
    for row in quality_rules.ablations(ledger, policy).collect():
        bit = places[row["rule"]]
        assert row["failed"] == sum(1 for b in bits if b & bit)
        assert row["failed_alone"] == sum(1 for b in bits if b == bit)
        assert row["kept_without"] == sum(1 for b in bits if not b & ~bit)
        assert row["kept"] == sum(1 for b in bits if not b)


@pytest.fixture(scope="module")
def larger():
    return "/root/testdata/sf0.01"


def test_held_out_accuracy(spark, documents, larger):
    rows = QUERIES["op3_quality_classifier"](spark, larger).join(spark.read.parquet(f"{larger}/labels.parquet"), "doc_id") \
        .filter("held_out").toPandas()
    assert (rows["predicted"] == rows["quality"]).mean() > 0.9
    assert rows["predicted"][rows["quality"] == 0].mean() < 0.2
    assert rows["score"].between(0, 1).all() and ((rows["score"] >= 0.7) == (rows["predicted"] == 1)).all()


def test_prior_and_risk():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1, 1, (4000, quality_classifier.SIZE)), rng.normal(-1, 1, (600, quality_classifier.SIZE))
    model = quality_classifier.learn(good[:2000], np.concatenate([good[2000:], bad]))
    assert abs(model.prior - 2000 / 2600) < 0.08
    assert (model.score(rng.normal(1, 1, (500, quality_classifier.SIZE))) > 0.5).mean() > 0.97
    assert (model.score(rng.normal(-1, 1, (500, quality_classifier.SIZE))) < 0.5).mean() > 0.97


def test_nothing_to_learn_from(docs_of, spark):
    from tests.llm.conftest import ROWS

    df = docs_of(ROWS, clashing=True)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality_classifier.train(df, labels)
    rows = quality_classifier.score(df, model).collect()
    assert len(rows) == len(ROWS) and {r["score"] for r in rows} == {0.0, 0.5}
    assert all(r["score"] == 0 for r in rows if not (r["text"] or "").strip())


def test_gradient_against_differences():
    rng = np.random.default_rng(2)
    rows = rng.normal(0, 1, (7, 5))
    values = [rng.normal(0, 1, (5, 4)), rng.normal(0, 1, 4), rng.normal(0, 1, 4), rng.normal(0, 1, 1)]
    loss = lambda: np.logaddexp(0, quality_classifier.Network(*values).margin(rows)).mean()
    margins = quality_classifier.Network(*values).margin(rows)
    found = quality_classifier.Network(*values).slopes(rows, 1 / (1 + np.exp(-margins)))
    for value, slope in zip(values, found, strict=True):
        for at in np.ndindex(value.shape):
            kept = value[at]
            value[at] = kept + 1e-6
            above = loss()
            value[at] = kept - 1e-6
            below = loss()
            value[at] = kept
            assert abs((above - below) / 2e-6 - slope[at]) < 1e-5


def test_prior_against_a_plain_one():
    rng = np.random.default_rng(3)
    positive, mixed = rng.normal(1, 1, 400), np.concatenate([rng.normal(1, 1, 300), rng.normal(-2, 1, 200)])
    best = None
    for k in range(45):
        cut = np.quantile(positive, 0.02 + k * (0.9 - 0.02) / 44)
        p, u = sum(x >= cut for x in positive) / 400, sum(x >= cut for x in mixed) / 500
        bound = (u + 1 / 400 ** 0.5 + 1 / 500 ** 0.5) / p
        best = min(best, (bound, u / p)) if best else (bound, u / p)
    assert quality_classifier.estimate_prior(positive, mixed) == pytest.approx(best[1])
