import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rowferry.llm import exact_dedup, ngram_join
from rowferry.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(text or "")
    return frozenset(" ".join(words[k:k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute_force(rows):
    """(class, links) of every id by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent, links = list(range(len(sets))), defaultdict(int)

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, (i, x) in enumerate(sets):
        for b, (j, y) in enumerate(sets[:a]):
            if x and y and len(x & y) >= 0.8 * len(x | y):
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    least = defaultdict(lambda: 1 << 60)
    for a, (i, _) in enumerate(sets):
        least[find(a)] = min(least[find(a)], i)
    return sorted((i, least[find(a)], links[a]) for a, (i, _) in enumerate(sets))


def edited(words, rng, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice("abcdefgh") * 3
    return " ".join(words)


@pytest.mark.parametrize("paired,block", [(12, 192), (3, 7), (1, 4)])
def test_similar_documents(docs_of, monkeypatch, paired, block):
    monkeypatch.setattr(ngram_join, "PAIRED", paired)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(11)
    base = [[f"w{rng.randrange(5000)}" for _ in range(n)] for n in (120, 80, 60, 5, 3)]
    texts = [edited(words, rng, rng.choice((0, 0, 1, 2, 3, 5))) for words in base[:3] for _ in range(25)]
    texts += [" ".join(w) for w in base] + ["", "  ", None, "one", "one"]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[0]), (None, None)]
    df = docs_of([(i, t, None, None) for i, t in rows], clashing=True)
    got = [(r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.similar_documents(df).collect()]
    assert sorted(g for g in got if g[0] is not None) == brute_force(rows)
    assert [g for g in got if g[0] is None] == [(None, None, 0)] * 2


def test_no_documents(docs_of):
    assert ngram_join.similar_documents(docs_of([])).collect() == []
    assert exact_dedup.exact_duplicates(docs_of([])).collect() == []


def test_pruning_keeps_what_may_reach_the_threshold():
    needed = [ngram_join.least_matches(n) for n in (25, 50, 75, 100, 125)]
    assert needed == sorted(needed) and 5 < needed[0] < 20 and needed[-1] / 125 < 0.75


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1060)]
    found = {r["u"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    seen = {}
    for a, b in edges:
        group = seen.get(a, {a}) | seen.get(b, {b})
        for v in group:
            seen[v] = group
    for v, group in seen.items():
        assert found.get(v, v) == min(group)


def expected_duplicates(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    key = lambda i: -1 if i is None else i
    return {t: (max(ids, key=key), len(ids)) for t, ids in groups.items()}


WEAK = lambda chunk: F.struct((F.length(chunk) % 3).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"))


@pytest.mark.parametrize("fingerprint", [exact_dedup.pair_of_hashes, WEAK])
def test_exact_duplicates(docs_of, monkeypatch, fingerprint):
    """With a fingerprint that nearly all chunks share, the numbers of the chunks still tell them apart."""
    real = exact_dedup.recipes
    monkeypatch.setattr(exact_dedup, "recipes", lambda docs, key, text: real(docs, key, text, fingerprint))
    long = " ".join(f"Sentence number {k} ends." for k in range(900))
    rows = [(1, long), (2, long), (3, long + "x"), (4, "y" + long), (5, ""), (6, None), (7, "a"), (7, "a"), (8, "b"), (None, "b"),
            (None, "only"), (9, "z" * 30000), (10, "z" * 30001), (11, "é" * 9000), (12, "Ab"), (13, "ab")]
    got = exact_dedup.exact_duplicates(docs_of([(i, t, None, None) for i, t in rows], clashing=True)).collect()
    assert len(got) == len(rows)
    expected = expected_duplicates(rows)
    texts = {exact: v for exact, v in expected.items()}
    assert sum(r["kept"] for r in got) == len(texts)
    by_id = defaultdict(set)
    for i, t in rows:
        by_id[i].add(texts[t or ""])
    for r in got:
        assert (r["keep_id"], r["group_size"]) in by_id[r["doc_id"]]


def test_chunks_put_together_are_the_text(docs_of):
    long = "No end in sight " * 3000 + "\n".join(f"Line {k}. And {k * k} more!" for k in range(4000))
    parts = docs_of([(1, long, None, None)]).select(exact_dedup.chunks(F.col("text")).alias("c")).first()["c"]
    assert "".join(parts) == long and max(map(len, parts)) <= exact_dedup.LARGEST + 2
    later = docs_of([(1, "Something new. " + long, None, None)]).select(exact_dedup.chunks(F.col("text")).alias("c")).first()["c"]
    assert len(set(later) & set(parts)) > len(set(parts)) / 2


def test_documents_without_duplicates(docs_of):
    rows = [(1, "a", "en", "s"), (2, "a", "fr", "s"), (2, "b", "de", "s"), (3, "c", "es", None), (3, "c", "es", None), (None, None, None, None)]
    left = exact_dedup.without_duplicates(docs_of(rows)).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "", r["lang"] or "") for r in left) == [
        (0, "", ""), (2, "a", "fr"), (2, "b", "de"), (3, "c", "es")]
