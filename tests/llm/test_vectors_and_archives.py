import gzip
import hashlib
import math
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowferry.llm import hard_negatives, vector_codes, warc
from rowferry.llm.queries import QUERIES, prepare
from rowferry.llm.vectors import products, squared_distances


@pytest.fixture(scope="module")
def vectors_of(spark):
    prepare(spark)

    def build(rows):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
        return df.selectExpr("*", *[f"'x' AS {c}" for c in "id numbers codes errors cell anchor windows score rank".split()])

    return build


def _clustered(rng, n, width):
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    return [[float(np.float32(c + rng.gauss(0, 0.4))) for c in rng.choice(centres)] for _ in range(n)]


def _with_faults(rng, n, width):
    points = _clustered(rng, n, width)
    rows = [(i, p, rng.choice((0, 1, 2, 3, None))) for i, p in enumerate(points)]
    rows += [(n + k, list(rows[3][1]), 1) for k in range(40)]  # equal vectors
    rows += [(n + 50, None, 1), (n + 51, [None] * width, 1), (n + 52, [math.nan] * width, 2), (n + 53, [math.inf] + [0.0] * (width - 1), 2)]
    rng.shuffle(rows)
    return rows


def _sound(rows):
    return [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]


# Vector codes

def complete_rounds(rows, parts, entries, rounds, scale):
    """Lloyd rounds that compare every part with every entry."""
    kept = sorted(((i, [math.floor(x * scale) for x in v], label) for i, v, label in _sound(rows)),
                  key=lambda r: (r[0] is None, r[0], r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width:(p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [[min((distance(cut(v, p), c), e) for e, c in enumerate(books[p])) for p in range(parts)] for _, v, _ in kept]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(v, p) for (_, v, _), f in zip(kept, found) if f[p][1] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    return [(i, label, [e for _, e in f], [d for d, _ in f]) for (i, _, label), f in zip(kept, assign())], books


@pytest.mark.parametrize("entries", [3, 16, 400])
def test_codes_equal_complete_rounds(vectors_of, entries):
    rows = _with_faults(random.Random(entries), 150, 8)
    found = vector_codes.compress(vectors_of(rows).repartition(5), parts=4, entries=entries, rounds=4, scale=64)
    expected, books = complete_rounds(rows, 4, entries, 4, 64)
    got = [(r["id"], r["label"], r["codes"], r["errors"]) for r in found.rows.select("id", "label", "codes", "errors").collect()]
    assert found.books.tolist() == books
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_only_moved_entries_are_compared():
    rng = np.random.default_rng(3)
    parts, book = rng.integers(-5, 5, (300, 3)), rng.integers(-5, 5, (20, 3))
    codes, errors = vector_codes.nearest(parts, book)
    for _ in range(30):
        moved = rng.random(20) < 0.3
        after = np.where(moved[:, None], rng.integers(-5, 5, (20, 3)), book)
        codes, errors = vector_codes.reassigned(parts, after, moved, codes, errors)
        book = after
        whole = vector_codes.nearest(parts, book)
        assert (codes == whole[0]).all() and (errors == whole[1]).all()


def test_code_columns_and_label_sums(spark, vectors_of):
    rows = spark.createDataFrame([(1, None, [0, 255], [5, 6]), (2, None, [16, 1], [1, 1]), (3, 7, [9, 9], [2, 0])],
                                 "id long, label int, codes array<int>, errors array<long>")
    spelled = rows.select("id", "label", vector_codes.code_string(F.col("codes")).alias("code"),
                          vector_codes.total_error(F.col("errors")).alias("error"))
    assert sorted(map(tuple, vector_codes.with_label_error(spelled).select("id", "code", "error", "label_error").collect())) == [
        (1, "00ff", 11, 13), (2, "1001", 2, 13), (3, "0909", 2, 2)]
    assert vector_codes.books_digest(np.array([[[1, -2]], [[3, 4]]])) == hashlib.sha256(b"1,-2,3,4").hexdigest()


def test_codes_of_odd_tables(spark, vectors_of):
    assert vector_codes.compress(vectors_of([])) is None
    assert vector_codes.compress(vectors_of([(1, None, 1)])) is None
    with pytest.raises(ValueError):
        vector_codes.compress(vectors_of([(1, [1.0, 2.0, 3.0], 1)]))
    # Repeated rows, a null id and another length.
    rows = [(1, [1.0] * 4, 1), (1, [1.0] * 4, 1), (None, [2.0] * 4, None), (2, [1.0] * 8, 1)]
    found = vector_codes.compress(vectors_of(rows), entries=2, scale=1)
    assert sorted((r["id"] or 0, r["codes"]) for r in found.rows.collect()) == [(0, [0] * 4), (1, [0] * 4), (1, [0] * 4)]


def test_arithmetic_is_exact_at_any_size():
    rng = random.Random(1)
    for size in (10, 1 << 24, 1 << 30, 1 << 40):
        a, b = ([[rng.randint(-size, size) for _ in range(5)] for _ in range(4)] for _ in range(2))
        x, y = np.array(a, np.int64), np.array(b, np.int64)
        assert products(x, y).tolist() == [[sum(p * q for p, q in zip(r, s)) for s in b] for r in a]
        assert squared_distances(x, y).tolist() == [[sum((p - q) ** 2 for p, q in zip(r, s)) for s in b] for r in a]


# Hard negatives

def brute_negatives(rows, every, scale=256, positives=5, negatives=3):
    kept = [(i, label, [math.floor(x * scale) for x in v]) for i, v, label in _sound(rows) if label is not None and i is not None]
    out = []
    for i, label, v in kept:
        if i % every:
            continue
        scores = [(-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in kept if j != i]
        for s, j, _ in sorted(x for x in scores if x[2] == label)[:positives]:
            fit = sorted(x for x in scores if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s)
            out += [(i, j, rank, x[1], -s, -x[0]) for rank, x in enumerate(fit[:negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize("per_cell,block,group,first_rows,held", [(512, 512, 256, 1024, 100_000), (4, 3, 2, 1, 5), (20, 8, 4, 30, 50)])
def test_hard_negatives(vectors_of, monkeypatch, per_cell, block, group, first_rows, held):
    for name, value in (("ROWS_PER_CELL", per_cell), ("BLOCK", block), ("GROUP", group), ("FIRST_ROWS", first_rows), ("HELD", held)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = _with_faults(random.Random(per_cell), 260, 6)
    got = hard_negatives.mine(vectors_of(rows).repartition(4), anchors=F.col("id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, 10)


def test_hard_negatives_of_odd_tables(vectors_of):
    every = F.col("id") % 1 == 0
    assert hard_negatives.mine(vectors_of([]), anchors=every) is None
    assert hard_negatives.mine(vectors_of([(None, [1.0, 1.0], 1), (1, [1.0, 1.0], None)])) is None
    one = hard_negatives.mine(vectors_of([(1, [1.0, 1.0], 1)]), anchors=every)
    assert one.count() == 0
    # An odd number of components, a repeated row, another length, ties, and scores of zero or below.
    rows = [(1, [1.0, 0.0, 0.0], 1), (1, [1.0, 0.0, 0.0], 1), (2, [0.0, 1.0, 0.0], 1), (3, [0.0, 0.0, 1.0], 2), (4, [1.0, 1.0], 1),
            (5, [-1.0, 0.5, 0.0], 1), (6, [0.6, 0.0, 0.0], 2), (7, [0.6, 0.0, 0.0], 2), (8, [1.0, 0.0, 0.0], 1)]
    kept = [r for k, r in enumerate(rows) if k != 1 and len(r[1]) == 3]
    got = hard_negatives.mine(vectors_of(rows), anchors=every)
    assert sorted(map(tuple, got.collect())) == brute_negatives(kept, 1)


def test_cells_come_by_their_bound():
    rng = np.random.default_rng(8)
    for n, m in ((1, 1), (1, 7), (6, 1), (9, 11)):
        a, b = rng.integers(-4, 5, n), rng.integers(-4, 5, m)
        seen = list(hard_negatives.cells_by_bound(a, b))
        assert sorted((i, j) for _, i, j in seen) == [(i, j) for i in range(n) for j in range(m)]
        assert all(s == a[i] + b[j] for s, i, j in seen)
        assert [s for s, _, _ in seen] == sorted((s for s, _, _ in seen), reverse=True)


def test_visits_end_at_certified_windows(spark, vectors_of, monkeypatch):
    """An anchor in a tight far cluster needs few cells."""
    monkeypatch.setattr(hard_negatives, "ROWS_PER_CELL", 8)
    rng = random.Random(2)
    rows = [(i, [c + rng.gauss(0, 0.01) for c in centre], i % 2) for i, centre in enumerate(
        [[100.0 * math.cos(k % 8), 100.0 * math.sin(k % 8), 100.0 * math.cos(k % 8), 100.0 * math.sin(k % 8)] for k in range(800)])]
    index = hard_negatives.build(hard_negatives.indexable(vectors_of(rows), "vec_id", "embedding", F.col("label"), 256))
    anchors = spark.createDataFrame([(0, 0, [int(256 * x) for x in rows[0][1]], [(0, 5_000_000, 1 << 62, 5, True)], 0)],
                                    "anchor long, label long, numbers array<int>, windows array<struct<window:int,low:long,high:long,k:int,same:boolean>>, popped long")
    visited = hard_negatives.visits(anchors, index, False).count()
    assert 0 < visited < (index.sizes > 0).sum()


# Archives

CASES = [
    (1, "https://h.example/a?b=c#d", "<p>short</p>"), (2, "https://h.example/", "x" * 2000), (3, "http://other.example", "x" * 2000),
    (4, "https://h.example/é", "y" * 999), (5, "https://h.example/5", "y" * 999), (6, None, None), (7, "", ""),
    (8, "bad uri\r\nWARC-Type: request", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 50),
    (9, "https://h.example/9", "ends in breaks\r\n\r\n\r\n"), (10, "https://h.example/10", "\r\n" * 70_000), (11, "https://h.example/11", "é漢🙂" * 400),
    (12, "https://h.example/12", "é漢🙂" * 400), (13, "https://h.example/13", "long " * 1_000_000), (14, "https://h.example/14", "\r\n\r\n"),
    (15, "https://h.example/15", "\r\n\r" * 30_000), (2, "https://h.example/", "x" * 2000), (3, "http://other.example", "x" * 2000),
    (None, "https://h.example/n", "x" * 2000), (None, "https://h.example/n", "alone " * 500),
]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    prepare(spark)
    path = str(tmp_path_factory.mktemp("warc") / "archive")
    pages = spark.createDataFrame(CASES, "page_id long, url string, html string").selectExpr(
        "*", *[f"'x' AS {c}" for c in "id uri payload print kind record target digest date first".split()])
    warc.write(pages.repartition(3), path)
    return path


def _folder_of_pages(spark, tmp_path, rows):
    folder = str(tmp_path / uuid.uuid4().hex)
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


def test_query_on_hard_cases(spark, tmp_path):
    got = QUERIES["op13_warc"](spark, _folder_of_pages(spark, tmp_path, CASES)).collect()
    long = {}
    for i, _, text in CASES:
        if len((text or "").encode()) >= 1000:
            long[text] = max(long.get(text, 0), i or 0)
    expected = []
    for i, _, text in CASES:
        data = (text or "").encode()
        first = long.get(text) or None
        revisit = first is not None and i != first
        expected.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    rows = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got]
    assert sorted(rows, key=repr) == sorted(expected, key=repr)


def test_no_pages(spark, tmp_path):
    assert QUERIES["op13_warc"](spark, _folder_of_pages(spark, tmp_path, [])).count() == 0


def test_records_come_back_whole(spark, archive):
    rows = warc.read(spark, archive).collect()
    assert len(rows) == 3 * len(CASES) and not any(r["error"] for r in rows)
    stored = sorted(bytes(r["payload"]) for r in rows if r["record_type"] == "response")
    copies = sum(r["record_type"] == "revisit" for r in rows)
    assert copies == 4  # ids 2, 2, 11 and the null id
    whole = [(t or "").encode() for _, _, t in CASES]
    for text in ("x" * 2000, "x" * 2000, "x" * 2000, "é漢🙂" * 400):
        whole.remove(text.encode())
    assert stored == sorted(whole)
    for r in rows:
        if r["record_type"] == "response":
            assert r["declared_digest"] == r["payload_sha1"]


def test_archives_follow_the_format(archive):
    """A plain reader of the files finds the same records."""
    from pathlib import Path

    kinds = []
    for file in sorted(Path(archive).glob("part-*")):
        data = gzip.decompress(file.read_bytes())
        while data:
            head, _, data = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            fields = dict(line.split(": ", 1) for line in lines[1:])
            assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "Content-Length"} <= set(fields)
            n = int(fields["Content-Length"])
            assert data[n:n + 4] == b"\r\n\r\n"
            kinds.append(fields["WARC-Type"])
            data = data[n + 4:]
    assert sorted(kinds) == sorted(["request", "metadata"] * len(CASES) + ["revisit"] * 4 + ["response"] * (len(CASES) - 4))


def test_captures_are_nested(spark, archive):
    rows = warc.assemble(warc.read(spark, archive)).collect()
    assert len(rows) == len(CASES)
    for r in rows:
        assert r["request"]["http_header"].startswith("GET /") and r["n_request"] == r["n_metadata"] == 1
        assert r["request"]["concurrent_to"] == [r["capture"]["record_id"]] == r["metadata"]["concurrent_to"]
        assert r["request"]["target_uri"] == r["capture"]["target_uri"]
    assert any(r["request"]["http_header"].startswith("GET /a?b=c HTTP/1.1\r\nHost: h.example") for r in rows)


def _foreign(kind, name, block=b"", extra="", length=None):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\n{extra}Content-Length: {len(block) if length is None else length}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def test_foreign_and_broken_archives(spark, tmp_path):
    http = b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n\xff\xfe\x00 no text"
    response = "Content-Type: application/http;msgtype=response\r\n"
    records = [
        _foreign("warcinfo", "w", b"software: x\r\n"),
        _foreign("response", "r1", http, response + "WARC-Concurrent-To: <q1>\r\nWARC-Payload-Digest: sha1:"
                 "VNQNSR7DAYTVPCDG3DFWCQ2YGDSFVEYY\r\n"),
        _foreign("request", "q1", b"GET / HTTP/1.0\r\n\r\n", "Content-Type: application/http;msgtype=request\r\n"),
        _foreign("metadata", "m1", b"a: 1\r\n", "WARC-Concurrent-To: <r1>\r\nwarc-concurrent-to:\r\n <r2>\r\n"),
        b"garbage\r\n\r\nmore garbage\r\n\r\n",
        _foreign("metadata", "m2", b"b: 2\r\n", "WARC-Concurrent-To: <r1>\r\n"),
        _foreign("response", "r3", b"wrong length", length=3),
        _foreign("response", "r2", http, response),
        _foreign("resource", "x", b"", length="many"),
    ]
    members = b"".join(gzip.compress(r) for r in records) + gzip.compress(_foreign("response", "late", b"cut", length=900)[:-4])
    (tmp_path / "a.warc.gz").write_bytes(members)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(records[0]))
    rows = warc.read(spark, str(tmp_path)).collect()
    good = {r["record_id"]: r for r in rows if not r["error"]}
    assert sorted(good) == ["<m1>", "<m2>", "<q1>", "<r1>", "<r2>", "<w>"]
    assert bytes(good["<r1>"]["payload"]) == b"\xff\xfe\x00 no text" and good["<r1>"]["http_header"] == "HTTP/1.0 200 OK\r\nA: b"
    assert len(good["<r1>"]["declared_digest"]) == 40 and good["<m1>"]["concurrent_to"] == ["<r1>", "<r2>"]
    assert sorted(r["error"] for r in rows if r["error"]) == [
        "content does not end where its length says", "no header of a record", "no header of a record", "the archive ends inside this record"]
    nested = {r["capture"]["record_id"]: r for r in warc.assemble(warc.read(spark, str(tmp_path))).collect()}
    assert nested["<r1>"]["request"]["record_id"] == "<q1>"  # named by the response
    assert (nested["<r1>"]["metadata"]["record_id"], nested["<r1>"]["n_metadata"]) == ("<m1>", 2)
    assert (nested["<r2>"]["request"], nested["<r2>"]["n_request"], nested["<r2>"]["n_metadata"]) == (None, 0, 1)
