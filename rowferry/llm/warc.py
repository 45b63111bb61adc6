"""WARC archives: writing captures, reading records, and assembling records into captures.

Every page becomes three records, response (or revisit), request and metadata; the last two name the first as the
record they are concurrent to. Spark's text writer lays the records out, `CRLF CRLF` being its line separator, so
archives go to any storage Spark can write to, as gzip files of a bounded number of records (one gzip member a file). Reading
takes the pieces between separators from Spark's text reader and cuts the stream by each record's Content-Length, so
separators inside a payload do no harm and a task holds one record at a time. Files have to be gzipped, with one or many members:
Spark does not split such files.

Assembly joins the records through their concurrent-to identifiers, whichever side names the other, and gives one nested row
per response or revisit. Of several requests or metadata records of one capture the one with the smallest id is nested, and
`n_request` and `n_metadata` tell how many there are; `companions` has them all. Records of other types are no captures.

Writing: a null payload is empty, a null URI is written as `urn:none`, and a null id gives a metadata record without an id. Of
equal payloads of at least `SMALLEST_REVISITED` bytes the row with the largest id is the response and the others revisit it; a null id is
smaller than any other. Rows repeated with the same id are all responses, or all revisits; every row comes back. Line breaks
and other control characters in a URI are percent-encoded. Other columns are ignored. Reading: what is no record, or
ends too early, comes back as a row with `error` set, and reading goes on at the next record. An empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.union import union_all
from ..sources.workspace import materialise

# Separators and names of the format.
CRLF, SEPARATOR = "\r\n", "\r\n\r\n"
VERSION = "WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPES = ("response", "request", "revisit")

SMALLEST_REVISITED = 1000
RECORDS_PER_FILE = 30_000
DATE = "2000-01-01T00:00:00Z"
"""Date of records whose pages carry none."""

_TEXT = ("file", "record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "declared_digest", "http_header")
RECORD = T.StructType([
    *[T.StructField(name, T.StringType()) for name in _TEXT], T.StructField("concurrent_to", T.ArrayType(T.StringType())),
    T.StructField("payload", T.BinaryType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_sha1", T.StringType()), T.StructField("error", T.StringType())])


# Writing

def _record_id(kind: str, *parts: Column) -> Column:
    """An identifier that follows from what the record is about."""
    digest = F.md5(F.to_json(F.struct(F.lit(kind).alias("kind"), *[p.alias(f"p{i}") for i, p in enumerate(parts)])))
    cuts = [F.substring(digest, first, n) for first, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _safe_uri(uri: Column) -> Column:
    """A URI that cannot end its header line."""
    text = F.when(uri.isNull() | (uri == ""), F.lit("urn:none")).otherwise(uri)
    return F.when(text.rlike(r"[\x00-\x20\x7F]"), F.regexp_replace(F.url_encode(text), r"\+", "%20")).otherwise(text)


def _record(kind: str | Column, headers: Sequence[tuple[str, Column]], block: Column) -> Column:
    """One record without the separator behind it; headers whose value is null are left out."""
    lines = [F.lit(VERSION), F.concat(F.lit("WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind)]
    lines += [F.concat(F.lit(f"{name}: "), value.cast("string")) for name, value in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(SEPARATOR), block)


def repeated_payloads(rows: DataFrame) -> DataFrame:
    """(`print`, `first`) of payloads that several rows share; `first` is the id and URI of their response."""
    long = rows.filter(F.octet_length("payload") >= SMALLEST_REVISITED).select("id", "uri", "print")
    return long.groupBy("print").agg(F.max(F.struct("id", "uri")).alias("first"), F.count("*").alias("n")) \
        .filter("n > 1").select("print", "first")


def write(
    pages: DataFrame, path: str, key: str = "page_id", uri: str = "url", payload: str = "html", date: str | None = None,
    content_type: str = "text/html; charset=UTF-8",
) -> None:
    """Writes three records for every page. The payload column is text, written in UTF-8, or binary."""
    # Bytes pass through the text writer as they are.
    content = pages[payload].cast("string")
    rows = pages.select(
        pages[key].cast("string").alias("_name"), pages[key].alias("id"), _safe_uri(pages[uri]).alias("uri"),
        F.coalesce(content, F.lit("")).alias("payload"),
        (F.lit(DATE) if date is None else F.coalesce(F.date_format(pages[date], "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(DATE))).alias("date"),
    ).withColumn("print", F.sha2("payload", 256))
    # Looked at first: where few payloads repeat, Spark broadcasts them after its size check and pages are not shuffled.
    shared = materialise(repeated_payloads(rows)).withColumn("_again", F.xxhash64("print"))
    # The second key has both sides dealt anew, so adaptive execution can split a payload with very many rows.
    known = rows.withColumn("_again", F.xxhash64("print")).join(shared, ["_again", "print"], "left")
    is_revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first.id"))
    known = known.withColumns({
        "kind": F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response")),
        "record": _record_id("capture", F.col("id"), F.col("uri"), F.col("print")),
        "target": F.when(is_revisit, _record_id("capture", F.col("first.id"), F.col("first.uri"), F.col("print"))),
        "target_uri": F.when(is_revisit, F.col("first.uri")),
        "digest": F.concat(F.lit("sha1:"), F.sha1("payload")),
    })
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: {content_type}{CRLF}Content-Length: "),
                    F.octet_length("payload").cast("string"), F.lit(SEPARATOR))
    same = [("WARC-Date", F.col("date")), ("WARC-Target-URI", F.col("uri"))]
    capture = _record(F.col("kind"), [
        ("WARC-Record-ID", F.col("record")), *same, ("WARC-Payload-Digest", F.col("digest")),
        ("WARC-Profile", F.when(is_revisit, F.lit(IDENTICAL))), ("WARC-Refers-To", F.col("target")),
        ("WARC-Refers-To-Target-URI", F.col("target_uri")), ("Content-Type", F.lit("application/http; msgtype=response")),
    ], F.concat(head, F.when(is_revisit, F.lit("")).otherwise(F.col("payload"))))
    companions = [("WARC-Concurrent-To", F.col("record"))]
    host, place = (F.regexp_extract("uri", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)", group) for group in (1, 2))
    request = _record("request", [
        ("WARC-Record-ID", _record_id("request", F.col("record"))), *same, *companions,
        ("Content-Type", F.lit("application/http; msgtype=request")),
    ], F.concat(F.lit("GET "), F.when(place.startswith("/"), place).otherwise(F.concat(F.lit("/"), place)),
                F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(SEPARATOR)))
    fields = F.coalesce(F.concat(F.lit(f"{key}: "), F.col("_name"), F.lit(CRLF)), F.lit(""))
    metadata = _record("metadata", [
        ("WARC-Record-ID", _record_id("metadata", F.col("record"))), *same, *companions,
        ("Content-Type", F.lit("application/warc-fields")),
    ], fields)
    known.select(F.explode(F.array(capture, request, metadata)).alias("value")).write.option("lineSep", SEPARATOR) \
        .option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


# Reading

def _headers(block: bytes) -> dict[str, list[str]]:
    """Named header lines in lower case; a line that begins with a blank goes on with the one before."""
    found: dict[str, list[str]] = {}
    name = ""
    for line in block.decode("utf-8", "replace").split(CRLF)[1:]:
        if line[:1] in (" ", "\t") and name:
            found[name][-1] = f"{found[name][-1]} {line.strip()}".strip()
        elif ":" in line:
            name, value = (x.strip() for x in line.split(":", 1))
            name = name.lower()
            found.setdefault(name, []).append(value)
    return found


class RecordStream:
    """Cuts the bytes of one archive into records."""

    def __init__(self) -> None:
        self.buffer = bytearray()
        self.head: dict[str, list[str]] | None = None
        self.lost = False  # inside something that is no record

    def feed(self, data: bytes) -> Iterator[tuple[dict[str, list[str]], bytes | None, str | None]]:
        """(headers, block, error) of every record that ends within the bytes so far."""
        self.buffer += data
        mark = SEPARATOR.encode()
        while True:
            if self.head is None:
                end = self.buffer.find(mark)
                if end < 0:
                    return
                block = bytes(self.buffer[:end])
                del self.buffer[:end + len(mark)]
                if not block.strip():
                    continue
                head = _headers(block.lstrip()) if block.lstrip().startswith(b"WARC/") else {}
                length = head.get("content-length", [""])[0]
                if not (length.isascii() and length.isdigit()):
                    if not self.lost:
                        yield head, None, "no header of a record"
                    self.lost = True
                    continue
                self.head, self.lost = head, False
            size = int(self.head["content-length"][0])
            if len(self.buffer) < size + len(mark):
                return
            block, sound = bytes(self.buffer[:size]), self.buffer[size:size + len(mark)] == mark
            head, self.head = self.head, None
            if sound:
                del self.buffer[:size + len(mark)]
                yield head, block, None
            else:
                # The length is wrong: go on at the next separator behind the header, which was used up already.
                self.lost = True
                yield head, None, "content does not end where its length says"

    def close(self) -> Iterator[tuple[dict[str, list[str]], bytes | None, str | None]]:
        if self.head is not None:
            yield self.head, None, "the archive ends inside this record"
        elif self.buffer.strip():
            yield {}, None, "the archive ends inside a header"


def _digest(declared: str | None) -> str | None:
    """A declared SHA-1 as lower-case hex; it may be in hex or base 32."""
    if not declared or not declared.lower().startswith("sha1:"):
        return declared
    value = declared[5:]
    if len(value) == 32:
        try:
            return base64.b32decode(value.upper()).hex()
        except ValueError:
            return declared
    return value.lower()


def _row(file: str, head: dict[str, list[str]], block: bytes | None, error: str | None, carried: frozenset[str] | None) -> tuple:
    one = lambda name: head.get(name, [None])[0]
    kind, http, payload = one("warc-type"), None, block
    if block is not None and kind in HTTP_TYPES and (one("content-type") or "").startswith("application/http"):
        cut = block.find(SEPARATOR.encode())
        http = (block if cut < 0 else block[:cut]).decode("utf-8", "replace")
        payload = b"" if cut < 0 else block[cut + 4:]
    return (file, kind, one("warc-record-id"), one("warc-refers-to"), one("warc-target-uri"), one("warc-date"), one("content-type"),
            _digest(one("warc-payload-digest")), http, head.get("warc-concurrent-to", []), payload if carried is None or kind in carried else None, None if payload is None else len(payload),
            None if payload is None else hashlib.sha1(payload).hexdigest(), error)


FLUSH_BYTES, FLUSH_ROWS = 4 << 20, 2000


def read(spark: SparkSession, path: str, payload_of: Sequence[str] | None = None) -> DataFrame:
    """All records of the gzipped archives under a path.

    Sizes and digests are those of the payload as read. `payload_of` names the record types whose payload comes back.
    """
    carried = None if payload_of is None else frozenset(payload_of)
    names, kinds = RECORD.names, [f.dataType for f in RECORD.fields]
    arrow = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.BinaryType(): pa.binary()}
    types = [arrow.get(k, pa.list_(pa.string())) for k in kinds]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, file, rows, held = RecordStream(), None, [], 0
        mark = SEPARATOR.encode()
        for batch in batches:
            for k in range(batch.num_rows):  # one piece at a time: pieces hold whole payloads
                at = batch.column(1)[k].as_py()
                if at != file:
                    if file is not None:
                        rows += [_row(file, *found, carried) for found in stream.close()]
                    stream, file = RecordStream(), at
                for found in stream.feed(batch.column(0)[k].as_py() + mark):
                    rows.append(_row(file, *found, carried))
                    held += len(rows[-1][10] or b"")
                    if held >= FLUSH_BYTES or len(rows) >= FLUSH_ROWS:
                        yield batch_of(rows)
                        rows, held = [], 0
        if file is not None:
            rows += [_row(file, *found, carried) for found in stream.close()]
        if rows:
            yield batch_of(rows)

    pieces = spark.read.option("lineSep", SEPARATOR).text(path)
    return pieces.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file")).mapInArrow(run, RECORD)


# Assembling

def companions(records: DataFrame) -> DataFrame:
    """Requests and metadata records, each with the `capture` it belongs to, whichever of the two names the other."""
    sound = records.filter(F.col("error").isNull())
    is_capture = F.col("record_type").isin("response", "revisit")
    others = sound.filter(F.col("record_type").isin("request", "metadata"))
    naming = others.withColumn("capture", F.explode("concurrent_to"))
    named = sound.filter(is_capture).select(F.col("record_id").alias("capture"), F.explode("concurrent_to").alias("record_id")).distinct()
    return union_all(naming, others.join(named, "record_id").select(*naming.columns))


def assemble(records: DataFrame) -> DataFrame:
    """One row per response or revisit: `capture`, `request` and `metadata` nested, and the number of the latter two.

    The records are written once with the columns they have, since three branches read them: leave out what is not needed.
    """
    records = materialise(records)
    sound = records.filter(F.col("error").isNull() & F.col("record_type").isin("response", "revisit"))
    fields = [c for c in records.columns if c != "capture"]
    of = companions(records)
    nested = {}
    for kind in ("request", "metadata"):
        mine = F.col("record_type") == kind
        nested[kind] = F.min_by(F.when(mine, F.struct(*fields)), F.when(mine, F.col("record_id"))).alias(kind)
        nested[f"n_{kind}"] = F.count_distinct(F.when(mine, F.col("record_id"))).alias(f"n_{kind}")
    joined = of.groupBy("capture").agg(*nested.values())
    rows = sound.select(F.struct(*fields).alias("_capture"), F.col("record_id").alias("capture"))
    return rows.join(joined, "capture", "left").select(
        F.col("_capture").alias("capture"), "request", "metadata",
        *[F.coalesce(f"n_{kind}", F.lit(0)).cast("bigint").alias(f"n_{kind}") for kind in ("request", "metadata")])


def metadata_field(name: str, metadata: str = "metadata") -> Column:
    """A field of a nested metadata record."""
    return F.nullif(F.regexp_extract(F.col(f"{metadata}.payload").cast("string"), rf"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))


def with_targets(captures: DataFrame, added: dict[str, Column]) -> DataFrame:
    """Adds `target`: columns of the capture that a revisit refers to, null where there is none."""
    targets = captures.select(F.col("capture.record_id").alias("_id"), F.struct(*[c.alias(n) for n, c in added.items()]).alias("target")) \
        .groupBy("_id").agg(F.min("target").alias("target"))
    return captures.withColumns({"_id": F.col("capture.refers_to"), "_again": F.xxhash64("capture.refers_to")}).join(
        targets.withColumn("_again", F.xxhash64("_id")), ["_again", "_id"], "left").drop("_id", "_again")
