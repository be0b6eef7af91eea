"""Web archives (WARC 1.1) without repeated payloads.

Headers are shuffled by the digest of their payload; in each group of equal
payloads the record of the smallest page_id is the original, and the others are
joined to it and become revisit records, which refer to it and carry no payload.
The archives are written by Spark's text writer, whose line separator is the end
of a record (two line breaks); it commits whole files, so lost executors leave no
halves. They are read back file by file, each record by its Content-Length, and
revisits are joined to the responses that they refer to.

A payload that a third of all pages share is dealt out wherever its headers meet
the original. Archives hold about `ARCHIVE_BYTES` each, so that a file fits a task.

Edge cases: a null html is an empty payload. Payloads under `LEAST` bytes are all
responses. Null page_ids come after all others, and have no Page-Id header; of
rows with one page_id and one payload the first by url is the original, and of
rows repeated in full any one, the rest refer to it. A null url has no
WARC-Target-URI, and white space and control characters in one are
percent-encoded. Empty tables make archives without records. An archive that ends
inside a record, or a payload that does not have its digest, is an error.
Columns beyond page_id, url and html are not looked at.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import spread_join, stored

LEAST = 100
ARCHIVE_BYTES = 32 << 20
# Bytes of a record beside its payload, and rows and bytes that a task hands over at once.
HEADER_BYTES, ROWS, BYTES = 700, 4096, 16 << 20
END = "\r\n\r\n"
# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = (
    "path string, offset long, record_type string, record_id string, page_id long, target_uri string, "
    "date string, payload_digest string, refers_to_id string, payload_bytes long, payload binary"
)


def _key() -> Column:
    """What tells rows apart: page_id, url and payload."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("page_id", "url")]
    return F.unhex(F.sha2(F.concat_ws("\n", *parts, F.hex("digest")), 256))


def described(pages: DataFrame) -> DataFrame:
    """Add payload, payload_bytes, digest and the identity `key` of the row."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    return (
        pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"))
        .withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "digest": F.unhex(F.sha2("payload", 256))})
        .withColumn("key", _key())
    )


def originals(headers: DataFrame, least=LEAST) -> DataFrame:
    """Per payload that several rows have: key, page_id and url of the row that stays."""
    first = F.min(F.struct(
        F.col("page_id").isNull().alias("a"), "page_id", F.col("url").isNull().alias("b"), "url", "key"))
    groups = headers.filter(F.col("payload_bytes") >= least).groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"), first.alias("first"))
    return groups.filter("n > 1").select(
        "digest", *(F.col(f"first.{c}").alias(f"first_{c}") for c in ("key", "page_id", "url")))


def record_id(key: Column, copy: Column) -> Column:
    """A urn:uuid that follows from the row, so that a repeated task writes the same."""
    digits = F.md5(F.concat(key, copy.cast("string").cast("binary")))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *(F.substring(digits, *cut) for cut in cuts)))


def _uri(url: Column) -> Column:
    """White space and control characters as their percent-encoded bytes."""
    pieces = F.regexp_extract_all(url, F.lit(r"(?s)[\x00-\x20\x7f]|[^\x00-\x20\x7f]+"), F.lit(0))
    return F.array_join(F.transform(
        pieces, lambda p: F.when(p.rlike(r"^[\x00-\x20\x7f]"), F.concat(F.lit("%"), F.hex(p))).otherwise(p)), "")


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value)


def resolved(pages: DataFrame, least=LEAST) -> DataFrame:
    """Rows of `described` with copy (1 for the first of rows repeated in full), record_type and the original's columns.

    Decisions are rows only for payloads or rows that occur more than once. Where
    they are few by their measured size they are broadcast, and payloads stay where
    they are. Only rows repeated in full have to meet, to be numbered.
    """
    headers = stored(described(pages).drop("payload"), "warc-headers")
    distinct = headers.groupBy(*headers.columns).agg(F.count(F.lit(1)).alias("n_same"))
    known = spread_join(distinct, originals(headers, least), "digest", "key")
    decided = known.filter("first_key is not null or n_same > 1").select("key", "n_same", "first_key", "first_page_id", "first_url")
    decided = stored(decided, "warc-decisions")
    rows = described(pages)
    single = rows.join(decided, "key", "left").filter("n_same is null or n_same = 1").withColumn("copy", F.lit(1))
    copy = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    repeated = rows.join(decided.filter("n_same > 1"), "key").withColumn("copy", copy)
    original = F.col("first_key").isNull() | ((F.col("first_key") == F.col("key")) & (F.col("copy") == 1))
    return single.unionByName(repeated).withColumn("record_type", F.when(original, "response").otherwise("revisit"))


def written(rows: DataFrame, date: str) -> DataFrame:
    """One text per row of `resolved`: its WARC record without the line breaks that end it."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"), F.lit(END))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    fields = F.concat_ws(
        "\r\n", F.lit(VERSION), _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", F.concat(F.lit("<"), record_id(F.col("key"), F.col("copy")), F.lit(">"))),
        _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", _uri(F.col("url"))),
        _line("Page-Id", F.col("page_id").cast("string")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.lower(F.hex("digest")))),
        *(F.when(revisit, line) for line in (
            _line("WARC-Profile", F.lit(PROFILE)),
            _line("WARC-Refers-To", F.concat(F.lit("<"), record_id(F.col("first_key"), F.lit(1)), F.lit(">"))),
            _line("WARC-Refers-To-Target-URI", _uri(F.col("first_url"))),
            _line("WARC-Refers-To-Date", F.lit(date)),
        )),
        F.lit("Content-Type: application/http; msgtype=response"), _line("Content-Length", length.cast("string")),
    )
    body = F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).cast("string")
    return rows.select(F.concat(fields, F.lit(END), http, body).alias("value"))


def write_archives(pages: DataFrame, folder: str, date="2020-01-01T00:00:00Z", least=LEAST, archive_bytes=ARCHIVE_BYTES) -> None:
    """Write the pages as WARC files into `folder`, payloads of `least` bytes or more once each."""
    rows = resolved(pages, least)
    size = described(pages).agg(F.avg("payload_bytes")).first()[0] or 0
    records = max(1, int(archive_bytes / (size + HEADER_BYTES)))
    written(rows, date).write.option("lineSep", END).option("maxRecordsPerFile", records).text(folder)


def _fields(header: bytes) -> dict[str, str]:
    lines = header.decode("utf-8", "replace").split("\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"not a record: {lines[0][:40]!r}")
    return {name.lower(): value for name, _, value in (line.partition(": ") for line in lines[1:])}


def records_of(path: str, content, with_payload: bool) -> Iterator[tuple]:
    """The records of one archive in order, as rows of `RECORDS`."""
    end, at = END.encode(), 0
    while at < len(content):
        start = content.find(end, at) + len(end)
        if start < len(end):
            raise ValueError(f"{path}: no header at byte {at}")
        fields = _fields(content[at:start - len(end)])
        stop = start + int(fields["content-length"])
        if content[stop:stop + len(end)] != end:
            raise ValueError(f"{path}: the record at byte {at} is cut short")
        kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
        payload = None
        if kind == "response":
            inner = content.find(end, start, stop) + len(end)
            payload = content[inner:stop]
            if hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"{path}: the payload at byte {inner} does not have its digest")
        page = fields.get("page-id")
        yield (
            path, at, kind, fields["warc-record-id"].strip("<>"), None if page is None else int(page),
            fields.get("warc-target-uri"), fields["warc-date"], digest,
            fields["warc-refers-to"].strip("<>") if kind == "revisit" else None,
            None if payload is None else len(payload), payload if with_payload else None,
        )
        at = stop + len(end)


def read_archives(spark: SparkSession, folder: str, with_payload=True) -> DataFrame:
    """The records of the archives in `folder`. Without `with_payload` payloads are checked but not returned."""
    names = [field.split()[0] for field in RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.binary()]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                rows, size = [], 0
                for row in records_of(path.as_py(), content.as_py(), with_payload):
                    rows.append(row)
                    size += len(row[-1] or b"")
                    if len(rows) >= ROWS or size >= BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("path", "content").mapInArrow(run, RECORDS)


def with_originals(records: DataFrame) -> DataFrame:
    """Add refers_to, the page_id of the response, to revisit records, and the length of their full payload.

    `records` is read twice. A revisit whose response is not there, or has another payload, is an error.
    """
    responses = records.filter("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"),
        F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"))
    revisits = records.filter("record_type = 'revisit'")
    wanted = revisits.select("refers_to_id").distinct()
    known = spread_join(revisits, responses.join(wanted, "refers_to_id"), "refers_to_id", "record_id")
    lost = F.raise_error(F.concat(F.lit("no response for "), "record_id")).cast("long")
    size = F.when(F.col("_digest") == F.col("payload_digest"), F.col("_bytes")).otherwise(lost)
    found = known.withColumn("payload_bytes", size).drop("_bytes", "_digest")
    return records.filter("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).unionByName(found)
