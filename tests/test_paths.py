"""Golden rows for messages, URLs, reference numbers and metadata."""

import json

from pyspark.sql import functions as F

from textmill.functions import metadata, refnums, status, urls
from textmill.functions.text import meaningful_words, not_blank, preview, trimmed


def values(spark, inputs, make, kind="string"):
    rows = spark.createDataFrame(list(enumerate(inputs)), f"i int, x {kind}")
    found = rows.select("i", make(F.col("x")).alias("y")).collect()
    return [row.y for row in sorted(found, key=lambda row: row.i)]


def test_document_type(spark):
    cases = {
        "/policies/a.txt": "policy", "http://h/POLICIES/a": "policy",
        "/reference/a.txt": "reference", "/Reference/x": "reference",
        "/processed_files/glossary.pdf.txt?op=OPEN": "information",
        "/processed_files/123456-789012.pdf.txt?op=OPEN": "policy",
        "/processed_files/123456-789012.txt": "policy",
        "/processed_files/123-456.txt": "information",
        "/processed_files/1234567-789012.txt": "information",
        "/processed_files/": "information",
        "/processed_files/123456-789012.txt?path=/a/b": "policy",
        "/x/policies/reference/a.txt": "policy",
        "/other/a.txt": "unknown", "": "unknown", None: "unknown",
    }
    assert values(spark, cases, urls.document_type) == list(cases.values())


def test_parse_refnums(spark):
    cases = {
        "100001-200001.txt": (100001, 200001), "100001-200001.TXT": (100001, 200001),
        "100001-200001.pdf.txt": (100001, 200001), "100003-200003.a.b.txt": None,
        "+123456-200001.txt": (123456, 200001), "123456-789012-.txt": (123456, 789012),
        "100001 - 200001.txt": (100001, 200001), "0100001-200001.txt": (100001, 200001),
        "099999-200001.txt": None, "999999-100000.txt": (999999, 100000),
        "1000000-200001.txt": None, "-100001-200001.txt": None, "100001.txt": None,
        "100001-200001": None, "100001-200001.md": None, ".txt": None, "": None, None: None,
        "100001-200001-300001.txt": None, "1e5001-200001.txt": None,
    }
    found = values(spark, cases, refnums.parse_refnums)
    assert [tuple(pair) if pair else None for pair in found] == list(cases.values())


def test_file_names(spark):
    cases = ["/a/b.txt?x=/c/d.txt", "/a/b.txt?q", "b.txt", "/a/", "/a/?q"]
    assert values(spark, cases, urls.filename_for_refnum) == ["d.txt", "b.txt", "b.txt", "", ""]
    assert values(spark, cases, urls.filename_for_type) == ["b.txt", "b.txt", None, None, None]


def test_messages(spark):
    cases = ['{"url":"http://h/a"}', '{"url":" "}', '{"url":null}', '{"x":1}', "no json", "", None]
    assert values(spark, cases, urls.extract_url) == ["http://h/a"] + [None] * 6
    cases = ['{"url":"u","fileUrl":"f"}', '{"file_url":"g"}', "Processed file: http://h/a.txt done",
             " http://h/b.txt ", '{"content":"text"}', "just words", " "]
    found = values(spark, cases, urls.extract_url_compat)
    assert [(row.url, row.inline_content) for row in found] == [
        ("f", None), ("g", None), ("http://h/a.txt", None), ("http://h/b.txt", None),
        (None, "text"), (None, "just words"), (None, None)]


def test_urls(spark):
    cases = ["http://h/webhdfs/v1/a?op=X&b=?", "http://h/webhdfs/v1/a", "http://h/a?b"]
    assert values(spark, cases, urls.normalize_url) == [
        "http://h/webhdfs/v1/a?op=OPEN", "http://h/webhdfs/v1/a?op=OPEN", "http://h/a?b"]
    assert values(spark, ["a%2520b%20c"], urls.fix_double_encoding) == ["a%20b%20c"]
    assert values(spark, ["https://a.b:8/c", "nonsense"], urls.uri_host) == ["a.b", None]


def test_text(spark):
    assert values(spark, ["\x00\t a \x1f", " "], trimmed) == ["a", " "]
    assert values(spark, ["", " \n", None, "a"], not_blank) == [False, False, False, True]
    words = ["one two", "____ -- 3", "中文", " a b c ", "", None, "a\x0bb"]
    assert values(spark, words, meaningful_words) == [2, 1, 0, 1, 0, 0, 2]
    assert values(spark, ["x" * 101, "x" * 100, None], preview) == [
        "x" * 100 + "...", "x" * 100, "[No content]"]


def test_metadata(spark):
    def made(kind):
        column = metadata.build_metadata(
            F.lit(kind), F.lit(100001), F.lit(None).cast("int"), F.lit("/p"), F.lit(5))
        return json.loads(spark.range(1).select(column).first()[0])

    assert made("policy") == {"timestamp": 5, "refnum1": 100001, "sourcePath": "/p"}
    assert made("reference") == {"timestamp": 5, "doctype": "information", "sourcePath": "/p"}
    assert made("unknown") == {
        "timestamp": 5, "refnum1": 100001, "documentType": "unknown", "sourcePath": "/p"}


def test_refnum_errors(spark):
    def error(kind, first, second):
        column = refnums.refnum_error(
            F.lit(kind), F.lit(first).cast("int"), F.lit(second).cast("int"))
        return spark.range(1).select(column).first()[0]

    assert error("policy", 100000, 999999) is None
    assert error("policy", None, 999999) == "refnum1 cannot be null"
    assert error("policy", 100000, 12345).endswith("got: 12345")
    assert error("unknown", 12345, None) is None


def test_status(spark):
    rows = spark.createDataFrame(
        [(0, 0, 0), (0, 0, 1), (10, 5, 0), (10, 10, 1), (10, 10, 2), (10, 5, 1)],
        "total long, done long, errors long")
    found = rows.select(status.status(*map(F.col, ("total", "done", "errors")))).collect()
    assert [row[0] for row in found] == ["IDLE", "ERROR", "PROCESSING", "IDLE", "ERROR", "ERROR"]
    assert values(spark, [59, 3661, 360000], status.format_uptime, "long") == ["0h 0m", "1h 1m", "100h 0m"]
    times = ["1704067200000", "2024-01-01T01:00:00.000001+01:00", "soon", None]
    micros = values(spark, times, lambda x: F.unix_micros(status.event_time(x)))
    assert micros == [1704067200000000, 1704067200000001, None, None]
    assert values(spark, [30.0, 30.1, 120.0, 121.0], status.liveness, "double") == [
        "alive", "degraded", "degraded", "offline"]
