"""The chunker against a plain loop, on hand-made and on random texts."""

import pathlib
import re

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from textmill.operators.chunking import batch_plan, chunk_documents, pack_chunks, whole_documents
from textmill.operators.spread import (
    _cut, _function, _short_functions, _whole_groups, paragraph_rows, scan_paragraphs, spread_chunks,
)

SPACE = " \t\n\x0b\f\r"


def count(text):
    return sum(1 for w in re.split(f"[{SPACE}]+", text) if re.fullmatch(".*[A-Za-z0-9].*", w))


def by_loop(text, most, least):
    parts = [p.strip("".join(map(chr, range(33)))) for p in re.split(r"\n[ \t\n\x0b\f\r]*\n", text)]
    groups, words = [[]], 0
    for part in filter(None, parts):
        n = count(part)
        if words > 0 and words + n > most:
            groups.append([])
            words = 0
        groups[-1].append(part)
        words += n
    chunks = ["\n\n".join(group) for group in groups if group]
    return [chunk for chunk in chunks if count(chunk) >= least]


def by_spark(spark, texts, most, least, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc int, content string")
    rows = chunk_documents(docs, max_words=most, min_words=least, **more).collect()
    found = [[] for _ in texts]
    for row in sorted(rows, key=lambda row: (row.doc, row.chunk_no)):
        assert row.chunk_no == len(found[row.doc])
        found[row.doc].append(row.content)
    return found


PARTS = st.lists(st.sampled_from(
    ["a b c", "one", "__ --", "x " * 12, "\n\n", "\n \n", "\n", " ", "\t\n\n\x0b\n", "﻿w", "中"]), max_size=25)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(PARTS.map("".join), min_size=30, max_size=60), st.integers(1, 15), st.integers(0, 4))
def test_random_texts(spark, texts, most, least):
    assert by_spark(spark, texts, most, least) == [by_loop(t, most, least) for t in texts]


def test_rules(spark):
    texts = ["a b\n\nc d\n\ne", "a b c d e f\n\ng", "___\n\na b c", "", None, "a\n\nb b b b"]
    found = by_spark(spark, texts, 3, 1)
    assert found == [["a b", "c d\n\ne"], ["a b c d e f", "g"], ["___\n\na b c"], [], [], ["a", "b b b b"]]
    assert by_spark(spark, texts, 3, 2)[1] == ["a b c d e f"]


def test_words_are_kept_or_counted_as_dropped(spark):
    texts = ["a b\n\nc d\n\ne", "a b c d e f\n\ng", "x"]
    docs = spark.createDataFrame([(t,) for t in texts], "content string")
    for row in pack_chunks(docs, max_words=3, min_words=2).collect():
        assert sum(c.n_words for c in row.chunks) + row.dropped_words == count(row.content)


def test_overlap(spark):
    found = by_spark(spark, ["a b c\n\nd e f\n\ng"], 3, 1, overlap_words=2)
    assert found == [["a b c", "b c\n\nd e f", "e f\n\ng"]]


def test_batches(spark):
    docs = spark.createDataFrame([(1, "\n\n".join("ab" * 5)), (2, "")], "doc int, content string")
    rows = batch_plan(pack_chunks(docs, max_words=1, min_words=1), "doc", 4).orderBy("batch_no").collect()
    assert [(r.doc, r.batch_no, r.first_chunk, r.last_chunk, r.n_batches) for r in rows] == [
        (1, 1, 1, 4, 3), (1, 2, 5, 8, 3), (1, 3, 9, 10, 3)]


def test_whole_documents(spark):
    docs = spark.createDataFrame([(1, " a b "), (2, " \n"), (3, None)], "doc int, content string")
    assert [(r.doc, r.n_words, r.content) for r in whole_documents(docs).collect()] == [(1, 2, " a b ")]


def test_a_long_document(spark):
    """Linear in the text: 60,000 paragraphs in one row."""
    text = "\n\n".join(["word word word"] * 60000)
    [chunks] = by_spark(spark, [text], 300, 1)
    assert len(chunks) == 600 and sum(map(count, chunks)) == 180000


def spread(spark, texts, most, least, width):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc int, content string")
    rows = spread_chunks(paragraph_rows(docs, "doc"), "doc", most, least, width).collect()
    found = [[] for _ in texts]
    for row in sorted(rows, key=lambda row: (row.doc, row.chunk_no)):
        assert row.chunk_no == len(found[row.doc]) and row.n_words == count(row.content)
        found[row.doc].append(row.content)
    return found


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(PARTS.map("".join), min_size=30, max_size=60), st.integers(1, 15), st.integers(0, 4), st.integers(1, 6))
def test_spread_documents_have_the_same_chunks(spark, texts, most, least, width):
    assert spread(spark, texts, most, least, width) == [by_loop(t, most, least) for t in texts]


def test_blocks_compose():
    """The function of a block, for every number of open words, against the plain walk."""
    rng = np.random.default_rng(1)
    for most in (1, 7, 40):
        counts = rng.choice([0, 0, 1, 2, 5, 60], 500)
        after, closed = _function(counts, most)
        for words in range(most + 2):
            chunks, last = _cut(counts, words, most)
            assert (after[words], closed[words]) == (min(last, most + 1), chunks[-1])


def test_short_blocks_are_worked_out_side_by_side():
    rng = np.random.default_rng(3)
    for most in (1, 7, 40):
        blocks = [rng.choice([0, 0, 1, 2, 5, 60], n) for n in (1, 16, 3, 64)]
        for counts, (after, closed) in zip(blocks, _short_functions(blocks, most)):
            want = _function(counts, most)
            assert (after == want[0]).all() and (closed == want[1]).all()
    assert _short_functions([], 7) == []


def test_groups_are_whole_whatever_the_batches():
    rows = pd.DataFrame({"doc": ["a"] * 3 + ["b"] * 5 + ["c"], "i": range(9)})
    for size in (1, 2, 4, 9):
        frames = list(_whole_groups((rows.iloc[k:k + size] for k in range(0, 9, size)), ["doc"]))
        assert pd.concat(frames, ignore_index=True).equals(rows)
        assert sum(frame["doc"].nunique() for frame in frames) == 3


def test_documents_share_a_call_of_python(spark, tmp_path):
    """Many small documents pass through Python as batches of rows, not as groups of one document each."""
    docs = spark.createDataFrame([(i, "one two\n\nthree four\n\nfive") for i in range(50)], "doc int, content string")
    before = len(list(pathlib.Path(spark.conf.get("spark.checkpoint.dir")).glob("numbered-*")))
    found = spread_chunks(paragraph_rows(docs, "doc"), "doc", 4, 1, width=1)
    assert "FlatMapGroupsIn" not in found._jdf.queryExecution().toString()
    assert len(list(pathlib.Path(spark.conf.get("spark.checkpoint.dir")).glob("numbered-*"))) == before + 1
    assert [(r.chunk_no, r.n_words, r.content) for r in found.filter("doc = 7").orderBy("chunk_no").collect()] == [
        (0, 4, "one two\n\nthree four"), (1, 1, "five")]


def test_one_file_of_many_lines(spark, tmp_path):
    """A file is read in parts, and its chunks are those of the whole text."""
    rng = np.random.default_rng(2)
    lines = [rng.choice(["word word word", "", " \t", "two lines", "\x01", "__"]) for _ in range(4000)]
    text = "\n".join(lines)
    (tmp_path / "big.txt").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000b")
    try:
        parts = scan_paragraphs(spark, str(tmp_path / "big.txt"))
        assert spark.read.text(str(tmp_path / "big.txt")).rdd.getNumPartitions() > 5
        rows = spread_chunks(parts, "url", 50, 3, width=64).orderBy("chunk_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.content for r in rows] == by_loop(text, 50, 3) and len(rows) > 50
