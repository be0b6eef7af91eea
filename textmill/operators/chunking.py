"""Paragraph-aligned chunks. All of it stays inside the document's row until the last step."""

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill import schemas
from textmill.functions.text import WHITESPACE, bound, meaningful_words, not_blank, trimmed

# What separates paragraphs, in the text and in a chunk.
PARAGRAPH_BREAK = r"\n\s*\n"
CHUNK_JOIN = "\n\n"
# Chunk ends that a step may copy.
_ENDS = 128


def split_paragraphs(text: Column, pattern: str = PARAGRAPH_BREAK) -> Column:
    return F.filter(F.transform(F.split(text, pattern), trimmed), lambda part: part != "")


def _chunk_ends(counts: Column, max_words: int) -> Column:
    """Where each chunk ends, as positions in the paragraph array.

    A chunk closes before the paragraph that would take it above the maximum,
    unless it holds no words yet. Numbers are carried from step to step, and the ends in
    two levels: a step copies at most `_ENDS` of them, and one in `_ENDS` closing steps the
    list of full groups. Longer documents are for `spread`.
    """

    def step(state, words):
        closes = (state.words > 0) & (state.words + words > max_words)
        full = closes & (F.size(state.ends) >= _ENDS)
        return F.struct(
            F.when(closes, words).otherwise(state.words + words).alias("words"),
            (state.seen + 1).alias("seen"),
            F.when(full, F.array(state.seen)).when(closes, F.concat(state.ends, F.array(state.seen)))
            .otherwise(state.ends).alias("ends"),
            F.when(full, F.concat(state.groups, F.array(state.ends))).otherwise(state.groups).alias("groups"),
        )

    start = F.struct(
        F.lit(0).alias("words"), F.lit(0).alias("seen"),
        F.array().cast("array<int>").alias("ends"), F.array().cast("array<array<int>>").alias("groups"),
    )
    return F.aggregate(counts, start, step, lambda state: F.concat(
        F.flatten(state.groups), state.ends, F.array(state.seen)))


def _pack(text: Column, max_words: int, min_words: int) -> Column:
    def pieces(paragraphs, counts, ends):
        def piece(end, i):
            start = F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1))
            words = F.slice(counts, start + 1, end - start)
            parts = F.slice(paragraphs, start + 1, end - start)
            return F.struct(_total(words).alias("n_words"), F.array_join(parts, CHUNK_JOIN).alias("content"))

        return F.transform(ends, piece)

    def kept(paragraphs, counts):
        large = lambda chunk: (chunk.n_words >= min_words) & (chunk.content != "")
        chunks = bound(_chunk_ends(counts, max_words), lambda ends: pieces(paragraphs, counts, ends))
        return bound(F.filter(chunks, large), lambda chunks: F.struct(
            chunks.alias("chunks"),
            (_total(counts) - _total(F.transform(chunks, lambda c: c.n_words))).alias("dropped_words"),
        ))

    paragraphs = F.coalesce(split_paragraphs(text), F.array().cast("array<string>"))
    return bound(paragraphs, lambda some: bound(
        F.transform(some, meaningful_words), lambda counts: kept(some, counts)))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda total, n: total + n)


@cache
def _packed(text: str, max_words: int, min_words: int) -> Column:
    """The expression is some hundred calls of the JVM; a stream that packs every batch makes it once."""
    return _pack(F.col(text), max_words, min_words)


def pack_chunks(
    docs: DataFrame, max_words=schemas.MAX_WORDS, min_words=schemas.MIN_WORDS,
    overlap_words=0, text="content",
) -> DataFrame:
    """Add `chunks`, an array of (n_words, content), and `dropped_words` to every document.

    Paragraphs are never split; a chunk below `min_words` is dropped wherever it stands.
    """
    packed = docs.withColumn("_packed", _packed(text, max_words, min_words)).withColumns({
        "chunks": F.col("_packed.chunks"), "dropped_words": F.col("_packed.dropped_words"),
    }).drop("_packed")
    return with_overlap(packed, overlap_words) if overlap_words else packed


def with_overlap(packed: DataFrame, words: int) -> DataFrame:
    """Put the last `words` words of the chunk before in front of each chunk."""

    def tail(text):
        last = lambda every: F.slice(every, F.greatest(F.size(every) - words + 1, F.lit(1)), words)
        return F.array_join(bound(F.split(text, WHITESPACE), last), " ")

    def all_extended(chunks):
        def extended(chunk, i):
            before = F.get(chunks, i - 1).content
            return F.struct(
                chunk.n_words.alias("n_words"),
                F.when(i == 0, chunk.content)
                .otherwise(F.concat(tail(before), F.lit(CHUNK_JOIN), chunk.content))
                .alias("content"),
            )

        return F.transform(chunks, extended)

    return packed.withColumn("chunks", bound(F.col("chunks"), all_extended))


def explode_chunks(packed: DataFrame) -> DataFrame:
    """One row per chunk with its position in the document.

    An outer explode and a filter, since for an inner one Catalyst infers a filter
    on the array and pushes it down, which would cut every document three times.
    """
    keep = [c for c in packed.columns if c not in ("chunks", "dropped_words", "content")]
    rows = packed.select(*keep, F.posexplode_outer("chunks").alias("chunk_no", "_chunk"))
    return rows.filter("chunk_no is not null").select(
        *keep, "chunk_no", "_chunk.n_words", "_chunk.content"
    )


def chunk_documents(docs: DataFrame, **options) -> DataFrame:
    return explode_chunks(pack_chunks(docs, **options))


def whole_documents(docs: DataFrame, text="content") -> DataFrame:
    """Each document as its only chunk; blank ones are neither stored nor counted as errors."""
    keep = [c for c in docs.columns if c != text]
    return docs.filter(not_blank(F.col(text))).select(
        *keep, F.lit(0).alias("chunk_no"),
        meaningful_words(F.col(text)).alias("n_words"), F.col(text).alias("content"),
    )


def batch_plan(packed: DataFrame, key: str, size=schemas.OUTER_BATCH) -> DataFrame:
    """The batches a document's chunks are handed over in; positions and numbers from 1."""
    count = F.size("chunks")
    batches = F.when(count > 0, F.sequence(F.lit(1), F.ceil(count / size).cast("int")))
    return (
        packed.select(key, count.alias("n_chunks"), F.explode(batches).alias("batch_no"))
        .withColumn("first_chunk", (F.col("batch_no") - 1) * size + 1)
        .withColumn("last_chunk", F.least(F.col("batch_no") * size, F.col("n_chunks")))
        .withColumn("n_batches", F.ceil(F.col("n_chunks") / size).cast("int"))
    )
