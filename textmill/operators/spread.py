"""Chunks of documents of any size: paragraphs are rows, and a document is spread over tasks.

What the paragraphs before a block mean to it is one number: the words in the chunk that is
open. So a block of paragraphs is a function from that number to the one after it, and to
the chunks it closes; it is worked out for all numbers at once, which soon meet in few. The
functions of a document's blocks are composed in order, so every block learns with what it
begins, and is then cut as if it were the whole. The work is linear in the paragraphs, and
a task holds one block, or the functions of one document: `max_words` + 2 numbers for every
`WIDTH` paragraphs.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill import schemas
from textmill.functions.text import meaningful_words, trimmed
from textmill.operators.chunking import CHUNK_JOIN, split_paragraphs
from textmill.operators.ordered import OrderedLog
from textmill.session import new_folder

# Paragraphs of a block, and bytes of a file whose lines are numbered together.
WIDTH, FILE_WIDTH = 1 << 16, 1 << 24
# Paragraphs or blocks that are worked on together, and paragraphs of a block that is short.
_TOGETHER, _SHORT = 32, 64


def paragraph_rows(docs: DataFrame, key: str, text: str = "content") -> DataFrame:
    """(key, i, part): the paragraphs of documents that fit a row, numbered from 0."""
    rows = docs.select(key, F.posexplode_outer(split_paragraphs(F.col(text))).alias("i", "part"))
    return rows.filter("i is not null").select(key, F.col("i").cast("bigint").alias("i"), "part")


def scan_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """(url, i, part): the paragraphs of text files, which Spark splits, so that a file may be of any size.

    Lines are numbered by where their part of the file begins and by their order in it.
    A paragraph is a run of lines that are not blank.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("url"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"), "value",
        F.col("value").rlike(r"^[ \t\n\x0B\f\r]*$").alias("blank"))
    order = ["start", "line"]
    known = OrderedLog(lines, ["url"], order, FILE_WIDTH).scan(previous={"_blank_before": F.col("blank")})
    first = ~F.col("blank") & F.coalesce("_blank_before", F.lit(True))
    numbered = known.with_columns({"_first": first.cast("bigint")}).scan(sums={"_i": F.col("_first")}).result()
    parts = numbered.filter(~F.col("blank")).groupBy("url", "_i").agg(
        F.sort_array(F.collect_list(F.struct(*order, "value"))).alias("lines"))
    text = trimmed(F.array_join(F.col("lines.value"), "\n"))
    return parts.select("url", F.col("_i").alias("i"), text.alias("part")).filter("part <> ''")


def _function(counts: np.ndarray, max_words: int) -> tuple[np.ndarray, np.ndarray]:
    """For every number of open words before the paragraphs: open words after them, and chunks closed.

    Numbers above the maximum act alike and are one, the maximum + 1.
    """
    state, whose = np.arange(max_words + 2), np.arange(max_words + 2)
    closed = np.zeros(max_words + 2, np.int64)
    for k in range(0, len(counts), _TOGETHER):
        some = counts[k:k + _TOGETHER]
        if len(state) == 1:
            chunks, last = _cut(some, int(state[0]), max_words)
            closed += chunks[-1]
            state[0] = min(last, max_words + 1)
            continue
        lately = np.zeros(len(state), np.int64)
        for n in some:
            closes = (state > 0) & (state + n > max_words)
            state = np.minimum(np.where(closes, n, state + n), max_words + 1)
            lately += closes
        # Numbers that have met go on as one.
        closed += lately[whose]
        state, back = np.unique(state, return_inverse=True)
        whose = back[whose]
    return state[whose], closed


def _short_functions(counts: list[np.ndarray], max_words: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """As `_function` for several blocks of few paragraphs, which are worked out side by side."""
    lengths = np.array([len(some) for some in counts], np.int64)
    state = np.tile(np.arange(max_words + 2), (len(counts), 1))
    closed = np.zeros_like(state)
    for k in range(lengths.max(initial=0)):
        here = lengths > k
        n = np.array([some[k] if k < len(some) else 0 for some in counts], np.int64)[:, None]
        closes = (state > 0) & (state + n > max_words) & here[:, None]
        state = np.minimum(np.where(closes, n, state + n), max_words + 1)
        closed += closes
    return list(zip(state, closed))


def _cut(counts: np.ndarray, state: int, max_words: int) -> tuple[np.ndarray, int]:
    """Chunks closed before each paragraph, one that closes just before it included, and the open words at the end."""
    closes = np.zeros(len(counts), np.int64)
    for k, n in enumerate(counts.tolist()):
        if state > 0 and state + n > max_words:
            closes[k], state = 1, n
        else:
            state += n
    return np.cumsum(closes), state


def _whole_groups(frames: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Sorted rows in frames that end where a group ends, whatever the batches they come in."""
    rest = None
    for frame in frames:
        if not len(frame):
            continue
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        last = _starts(frame, by)[-1]
        if last:
            yield frame.iloc[:last].reset_index(drop=True)
        rest = frame.iloc[last:].reset_index(drop=True)
    if rest is not None:
        yield rest


def _starts(frame: pd.DataFrame, by: list[str]) -> np.ndarray:
    """Where groups of equal neighbours begin."""
    new = np.zeros(len(frame), bool)
    new[0] = True
    for column in by:
        values = frame[column].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def _spans(starts: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    return zip(starts.tolist(), [*starts[1:].tolist(), n])


def spread_chunks(parts: DataFrame, key: str, max_words=schemas.MAX_WORDS, min_words=schemas.MIN_WORDS, width=WIDTH) -> DataFrame:
    """(key, chunk_no, n_words, content) as `chunk_documents` cuts them, from rows (key, i, part).

    Blocks pass through Python as sorted rows, many of them in a batch. Functions are formed of the
    blocks that another one of their document follows. Words are counted once. Texts stay out of it until their paragraphs
    have chunk numbers: they are shuffled to these, and to their chunks. Rows without a key are left out.
    """
    kind = parts.schema[key].dataType.simpleString()
    blocks = [key, "block"]
    spark, folder = parts.sparkSession, new_folder(parts.sparkSession, "numbered")
    parts.filter(F.col(key).isNotNull()).select(
        key, "i", F.floor(F.col("i") / width).cast("bigint").alias("block"), meaningful_words(F.col("part")).alias("n")
    ).write.parquet(f"{folder}/sized")
    sized = spark.read.parquet(f"{folder}/sized")

    def functions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _whole_groups(frames, blocks):
            counts, starts = frame["n"].to_numpy(), _starts(frame, blocks)
            first = frame["first"].to_numpy()
            for some in np.array_split(starts, -(-len(starts) // _TOGETHER)):
                ends = np.append(starts, len(frame))[np.searchsorted(starts, some) + 1]
                made = dict.fromkeys(some.tolist())
                short = [(a, b) for a, b in zip(some.tolist(), ends.tolist()) if b - a <= _SHORT and not first[a]]
                made.update(zip((a for a, _ in short), _short_functions([counts[a:b] for a, b in short], max_words)))
                for a, b in zip(some.tolist(), ends.tolist()):
                    if first[a]:  # begins with no open words
                        chunks, last = _cut(counts[a:b], 0, max_words)
                        made[a] = np.array([min(last, max_words + 1)]), chunks[-1:]
                    elif made[a] is None:
                        made[a] = _function(counts[a:b], max_words)
                yield frame.loc[some, blocks].assign(
                    after=[after for after, _ in made.values()], closed=[closed for _, closed in made.values()])

    def begin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _whole_groups(frames, [key]):
            after, closed = frame["after"].to_numpy(), frame["closed"].to_numpy()
            states, chunks = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            for a, b in _spans(_starts(frame, [key]), len(frame)):
                state, chunk = 0, 0
                for k in range(a, b):
                    state, chunk = int(after[k][state]), chunk + int(closed[k][state])
                    states[k], chunks[k] = state, chunk
            yield frame[[key, "next"]].assign(state=states, chunk=chunks).rename(columns={"next": "block"})

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _whole_groups(frames, blocks):
            counts, states = frame["n"].to_numpy(), frame["state"].to_numpy()
            chunk, starts = frame["chunk"].to_numpy().copy(), _starts(frame, blocks)
            for a, b in _spans(starts, len(frame)):
                chunk[a:b] += _cut(counts[a:b], int(states[a]), max_words)[0]
            same = _starts(frame, [*blocks, "i"])
            times = np.diff(np.append(same, len(frame)))
            yield frame[[key, "i", "n"]].assign(chunk=chunk, times=np.repeat(times, times))

    # A number of tasks of its own: rows are few bytes and much work, which AQE would put together.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    follow = Window.partitionBy(key).orderBy("block")
    known = sized.select(*blocks).distinct().select(
        *blocks, F.lead("block").over(follow).alias("next"), F.lag("block").over(follow).isNull().alias("first"))
    ended = sized.join(known.filter("next is not null"), blocks)
    made = ended.repartition(tasks, *blocks).sortWithinPartitions(*blocks, "i").select(*blocks, "n", "first").mapInPandas(
        functions, f"{key} {kind}, block bigint, after array<bigint>, closed array<bigint>")
    begins = made.join(known.select(*blocks, "next"), blocks).repartition(tasks, key).sortWithinPartitions(*blocks).mapInPandas(
        begin, f"{key} {kind}, block bigint, state bigint, chunk bigint")
    placed = sized.join(begins, blocks, "left").select(
        *blocks, "i", "n", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("state", "chunk")])
    placed.repartition(tasks, *blocks).sortWithinPartitions(*blocks, "i").mapInPandas(
        number, f"{key} {kind}, i bigint, n int, chunk bigint, times bigint").write.parquet(f"{folder}/chunks")
    numbered = spark.read.parquet(f"{folder}/chunks")
    # A paragraph that is given several times is joined with each of its rows.
    sizes = numbered.groupBy(key, "chunk").agg(F.sum(F.col("n") * F.col("times")).alias("n_words"))
    counted = OrderedLog(sizes.filter(F.col("n_words") >= min_words), [key], ["chunk"]).scan(sums={"_nth": F.lit(1)}).result()
    chosen = counted.select(key, "chunk", "n_words", (F.col("_nth") - 1).cast("int").alias("chunk_no"))
    homes = numbered.select(key, "i", "chunk").join(chosen, [key, "chunk"]).drop("chunk")
    chunks = parts.select(key, "i", "part").join(homes, [key, "i"]).groupBy(key, "chunk_no").agg(
        F.max("n_words").cast("int").alias("n_words"), F.sort_array(F.collect_list(F.struct("i", "part"))).alias("parts"))
    return chunks.select(key, "chunk_no", "n_words", F.array_join("parts.part", CHUNK_JOIN).alias("content"))
