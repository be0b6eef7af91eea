"""Maximal runs of repeated word sequences, found on a grammar by recompression.

A run is a stretch of words with smallest period q, at least `LEAST` words and
`TIMES` periods long, that no neighbouring word extends keeping the period.

Candidates come from the harmonic grid: a run of four periods holds four
consecutive multiples of its period, and the words there are equal. Texts with
candidates are compressed to a run-length grammar: blocks of one symbol and then
pairs across a split of the symbols become new symbols, in turn, until little is
left. Equal stretches are parsed alike but for their ends, so how far two places
agree is found by climbing the levels while both are at the start of a symbol and
descending where symbols differ; blocks are crossed in one step. From a candidate
that answer, forwards and backwards, is the exact extent of its run, and
candidates inside a known extent are skipped. A stretch with several periods is
kept with the smallest. There are no suffix arrays.

The texts of a batch are compressed together, with a symbol of its own between
two texts, and all questions climb and descend together in numpy. Memory and time
follow the words of a batch, n log n for the grid; a text is worked on whole, in
the task that holds it.

Edge cases: null and empty texts have no words and no runs. Repeated rows are
treated alike, and an empty table gives none. Columns beyond the text are kept;
one that is named like a column added is replaced.
"""

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST, TIMES = 6, 4
# Words that are compressed together, and the symbols at which compression ends.
WORDS_AT_ONCE, FEW = 400_000, 8
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Level:
    """Symbols of one level, and the index of each one's symbol on the next level."""

    def __init__(self, symbols: np.ndarray, parent: np.ndarray | None = None, blocks=False):
        self.symbols, self.parent, self.blocks = symbols, parent, blocks
        if parent is not None:
            self.first = np.ones(len(parent), bool)
            self.first[1:] = parent[1:] != parent[:-1]
            self.child = np.append(np.flatnonzero(self.first), len(parent)).astype(np.int32)

    def reversed(self) -> "Level":
        parent = None if self.parent is None else self.parent[-1] - self.parent[::-1]
        return Level(self.symbols[::-1], parent, self.blocks)

    def cross(self, x: np.ndarray, y: np.ndarray):
        """How many symbols to go on from equal symbols x and y: to the end of the shorter block, or one."""
        if not self.blocks:
            return 1
        return np.minimum(self.child[self.parent[x] + 1] - x, self.child[self.parent[y] + 1] - y)


def _named(symbols: np.ndarray, where: np.ndarray, high: np.ndarray, low: np.ndarray, fresh: int) -> int:
    """Give symbols[where] new names, equal for equal (high, low); the next free name."""
    keys, names = np.unique(high.astype(np.int64) << 32 | low, return_inverse=True)
    symbols[where] = fresh + names
    return fresh + len(keys)


def _side(symbols: np.ndarray, turn: int) -> np.ndarray:
    """A split of the symbols into two halves, another one every turn."""
    mixed = (symbols.astype(np.uint64) + np.uint64(turn + 1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD1B54A32D192ED03 + 2 * turn)
    return (mixed >> np.uint64(63)).astype(bool)


def recompress(text: np.ndarray) -> list[Level]:
    """The levels of the grammar of `text`, whose first and last symbols occur once."""
    symbols, fresh, levels = text.astype(np.int32), int(text.max()) + 1, []
    turn = 0
    while len(symbols) > FEW:
        starts = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
        if len(starts) < len(symbols):
            lengths = np.diff(np.append(starts, len(symbols)))
            parent = np.repeat(np.arange(len(starts), dtype=np.int32), lengths)
            levels.append(Level(symbols, parent, True))
            symbols = symbols[starts]
            blocks = np.flatnonzero(lengths > 1)
            fresh = _named(symbols, blocks, symbols[blocks], lengths[blocks], fresh)
        side = _side(symbols, turn)
        turn += 1
        pairs = ~side[:-1] & side[1:]
        other = side[:-1] & ~side[1:]
        if np.count_nonzero(other) > np.count_nonzero(pairs):
            pairs = other
        at = np.flatnonzero(pairs)
        if not len(at):
            continue
        head = np.ones(len(symbols), bool)
        head[at + 1] = False
        parent = (np.cumsum(head) - 1).astype(np.int32)
        levels.append(Level(symbols, parent))
        above = symbols[head]
        fresh = _named(above, parent[at], symbols[at], symbols[at + 1], fresh)
        symbols = above
    levels.append(Level(symbols))
    return levels


def agree(levels: list[Level], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols of the text agree from places i and j on (i and j differ everywhere)."""
    x, y = i.astype(np.int64), j.astype(np.int64)
    depth = np.zeros(len(x), np.int64)
    climbing = np.arange(len(x))
    for t, level in enumerate(levels):
        rising, active = [], climbing
        while len(active):
            ax, ay = x[active], y[active]
            same = level.symbols[ax] == level.symbols[ay]
            depth[active[~same]] = t
            active, ax, ay = active[same], ax[same], ay[same]
            if level.parent is not None:
                ready = level.first[ax] & level.first[ay]
                rising.append(active[ready])
                active, ax, ay = active[~ready], ax[~ready], ay[~ready]
            step = level.cross(ax, ay)
            x[active] += step
            y[active] += step
        if level.parent is None:
            break
        climbing = np.concatenate(rising) if rising else climbing[:0]
        x[climbing], y[climbing] = level.parent[x[climbing]], level.parent[y[climbing]]
    for t in range(len(levels) - 1, 0, -1):
        level, active = levels[t - 1], np.flatnonzero(depth == t)
        x[active], y[active] = level.child[x[active]], level.child[y[active]]
        depth[active] = t - 1
        while len(active):
            ax, ay = x[active], y[active]
            same = level.symbols[ax] == level.symbols[ay]
            active, ax, ay = active[same], ax[same], ay[same]
            step = level.cross(ax, ay)
            x[active] += step
            y[active] += step
    return x - i


def candidates(text: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Places g, multiples of q, with equal words at g, g + q, g + 2q and g + 3q, by q and place.

    Small periods are walked period by period, large ones by the number of the
    multiple. Three more words inside the period have to repeat as well.
    """
    n, most = len(text), longest // TIMES
    root = min(most, isqrt(n))
    found = []
    for q in range(1, root + 1):
        grid = text[::q]
        same = grid[1:] == grid[:-1]
        k = np.flatnonzero(same[2:] & same[1:-1] & same[:-2])
        if len(k):
            found.append((k * q, np.full(len(k), q)))
    low = root + 1
    for k in range(1, n // low):
        high = min(most, (n - 1) // (k + 3))
        if high < low:
            break
        words = [text[m * low:m * high + 1:m] for m in range(k, k + 4)]
        q = low + np.flatnonzero((words[0] == words[1]) & (words[1] == words[2]) & (words[2] == words[3]))
        if len(q):
            found.append((k * q, q))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    g, q = (np.concatenate(c) for c in zip(*found))
    for share in (1 / 3, 1 / 2, 1):
        at = g + np.minimum(q - 1, (q * share).astype(np.int64))
        keep = (text[at] == text[at + q]) & (text[at + q] == text[at + 2 * q])
        g, q = g[keep], q[keep]
    order = np.lexsort((g, q))
    return g[order], q[order]


def extents(levels: list[Level], g: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of the stretches of period q around the candidates.

    Neighbouring candidates of a period form a row. Of every row the first is
    asked, then the first two beyond what is known, then four, and so on, so a
    long run costs one question and a row of short stretches few rounds.
    """
    back, n = [level.reversed() for level in levels], len(levels[0].symbols)
    new = np.append(True, (q[1:] != q[:-1]) | (np.diff(g) != q[1:]))
    at, end = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(g))
    size, found = 1, []
    while len(at):
        counts = np.minimum(size, end - at)
        asked = np.repeat(at - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        a, p = g[asked], q[asked]
        after = agree(levels, a, a + p)
        before = agree(back, n - a, n - a - p)
        found.append((a - before, a + p + after, p))
        last = at + counts - 1
        known = (a + after)[np.cumsum(counts) - 1]
        at = np.maximum(last + 1, last - (g[last] - known) // q[last])
        left = at < end
        at, end, size = at[left], end[left], 2 * size
    return tuple(np.concatenate(c) for c in zip(*found))


def find_runs(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Runs (start, length, period) of every text, by start and period. Words are numbers below 2^30."""
    empty = np.zeros((0, 3), np.int64)
    out = [empty] * len(texts)
    used = [i for i, text in enumerate(texts) if len(text) >= LEAST]
    if not used:
        return out

    def joined(which):
        sizes = np.array([len(texts[i]) + 1 for i in which])
        starts = np.cumsum(sizes) - sizes + 1
        text = np.empty(sizes.sum() + 1, np.int64)
        borders = np.append(starts - 1, len(text) - 1)
        text[borders] = (1 << 30) + np.arange(len(borders))
        for start, i in zip(starts, which):
            text[start:start + len(texts[i])] = texts[i]
        return text, starts

    text, starts = joined(used)
    g, q = candidates(text, max(len(texts[i]) for i in used))
    if not len(g):
        return out
    # Only texts with candidates are compressed.
    whose = np.searchsorted(starts, g, "right") - 1
    chosen = np.unique(whose)
    compressed, moved = joined([used[i] for i in chosen])
    _, dense = np.unique(compressed, return_inverse=True)
    place = np.searchsorted(chosen, whose)
    start, end, period = extents(recompress(dense), g - starts[whose] + moved[place], q)
    long = end - start >= np.maximum(LEAST, TIMES * period)
    start, end, period = start[long], end[long], period[long]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]))[:len(start)]
    start, end, period = start[new], end[new], period[new]
    owner = np.searchsorted(moved, start, "right") - 1
    rows = np.stack([start - moved[owner], end - start, period], axis=1)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0], owner))]
    cuts = np.searchsorted(np.sort(owner), np.arange(len(chosen) + 1))
    for n, i in enumerate(chosen):
        out[used[i]] = rows[cuts[n]:cuts[n + 1]]
    return out


def collapse(words: list, runs: np.ndarray) -> list:
    """The words without those that any run holds after its first period."""
    if not len(runs):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0)]


def _groups(texts: Iterator[bytes | None]) -> Iterator[list[list[bytes]]]:
    """Words of the texts, as many texts together as have WORDS_AT_ONCE words."""
    group, size = [], 0
    for text in texts:
        words = (text or b"").split()
        if group and size + len(words) > WORDS_AT_ONCE:
            yield group
            group, size = [], 0
        group.append(words)
        size += len(words)
    if group:
        yield group


def with_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, the runs, and the text collapsed to one period per run; one narrow pass."""
    added = ("n_words", "runs", "collapsed")
    kept = [c for c in docs.columns if c not in added]
    fields = [docs.schema[c] for c in kept]
    run_type = T.StructType.fromDDL(f"runs {RUNS}")[0].dataType
    schema = T.StructType([
        *fields, T.StructField("n_words", T.LongType()), T.StructField("runs", run_type), T.StructField("collapsed", T.BinaryType()),
    ])
    names = [f"c{i}" for i in range(len(kept))]
    packed = docs.select(*(F.col(c).alias(n) for c, n in zip(kept, names)), F.col(text).cast("binary").alias("_text"))
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for group in _groups(value.as_py() for value in batch.column("_text")):
                seen: dict[bytes, int] = {}
                numbers = [np.array([seen.setdefault(w, len(seen)) for w in words], np.int64) for words in group]
                runs = find_runs(numbers)
                flat = np.concatenate(runs)
                values = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(struct))
                offsets = np.cumsum([0, *map(len, runs)]).astype(np.int32)
                part = batch.slice(done, len(group))
                yield pa.RecordBatch.from_arrays([
                    *(part.column(n) for n in names), pa.array([len(words) for words in group], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), values),
                    pa.array([b" ".join(collapse(words, r)) for words, r in zip(group, runs)], pa.binary()),
                ], [f.name for f in schema])
                done += len(group)

    return packed.mapInArrow(run, schema).withColumn("collapsed", F.col("collapsed").cast("string"))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, with a periodic end planted in a tenth of the texts.

    With h the CRC-32 of the decimal doc_id and g = h // 10: where h % 10 = 0, each
    word i >= a = g % n becomes word a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8).
    A null doc_id has no h, and its text stays.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(row):
        w, n = row["words"], F.size(row["words"]).cast("long")
        a = F.floor(h / 10) % n
        p = 1 + F.floor((n - a) / (3 + F.floor(h / 10) % 8))
        ending = F.transform(F.sequence(a, n - 1), lambda i: F.get(w, (a + (i - a) % p).cast("int")))
        return F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), ending), " ")

    once = F.get(F.transform(F.array(F.struct(words.alias("words"))), repeated), F.lit(0))
    changed = (F.coalesce(h, F.lit(1)) % 10 == 0) & F.coalesce(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    return docs.select("doc_id", F.when(changed, once).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """From rows of `with_runs`: n_runs, the run of greatest exponent, and hashes of all runs and the collapsed text."""
    def better(best, run):
        more = run["length"] * best["period"]
        less = best["length"] * run["period"]
        return F.when(best["period"].isNull() | (more > less), run).otherwise(best)

    nothing = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", nothing, lambda best, run: F.when(best.isNull(), run).otherwise(better(best, run)))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    with_best = found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
    return with_best.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words",
    )
