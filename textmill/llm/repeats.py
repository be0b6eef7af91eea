"""Removing long byte strings that occur more than once, by a Burrows-Wheeler transform.

Every byte covered by a string of `least` bytes that also starts elsewhere, in
any document or in the same one, is removed.

Work is divided by content. A window is `least` bytes; its mark is the smallest
hash of the strings of `k` bytes inside it. Equal windows have equal marks, so a
window whose mark occurs once is no repeat, and windows need to meet only those
of their own mark. Neighbouring windows with one mark form a segment. Marks are first counted over all documents
as narrow rows, which leaves the texts in place; only texts with marks that occur
again move. Equal segments are one segment with a count. Segments of a mark meet in
a shard of bounded size. Where a mark has more bytes than that (a common passage in
many contexts), its distinct segments are cut again by longer marks, at last by marks
of whole windows, of which all segments are equal.

A segment with a count above one stands for that many equal ones, so all its windows
are repeats. Where it is also the only segment of its mark, no other text has anything
to compare with it, and its bytes do not move. All other segments meet in their shards.

In a shard, segments are put in suffix order, each ended by a mark of its own. Intervals of suffixes with a common
prefix are expanded breadth first by one byte to the left through the
transform, which finds the lengths of the common prefixes of neighbours by
increasing value. The expansion stops at `least`: suffixes whose common prefix
has not been bounded by then share a window.

Edge cases: a null text is empty; texts shorter than `least` have no repeats.
Repeated rows are repeats of each other. Strings may overlap themselves, as in a
run of one letter. Long texts are handled whole. A null doc_id is a document
like any other; extra columns are ignored. An empty table gives no rows.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

LEAST = 400
# Lengths of marks, as shares of a window: for all texts, then for crowded marks.
SHARES = (0.32, 0.9, 0.97, 1.0)
# Bytes that are transformed together, so that a transform stays in a processor's cache.
SHARD = 1 << 16
# Bytes of a mark's segments beyond which the mark is split.
CROWDED = 1 << 16

_RANDOM = np.random.default_rng(7).integers(1 << 63, size=256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class Marker:
    """Segments of a text by the marks of its windows; keeps powers between texts."""

    def __init__(self, least: int, share: float):
        self.least, self.k = least, max(1, round(least * share))
        self.up, self.down = _powers(1)

    def segments(self, data: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(mark, first window, last window, whether the string behind the mark is there twice: 2, or once: 1).

        A segment may hold repeats of its own windows only if that string is in it twice.
        """
        if len(data) < self.least:
            return []
        if len(self.up) < len(data):
            self.up, self.down = _powers(len(data) * 5 // 4)
        k = self.k
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_RANDOM[data] * self.up[:len(data)], out=sums[1:])
        h = (sums[k:] - sums[:-k]) * self.down[:len(data) - k + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        wide, size, count = self.least - k + 1, 1, len(data) - self.least + 1
        least = h
        while 2 * size <= wide:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        marks = np.minimum(least[:count], least[wide - size:wide - size + count])
        first, last = runs(marks)
        h, signed = h.view(np.int64), marks[first].view(np.int64).tolist()
        return [
            (m, a, b, min(2, int(np.count_nonzero(h[a:b + wide] == m))))
            for m, a, b in zip(signed, first.tolist(), last.tolist())
        ]


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of every run of equal values."""
    if not len(values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1])
    return first, np.concatenate([first[1:], [len(values)]]) - 1


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order. Symbol 0 ends a segment; each 0 differs from all
    others, and earlier ones are smaller. The last symbol is 0."""
    n = len(symbols)
    key, alive = np.zeros(n, np.int64), np.ones(n, bool)
    padded = np.concatenate([symbols, np.zeros(7, symbols.dtype)])
    for i in range(7):
        here = padded[i:i + n]
        key = (key << 9) | np.where(alive, here, 0)
        alive &= here != 0
    order = np.argsort(key)
    # Suffixes that ended are all different; equal keys stand by position, as their ends do.
    ended = np.flatnonzero(~alive[order])
    some = order[ended]
    order[ended] = some[np.lexsort((some, key[some]))]
    new = np.ones(n, bool)
    new[1:] = (key[order[1:]] != key[order[:-1]]) | ~alive[order[1:]]
    rank = np.empty(n, np.int64)
    length = 7
    slots = np.arange(n)
    group = np.flatnonzero(new)[np.cumsum(new) - 1]
    rank[order] = group
    while True:
        # Only suffixes that still share a rank are sorted again.
        shared = np.zeros(len(slots), bool)
        same = group[1:] == group[:-1]
        shared[1:] |= same
        shared[:-1] |= same
        slots = slots[shared]
        if not len(slots):
            return order
        group = group[shared]
        at = order[slots]
        inner = rank[at + length]
        by = np.argsort(group * n + inner)
        at, inner = at[by], inner[by]
        order[slots] = at
        new = np.ones(len(slots), bool)
        new[1:] = (group[1:] != group[:-1]) | (inner[1:] != inner[:-1])
        group = slots[np.flatnonzero(new)][np.cumsum(new) - 1]
        rank[at] = group
        length *= 2


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.arange(count.sum()) + np.repeat(start - (np.cumsum(count) - count), count)


def bounded_prefixes(symbols: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """For each row of the suffix order, whether its common prefix with the row above is shorter than `least`."""
    n = len(symbols)
    order = order.astype(np.int32)
    row_of = np.empty(n, np.int32)
    row_of[order] = np.arange(n, dtype=np.int32)
    before = order - 1
    # The transform: the symbol before each suffix, and the row of the suffix that it begins.
    transform = symbols[before]
    extends = (transform != 0) & (order > 0)
    left = np.where(extends, row_of[before], 0)
    # Neighbouring rows with the same symbol of the transform begin neighbouring suffixes.
    right = np.where(order < n - 1, order + 1, order)
    back = row_of[right]
    first_symbol = symbols[order]
    next_same, last_same = np.full(n, n, np.int32), np.full(n, -1, np.int32)
    together = np.flatnonzero((first_symbol[1:] == first_symbol[:-1]) & (first_symbol[1:] != 0)) + 1
    next_same[back[together - 1]] = back[together]
    last_same[back[together]] = back[together - 1]

    ends = int((symbols == 0).sum())
    known = np.zeros(n + 1, bool)
    known[:ends + 1] = known[n] = True
    chars = np.concatenate([np.flatnonzero(first_symbol[1:] != first_symbol[:-1]) + 1, [n]])
    chars = chars[chars >= ends]
    known[chars] = True
    # Intervals of single symbols; every end mark is an interval of its own.
    low = np.concatenate([np.arange(ends), chars[:-1]])
    high = np.concatenate([np.arange(ends), chars[1:] - 1])
    for _ in range(1, least):
        if not len(low):
            break
        count = high - low + 1
        rows = _ranges(low, count)
        owner_low, owner_high = np.repeat(low, count), np.repeat(high, count)
        usable = extends[rows]
        rows, owner_low, owner_high = rows[usable], owner_low[usable], owner_high[usable]
        low = np.sort(left[rows[last_same[rows] < owner_low]])
        high = np.sort(left[rows[next_same[rows] > owner_high]])
        fresh = ~known[high + 1]
        low, high = low[fresh], high[fresh]
        known[high + 1] = True
    return known[:n]


def repeated_starts(texts: list[bytes], least: int) -> list[np.ndarray]:
    """For each text, the starts of strings of `least` bytes that also start elsewhere in these texts."""
    total = sum(map(len, texts)) + len(texts)
    symbols = np.zeros(total, np.int16)
    starts, at = [], 0
    for text in texts:
        starts.append(at)
        symbols[at:at + len(text)] = np.frombuffer(text, np.uint8).astype(np.int16) + 1
        at += len(text) + 1
    order = suffix_order(symbols)
    open_ = np.flatnonzero(~bounded_prefixes(symbols, order, least))
    hit = np.zeros(total, bool)
    hit[order[open_]] = hit[order[open_ - 1]] = True
    return [np.flatnonzero(hit[s:s + len(t)]) for s, t in zip(starts, texts)]


def _arrays(rows, names, types):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names)


def scanned(docs: DataFrame, least=LEAST, share=SHARES[0]) -> DataFrame:
    """doc_id, key (64-bit hash of the text), sha256, n_bytes and the segments of each text, by mark."""
    def run(batches):
        marker = Marker(least, share)
        for batch in batches:
            out = []
            for doc_id, key, text in zip(*(batch.column(c) for c in ("doc_id", "key", "text"))):
                data = (text.as_py() or "").encode()
                found = marker.segments(np.frombuffer(data, np.uint8))
                out.append((
                    doc_id.as_py(), key.as_py(), hashlib.sha256(data).hexdigest(), len(data),
                    [{"mark": m, "first": a, "last": b, "times": t} for m, a, b, t in found],
                ))
            yield _arrays(out, ["doc_id", "key", "sha256", "n_bytes", "segments"], [
                pa.int64(), pa.int64(), pa.string(), pa.int64(),
                pa.list_(pa.struct([("mark", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("times", pa.int32())])),
            ])

    return _texts(docs).mapInArrow(
        run, "doc_id long, key long, sha256 string, n_bytes long, segments array<struct<mark: long, first: int, last: int, times: int>>",
    )


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("key"), text.alias("text"))


def _again(marks: DataFrame) -> DataFrame:
    """Marks that occur more than once; a row occurs `n` times, its mark `times` in each."""
    return marks.groupBy("mark").agg(F.sum(F.col("n") * F.col("times")).alias("n")).filter("n > 1").select("mark")


def _union(spans) -> list[tuple[int, int]]:
    """Inclusive spans, merged where they touch."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def candidates(docs: DataFrame, scan: DataFrame) -> DataFrame:
    """Distinct texts with windows whose mark occurs again: sha256, text, copies and those windows."""
    marks = scan.select("key", F.explode("segments").alias("s")).select("key", "s.mark", "s.first", "s.last", "s.times")
    again = _again(marks.select("mark", F.lit(1).alias("n"), "times"))
    spans = marks.join(again, "mark").groupBy("key").agg(F.collect_set(F.struct("first", "last")).alias("windows"))
    texts = _texts(docs).filter("text <> ''").select("key", "text").join(spans, "key")
    return texts.groupBy(F.sha2("text", 256).alias("sha256")).agg(
        F.first("text").alias("text"), F.first("windows").alias("windows"), F.count(F.lit(1)).alias("copies"),
    )


_SEGMENT = "sha256 string, parent binary, base int, mark long, segment binary, firsts array<int>, size int, n long, times int"


def _cut(rows: DataFrame, least: int, share: float) -> DataFrame:
    """Segments of spans of windows; `segment` is a hash of the segment's bytes.

    `rows` has sha256, text and spans of (parent, first, last, n); spans of no parent may
    overlap and are merged. `base` is where the span of a parent began. A segment that a parent
    (a text, where there is none) has several times is one row with all its places: a period
    that goes on has as many segments as windows, and few that differ.
    """
    def run(batches):
        marker = Marker(least, share)
        for batch in batches:
            for sha, text, spans in zip(*(batch.column(c) for c in ("sha256", "text", "spans"))):
                data, out = text.as_py().encode(), []
                given = [tuple(s.values()) for s in spans.as_py()]
                loose = [s for s in given if s[0] is None]
                merged = [(None, a, b, loose[0][3]) for a, b in _union((s[1], s[2]) for s in loose)]
                places: dict[tuple, list[int]] = {}
                for parent, low, high, n in merged + [s for s in given if s[0] is not None]:
                    for mark, a, b, times in marker.segments(np.frombuffer(data, np.uint8)[low:high + least]):
                        part = data[low + a:low + b + least]
                        key = hashlib.blake2b(part, digest_size=16).digest()
                        firsts = places.get((parent, key))
                        if firsts is None:
                            firsts = places[parent, key] = []
                            out.append((sha.as_py(), parent, low, mark, key, firsts, len(part), n, times))
                        firsts.append(low + a)
                yield _arrays(
                    out, ["sha256", "parent", "base", "mark", "segment", "firsts", "size", "n", "times"],
                    [pa.string(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.int32(), pa.int64(), pa.int32()],
                )

    return rows.select("sha256", "text", "spans").mapInArrow(run, _SEGMENT)


def _distinct(marked: DataFrame) -> DataFrame:
    """One row per segment whose mark occurs again, with one of its places.

    `lone`: it occurs more than once and is the only segment of its mark.
    """
    once = marked.groupBy("mark", "segment").agg(
        F.sum(F.col("n") * F.size("firsts")).alias("n"), F.max("times").alias("times"),
        F.min(F.struct("sha256", F.get("firsts", F.lit(0)).alias("first"), "size")).alias("place"),
    )
    again = once.groupBy("mark").agg(F.sum(F.col("n") * F.col("times")).alias("_n"), F.count(F.lit(1)).alias("_segments"))
    lone = (F.col("_segments") == 1) & (F.col("n") > 1)
    return once.join(again.filter("_n > 1"), "mark").select("mark", "segment", "n", "place.*", lone.alias("lone"))


def _found(texts: DataFrame, distinct: DataFrame, least: int) -> DataFrame:
    """segment and the spans of its windows that are repeats, through a transform for each shard."""
    wanted = distinct.groupBy("sha256").agg(F.collect_list(F.struct("mark", "segment", "n", "first", "size")).alias("wanted"))
    cut = texts.select("sha256", "text").join(wanted, "sha256").select("text", "wanted")

    def slices(batches):
        for batch in batches:
            for text, wanted in zip(batch.column("text"), batch.column("wanted")):
                data = text.as_py().encode()
                yield _arrays(
                    [(w["mark"], w["segment"], w["n"], data[w["first"]:w["first"] + w["size"]]) for w in wanted.as_py()],
                    ["mark", "segment", "n", "bytes"], [pa.int64(), pa.binary(), pa.int64(), pa.binary()],
                )

    def shards(batches):
        held, size, mark = [], 0, None
        for batch in batches:
            for m, segment, n, data in zip(*(batch.column(c) for c in ("mark", "segment", "n", "bytes"))):
                if size >= SHARD and m.as_py() != mark:
                    yield expand(held)
                    held, size = [], 0
                mark = m.as_py()
                held.append((segment.as_py(), n.as_py(), data.as_py()))
                size += len(held[-1][2])
        if held:
            yield expand(held)

    def expand(held):
        rows = []
        for (segment, n, data), hits in zip(held, repeated_starts([data for _, _, data in held], least)):
            if n > 1:
                rows.append((segment, [{"first": 0, "last": len(data) - least}]))
            elif len(hits):
                first, last = runs(hits - np.arange(len(hits)))
                rows.append((segment, [{"first": int(hits[a]), "last": int(hits[b])} for a, b in zip(first, last)]))
        return _arrays(rows, ["segment", "hits"], [pa.binary(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))])

    rows = cut.mapInArrow(slices, "mark long, segment binary, n long, bytes binary")
    dealt = rows.repartition("mark").sortWithinPartitions("mark")
    return dealt.mapInArrow(shards, "segment binary, hits array<struct<first: int, last: int>>")


def _moved(firsts):
    """The spans of `hits` of a segment, at every one of its places."""
    return F.flatten(F.transform(firsts, lambda first: F.transform("hits", lambda h: F.struct(
        (first + h["first"]).alias("first"), (first + h["last"]).alias("last"),
    ))))


def _hits(texts: DataFrame, marked: DataFrame, least: int, crowded: int, shares) -> DataFrame:
    """segment and its spans of repeated windows, for the segments of `marked`.

    Distinct segments of marks with many bytes are cut again by the next, longer marks,
    and what is found in the parts is put together for the whole.
    """
    every = stored(_distinct(marked), "distinct")
    all_windows = F.array(F.struct(F.lit(0).alias("first"), (F.col("size") - least).alias("last"))).alias("hits")
    lone, distinct = every.filter("lone").select("segment", all_windows), every.filter("not lone").drop("lone")
    if not shares:
        return stored(_found(texts, distinct, least).unionByName(lone), "hits")
    full = stored(distinct.groupBy("mark").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > crowded).select("mark"), "crowded")
    span = F.struct(
        F.col("segment").alias("parent"), "first", (F.col("first") + F.col("size") - least).alias("last"), "n",
    )
    crowd = distinct.join(full, "mark").groupBy("sha256").agg(F.collect_list(span).alias("spans"))
    parts = stored(_cut(texts.select("sha256", "text").join(crowd, "sha256"), least, shares[0]), "parts")
    inner = _hits(texts, parts, least, crowded, shares[1:])
    moved = _moved(F.transform("firsts", lambda first: first - F.col("base")))
    # Spans stay in arrays: a segment of a crowded mark has as many parts as windows that occur again.
    whole = parts.join(inner, "segment").select(F.col("parent").alias("segment"), moved.alias("h"))
    whole = whole.groupBy("segment").agg(F.flatten(F.collect_list("h")).alias("hits"))
    small = distinct.join(full, "mark", "left_anti")
    return stored(_found(texts, small, least).unionByName(whole).unionByName(lone), "hits")


def repeats(docs: DataFrame, least=LEAST, crowded=CROWDED) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row of `docs`."""
    scan = stored(scanned(docs, least), "scanned")
    texts = stored(candidates(docs, scan), "candidates")
    spans = F.transform("windows", lambda w: F.struct(
        F.lit(None).cast("binary").alias("parent"), w["first"].alias("first"), w["last"].alias("last"), F.col("copies").alias("n"),
    ))
    marked = stored(_cut(texts.withColumn("spans", spans), least, SHARES[0]), "marked")
    hits = _hits(texts, marked, least, crowded, SHARES[1:])
    spans = marked.select("sha256", "segment", "firsts").join(hits, "segment").select(
        "sha256", _moved(F.col("firsts")).alias("s"),
    ).groupBy("sha256").agg(F.flatten(F.collect_list("s")).alias("spans"))

    def run(batches):
        for batch in batches:
            rows = []
            for sha, text, spans in zip(*(batch.column(c) for c in ("sha256", "text", "spans"))):
                data = text.as_py().encode()
                cut = _union((s["first"], s["last"] + least - 1) for s in spans.as_py())
                kept, at = hashlib.sha256(), 0
                for a, b in cut:
                    kept.update(data[at:a])
                    at = b + 1
                kept.update(data[at:])
                rows.append((sha.as_py(), sum(b - a + 1 for a, b in cut), len(cut), kept.hexdigest(), [{"first": a, "last": b + 1} for a, b in cut]))
            yield _arrays(rows, ["sha256", "n_removed", "n_spans", "kept_sha256", "removed"], [
                pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])),
            ])

    removed = texts.select("sha256", "text").join(spans, "sha256").mapInArrow(
        run, "sha256 string, n_removed long, n_spans long, kept_sha256 string, removed array<struct<first: int, last: int>>",
    )
    return scan.select("doc_id", "sha256", "n_bytes").join(removed, "sha256", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept_sha256", "sha256").alias("kept_sha256"), "removed",
    )
