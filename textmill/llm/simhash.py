"""Near-duplicates by SimHash, searched through BK-trees.

A text is lower-cased (A-Z), cut into words, and every run of three words is
hashed (XXH64, seed 42, UTF-8). A bit of the fingerprint is set if it is set in
over half of the hashes. Documents whose fingerprints differ in at most
`radius` bits are linked.

Equal fingerprints are one node. Fingerprints are cut into `pieces` runs of
bits; two within the radius agree in at least pieces - radius of them, so it is
enough to search the shards of fingerprints that agree in some choice of that
many pieces. Within a shard a BK-tree is grown, children keyed by their Hamming
distance to the parent, and each fingerprint follows only the edges within the
radius of its own distance. All trees of a batch grow and are searched level by
level in numpy. Trees are built where the rows of their shard meet, since all of
them together grow with the documents and could not be broadcast. A shard of
over `largest` fingerprints is cut into parts; each pair of parts has its own
tree and its own task, so no pair is lost and no task holds a large shard.

Edge cases: a null, empty or blank text has fingerprint 0 and is linked like any
other; texts of one or two words are one shingle. A null doc_id takes part and
never names a component unless its component has no other. Repeated rows share
their component. Extra columns are kept by `one_of_each`. An empty table gives no
rows.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components

RADIUS = 3
PIECES = 5
LARGEST = 2000
# Rows that a task grows into trees at once, and pairs it looks at at once.
BATCH, PAIRS = 60_000, 1 << 20


def shingles(data: bytes, size: int) -> np.ndarray:
    """Hashes (uint64) of all runs of `size` words of a UTF-8 text; of all its words where it has fewer."""
    import xxhash

    words = data.lower().split()
    if not words:
        return np.empty(0, "<u8")
    runs = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) > size else [b" ".join(words)]
    return np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in runs), "<u8")


def fingerprint(data: bytes) -> int:
    """The fingerprint of a UTF-8 text, as a signed long."""
    hashes = shingles(data, 3)
    if not len(hashes):
        return 0
    votes = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 14):
        votes += np.unpackbits(hashes[start:start + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_id (a hash of id and text that names the row), fingerprint (long)."""
    def run(batches):
        for batch in batches:
            prints = [fingerprint((text.as_py() or "").encode()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_id"), pa.array(prints, pa.int64())],
                ["doc_id", "text_id", "fingerprint"],
            )

    return docs.select(F.col("doc_id").cast("long"), _text_id(), "text").mapInArrow(
        run, "doc_id long, text_id string, fingerprint long",
    )


def _text_id():
    return F.sha2(F.to_json(F.struct(F.col("doc_id").cast("string").alias("i"), F.col("text").alias("t"))), 256).alias("text_id")


class Forest:
    """BK-trees over fingerprints, one for each group of nodes, grown together."""

    def __init__(self, prints: np.ndarray, group: np.ndarray, nodes: np.ndarray):
        """prints: uint64; group: of each print, ascending; nodes: the indices to be put in trees, ascending."""
        self.prints = prints
        _, first = np.unique(group[nodes], return_index=True)
        self.root = np.full(group[-1] + 1, -1)
        self.root[group[nodes[first]]] = nodes[first]
        rest = np.delete(nodes, first)
        parent = self.root[group[rest]]
        keys, children = [], []
        while len(rest):
            key = parent * 65 + np.bitwise_count(prints[rest] ^ prints[parent])
            edges, first, place = np.unique(key, return_index=True, return_inverse=True)
            keys.append(edges)
            children.append(rest[first])
            parent = rest[first][place]
            stay = np.ones(len(rest), bool)
            stay[first] = False
            rest, parent = rest[stay], parent[stay]
        keys, children = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (keys, children))
        order = np.argsort(keys)
        self.keys, self.children = keys[order], children[order]

    def search(self, queries: np.ndarray, roots: np.ndarray, radius: int):
        """Yield pairs (query, node) of indices within the radius, level by level."""
        while len(queries):
            distance = np.bitwise_count(self.prints[queries] ^ self.prints[roots]).astype(np.int64)
            near = (distance <= radius) & (queries != roots)
            if near.any():
                yield queries[near], roots[near]
            start = np.searchsorted(self.keys, roots * 65 + np.maximum(distance - radius, 0), "left")
            count = np.searchsorted(self.keys, roots * 65 + np.minimum(distance + radius, 64), "right") - start
            queries = np.repeat(queries, count)
            edges = np.arange(len(queries)) + np.repeat(start - (np.cumsum(count) - count), count)
            roots = self.children[edges]


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of each pair; a class is labelled by its smallest index."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _link(prints: np.ndarray, group: np.ndarray, in_tree: np.ndarray, asks: np.ndarray, radius: int):
    """Links from each print to the first of its class, in every group."""
    nodes, queries = np.flatnonzero(in_tree), np.flatnonzero(asks)
    label = np.arange(len(prints))
    if len(nodes) and len(queries):
        forest = Forest(prints, group, nodes)
        queries = queries[forest.root[group[queries]] >= 0]
        size = np.bincount(group[nodes], minlength=group[-1] + 1)[group[queries]]
        block = np.cumsum(size) // PAIRS
        for part in np.split(queries, np.flatnonzero(np.diff(block)) + 1):
            for a, b in forest.search(part, forest.root[group[part]], radius):
                merge(label, a, b)
    linked = label != np.arange(len(prints))
    return prints[label[linked]], prints[linked]


def links(prints: DataFrame, radius=RADIUS, pieces=PIECES, largest=LARGEST) -> DataFrame:
    """From distinct `fingerprint` (long) to links a, b that connect all within the radius."""
    bounds = [round(i * 64 / pieces) for i in range(pieces + 1)]
    runs = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(bounds, bounds[1:])]
    masks = [sum(chosen) for chosen in combinations(runs, pieces - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    shards = F.explode(F.array(*(
        F.struct(F.lit(i).alias("t"), F.col("fingerprint").bitwiseAND(F.lit(m).cast("long")).alias("k")) for i, m in enumerate(signed)
    )))
    keyed = prints.select("fingerprint", shards.alias("s")).select("fingerprint", "s.t", "s.k")
    counted = keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n"))
    useful = counted.filter("n > 1").withColumn("parts", F.ceil(F.col("n") / largest))
    own = F.pmod(F.xxhash64("fingerprint"), F.col("parts"))
    paired = keyed.join(useful, ["t", "k"]).withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)),
    )
    placed = paired.select(
        "t", "k", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "fingerprint",
    )
    dealt = placed.repartition("t", "k", "lo", "hi").sortWithinPartitions("t", "k", "lo", "hi")

    def run(batches):
        # Whole groups only: the last group of a batch waits for its other rows.
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            held = table
            if table.num_rows < BATCH:
                continue
            cuts = np.flatnonzero(_starts(table))
            if cuts[-1]:
                yield from found(table.slice(0, int(cuts[-1])))
                held = table.slice(int(cuts[-1]))
        if held is not None and held.num_rows:
            yield from found(held)

    def _starts(table):
        new = np.ones(table.num_rows, bool)
        new[1:] = False
        for c in ("t", "k", "lo", "hi"):
            values = table.column(c).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return new

    def found(table):
        group = np.cumsum(_starts(table)) - 1
        own, lo, hi = (table.column(c).to_numpy() for c in ("own", "lo", "hi"))
        values = table.column("fingerprint").to_numpy().view(np.uint64)
        a, b = _link(values, group, own == lo, own == hi, radius)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def classes(prints: DataFrame, radius=RADIUS, pieces=PIECES, largest=LARGEST) -> DataFrame:
    """Add component_id, the smallest doc_id reachable, to stored rows as from `fingerprints`."""
    nodes = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "nodes")
    found = stored(links(nodes, radius, pieces, largest).distinct(), "links")
    roots = components(found).withColumnRenamed("node", "fingerprint")
    joined = nodes.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    joined = stored(joined, "roots")
    named = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(joined.select("fingerprint", "root").join(named, "root"), "fingerprint")


def one_of_each(docs: DataFrame, radius=RADIUS) -> DataFrame:
    """Keep the document with the smallest doc_id of each component; the columns stay.

    Where no id or one id occurs several times, the smallest text hash decides;
    of rows equal in id and text one is kept.
    """
    prints = stored(fingerprints(docs), "prints")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_id"))
    keepers = classes(prints, radius).groupBy("root").agg(best["text_id"].alias("text_id")).select("text_id")
    named = docs.withColumn("_text_id", _text_id()).join(keepers.withColumnRenamed("text_id", "_text_id"), "_text_id")
    return named.dropDuplicates(["_text_id"]).select(*docs.columns)
