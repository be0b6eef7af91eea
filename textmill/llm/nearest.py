"""Exact top-k by inner product through a pivot-distance index.

Components are turned into integers, floor(256 x). A few pivots are fitted on a
bounded sample by farthest-first choice; every vector is keyed by its nearest
pivot and its distance to it, and the distances of a pivot are cut into rings, so
a cell is an annulus. The index is one row per block of at most `BLOCK` vectors
of a cell, sorted by distance; a summary has one row per cell, at most
PIVOTS * (RINGS + 1), whatever the number of vectors.

For a query the triangle inequality bounds how near any vector of an annulus can
be, and with the longest vector of the cell that bounds the inner product. A
query first visits the cells with the highest bounds that hold k + 1 vectors
together; the k-th best score there is its threshold. Then it expands to those
other annuli whose bound is not below the threshold, and stops. Scores are exact
integers, so the result equals that of a full search.

Whole components are kept as doubles, which hold floor(256 x) exactly whatever
its size. Products that doubles do not hold exactly are worked out in whole
numbers without a limit; only an answer that leaves 64 bits is an error.

Edge cases: vectors that are null or hold null, NaN or infinite components take
no part, nor do rows without an id. Vectors of different widths only meet
vectors of their own width. Equal scores go to the smaller id, equal ids count
as rows of their own. A query with fewer than k candidates gets them all. Every
query row is answered, also where ids repeat or rows are equal in full; no query
finds rows of its own id. Empty vectors take no part, and empty tables give no
rows. Extra columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hashed_sample, stored

SCALE = 256
PIVOTS, RINGS, SAMPLE = 16, 12, 4096
# Vectors of a block, and queries that meet a block at once.
BLOCK, QUERIES = 4096, 256

INDEX = "dim int, pivot int, ring int, vec_ids binary, vectors binary, low double, high double, longest double, n long"


def integers(table: DataFrame, id_column="vec_id", vector="embedding") -> DataFrame:
    """vec_id, v (whole numbers, as doubles) and dim of the rows that take part."""
    def whole(c):
        # A double of 2^53 or more is whole; one so large that 256 times it is infinite stays as it is, and scores leave 64 bits.
        scaled = c.cast("double") * SCALE
        return F.when(F.abs(scaled) < 2.0**53, F.floor(scaled).cast("double")).when(F.abs(scaled) < float("inf"), scaled).otherwise(c.cast("double"))

    usable = F.col(id_column).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(
        vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")),
    )
    return table.filter(usable).select(
        F.col(id_column).cast("long").alias("vec_id"), F.transform(vector, whole).alias("v"), F.size(vector).alias("dim"),
    )


def _norms(rows: np.ndarray) -> np.ndarray:
    """Lengths of rows; one beyond the largest double is that."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nan_to_num(np.linalg.norm(rows, axis=-1), nan=np.finfo(float).max)


def fit_pivots(vectors: DataFrame, pivots=PIVOTS, sample=SAMPLE) -> dict[int, np.ndarray]:
    """Pivots by width, farthest first among at most `sample` vectors chosen by a hash."""
    rows = hashed_sample(vectors, sample, "vec_id", "v").collect()
    found = {}
    for dim in {row.dim for row in rows}:
        points = np.array([row.v for row in rows if row.dim == dim], np.float64)
        chosen = [0]
        distance = _norms(points - points[0])
        while len(chosen) < min(pivots, len(points)) and distance.max() > 0:
            chosen.append(int(distance.argmax()))
            distance = np.minimum(distance, _norms(points - points[chosen[-1]]))
        found[dim] = points[chosen]
    return found


def _keyed(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Add pivot, distance and length. A width outside the sample has the origin as its pivot."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            flat = batch.column("v").flatten().to_numpy().astype(np.float64)
            starts = np.concatenate([[0], np.cumsum(dims)])
            pivot, distance, length = np.zeros(len(dims), np.int32), np.zeros(len(dims)), np.zeros(len(dims))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = flat[starts[at][:, None] + np.arange(dim)]
                p = shared.value.get(int(dim), np.zeros((1, dim)))
                d = np.stack([_norms(x - row) for row in p])
                pivot[at], distance[at], length[at] = d.argmin(axis=0), d.min(axis=0), _norms(x)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pivot), pa.array(distance), pa.array(length)],
                [*batch.schema.names, "pivot", "distance", "length"],
            )

    return vectors.mapInArrow(run, "vec_id long, v array<double>, dim int, pivot int, distance double, length double")


def build(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """The index: blocks of the vectors of a cell. Store it before use."""
    keyed = stored(_keyed(vectors, pivots), "keyed")
    widest = keyed.groupBy("dim").agg(F.greatest(F.max("distance"), F.lit(1e-9)).alias("_far"))
    # One row per width of vectors; cells stay few because rings are counted, not measured.
    ringed = keyed.join(widest, "dim").withColumn("ring", F.floor(F.col("distance") / F.col("_far") * RINGS).cast("int")).drop("_far")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("dim", "pivot", "ring", "distance", "vec_id")
    sorted_ = ringed.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches):
        for batch in batches:
            cell = np.stack([batch.column(c).to_numpy() for c in ("dim", "pivot", "ring")], 1)
            ids, distance, length = (batch.column(c).to_numpy() for c in ("vec_id", "distance", "length"))
            dims = cell[:, 0]
            flat = batch.column("v").flatten().to_numpy()
            starts = np.concatenate([[0], np.cumsum(dims)])
            cuts = [0, *(np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1), len(cell)]
            rows = []
            for lo, hi in zip(cuts, cuts[1:]):
                for a in range(lo, hi, BLOCK):
                    b = min(hi, a + BLOCK)
                    rows.append((
                        *map(int, cell[a]), ids[a:b].tobytes(), flat[starts[a]:starts[b]].tobytes(),
                        float(distance[a]), float(distance[b - 1]), float(length[a:b].max()), b - a,
                    ))
            names = ["dim", "pivot", "ring", "vec_ids", "vectors", "low", "high", "longest", "n"]
            types = [pa.int32()] * 3 + [pa.binary()] * 2 + [pa.float64()] * 3 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 9, types)], names)

    return sorted_.mapInArrow(run, INDEX)


def search(queries: DataFrame, index: DataFrame, pivots: dict[int, np.ndarray], k=5) -> DataFrame:
    """query_id, rank, vec_id, score of the k best per query.

    `queries` is as from `integers`; a query never finds rows of its own id.
    Equal queries are asked once and answered as often as they are there. `index`
    is stored.
    """
    # Written, so that the numbers of the queries stay what they are.
    queries = stored(queries.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("times")).withColumn("q", F.monotonically_increasing_id()), "queries")
    packs = max(1, -(-queries.count() // QUERIES))
    cells = index.groupBy("dim", "pivot", "ring").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.max("longest").alias("longest"), F.sum("n").alias("n"),
    ).collect()  # at most PIVOTS * (RINGS + 1) rows for a width of vectors
    by_dim: dict[int, list] = {}
    for c in cells:
        by_dim.setdefault(c.dim, []).append((c.pivot, c.ring, c.low, c.high, c.longest, c.n))
    shared = queries.sparkSession.sparkContext.broadcast((pivots, by_dim))

    def bounds(v: np.ndarray, dim: int):
        """Cells of the width, and the highest score any of their vectors can have with v."""
        own, known = shared.value
        rows = known.get(dim, [])
        pivot, ring, low, high, longest, n = (np.array(c, float) for c in zip(*rows)) if rows else [np.empty(0)] * 6
        centre = own.get(dim, np.zeros((1, dim)))
        d = _norms(centre - v)[pivot.astype(int)]
        # Distances carry rounding errors; a little slack keeps the bound a bound.
        gap = np.maximum(0.0, np.maximum(low - d, d - high) * (1 - 1e-9) - 1e-6)
        with np.errstate(over="ignore", invalid="ignore"):
            length = float(v @ v)
            bound = np.minimum((length + longest**2 - gap**2) / 2, np.sqrt(length) * longest)
            # Sums of squares carry errors of their own size; what is beyond doubles bounds nothing.
            bound = bound + 1e-9 * (np.abs(bound) + length + longest**2) + 1e-3
        return pivot.astype(int), ring.astype(int), n, np.where(np.isfinite(bound), bound, np.inf)

    def choose(first):
        def run(batches):
            for batch in batches:
                out = []
                for i in range(batch.num_rows):
                    q, query_id = batch.column("q")[i].as_py(), batch.column("vec_id")[i].as_py()
                    v = np.array(batch.column("v")[i].as_py(), np.float64)
                    pivot, ring, n, bound = bounds(v, len(v))
                    order = np.argsort(-bound, kind="stable")
                    # The fewest best cells that surely hold k others besides the query's own row.
                    home = order[:int(np.searchsorted(np.cumsum(n[order]), k + 1)) + 1]
                    if first:
                        chosen, least = home, None
                    else:
                        least = batch.column("least")[i].as_py()
                        away = np.ones(len(bound), bool)
                        away[home] = False
                        chosen = np.flatnonzero(away & (bound >= (-np.inf if least is None else least)))
                    out += [(q, query_id, v.tobytes(), len(v), int(pivot[c]), int(ring[c]), least) for c in chosen]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(
                        zip(*out) if out else [[]] * 7, (pa.int64(), pa.int64(), pa.binary(), *[pa.int32()] * 3, pa.int64()))],
                    ["q", "query_id", "v", "dim", "pivot", "ring", "least"],
                )
        return run

    routed = "q long, query_id long, v binary, dim int, pivot int, ring int, least long"
    asked = queries.select("q", "vec_id", "v")
    near = stored(_visit(asked.mapInArrow(choose(True), routed), index, k, packs), "near")
    least = near.withColumn("r", F.row_number().over(_best())).filter((F.col("r") == k) & (F.col("beyond") >= 0)).select(
        "q", F.col("score").alias("least"))
    far = _visit(asked.join(least, "q", "left").mapInArrow(choose(False), routed), index, k, packs)
    ranked = near.unionByName(far).withColumn("rank", F.row_number().over(_best())).filter(F.col("rank") <= k)
    named = ranked.join(queries.select("q", F.col("vec_id").alias("query_id"), "times"), "q")
    each = F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))
    wide = F.raise_error(F.concat(F.lit("a score of query "), F.col("query_id"), F.lit(" leaves 64 bits"))).cast("long")
    score = F.when(F.col("beyond") == 0, F.col("score")).otherwise(wide)
    return named.select("query_id", "rank", "vec_id", score.alias("score"), each.alias("_copy")).drop("_copy")


def _best():
    return Window.partitionBy("q").orderBy(F.desc("beyond"), F.desc("score"), "vec_id")


def _visit(routed: DataFrame, index: DataFrame, k: int, packs: int) -> DataFrame:
    """q, vec_id, score and beyond: the k best of every block that a query visits, at least its threshold.

    A score that leaves 64 bits is cut to them, and `beyond` says on which side.

    Queries that visit a cell are packed, so a block meets many of them in one product.
    """
    cell = ["dim", "pivot", "ring"]
    salted = routed.withColumn("_pack", F.pmod(F.xxhash64("q"), F.lit(packs)))
    packed = salted.groupBy(*cell, "_pack").agg(F.collect_list(F.struct("q", "query_id", "v", "least")).alias("asked"))
    pairs = index.join(packed.drop("_pack"), cell).select("dim", "vec_ids", "vectors", "asked")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column("dim")[i].as_py()
                ids = np.frombuffer(batch.column("vec_ids")[i].as_py(), np.int64)
                vectors = np.frombuffer(batch.column("vectors")[i].as_py(), np.float64).reshape(-1, dim)
                asked = batch.column("asked")[i].as_py()
                for start in range(0, len(asked), QUERIES):
                    yield _best_of(asked[start:start + QUERIES], ids, vectors, dim, k)

    return pairs.mapInArrow(run, "q long, vec_id long, score long, beyond int")


def _products(q: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where these hold every sum below 2^53, else in Python's whole numbers."""
    with np.errstate(over="ignore"):
        if float(np.abs(q).max()) * float(np.abs(vectors).max()) * q.shape[1] < 2**53:
            return (q @ vectors.T).astype(np.int64)
    exact = np.frompyfunc(int, 1, 1)
    return exact(q) @ exact(vectors).T


def _best_of(asked, ids, vectors, dim, k):
    scores = _products(np.frombuffer(b"".join(a["v"] for a in asked), np.float64).reshape(-1, dim), vectors)
    low, high = -(1 << 63), (1 << 63) - 1
    rows = []
    for row, a in zip(scores, asked):
        here = ids != a["query_id"]
        at = np.flatnonzero(here if a["least"] is None else (row >= a["least"]) & here)
        if len(at) > k:
            # Everything above the k-th score, and of its ties the smallest ids.
            kth = np.sort(row[at])[-k] if row.dtype == object else np.partition(row[at], len(at) - k)[len(at) - k]
            at = at[row[at] >= kth]
            at = np.array(sorted(at, key=lambda i: (-int(row[i]), ids[i]))[:k])
        for i in at:
            score = int(row[i])
            rows.append((a["q"], int(ids[i]), min(max(score, low), high), (score > high) - (score < low)))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, kinds)], ["q", "vec_id", "score", "beyond"])


def top_k(table: DataFrame, every=50, k=5) -> DataFrame:
    """Queries are the rows whose id is divisible by `every`; candidates are all rows."""
    vectors = stored(integers(table), "vectors")
    pivots = fit_pivots(vectors)
    index = stored(build(vectors, pivots), "index")
    return search(vectors.filter(F.col("vec_id") % every == 0), index, pivots, k)
