"""Nearest vectors by cosine distance: exact, filtered, in batches, and approximate.

Vectors and queries are packed into blocks, one row each. The query blocks are written
first, so their size is known: they are broadcast, in rounds of `ROUND_BYTES` at most, and
the vectors stay where they are and are read once a round. A search in lists or buckets
joins the blocks by list instead. Neither side passes through the driver.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill import schemas
from textmill.functions.text import not_blank
from textmill.functions.vectors import RANK_PLACES
from textmill.operators.embedding import HASH_DIM, Provider, embed
from textmill.session import new_folder

# Rows of a block; with 1,536 numbers a vector, 12 MB of queries meet 48 MB of vectors.
QUERY_BLOCK, VECTOR_BLOCK = 1024, 4096
# Bytes of packed queries that are broadcast at a time: 130,000 queries of 64 numbers.
ROUND_BYTES = 64 << 20


def _unit(matrix: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _nearest(ids, distances, k):
    """Positions of the k smallest distances; ties go to the smaller id, NaN comes last."""
    near = np.arange(len(ids))
    if len(ids) > k:
        limit = np.partition(distances, k - 1)[k - 1]
        if not np.isnan(limit):
            near = np.flatnonzero(distances <= limit)
    return near[np.lexsort((ids[near], distances[near]))[:k]]


def _names(values: pa.Array) -> np.ndarray:
    found = values.to_numpy(zero_copy_only=False)
    return found.astype(str) if found.dtype == object else found


def _checked(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows of a matrix. One of another width is an error, not a miss."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    widths = np.unique(pc.list_value_length(column).to_numpy(zero_copy_only=False))
    if len(widths) and (len(widths) > 1 or widths[0] != dim):
        raise ValueError(f"vectors of {', '.join(map(str, widths))} numbers, expected {dim}")
    return _unit(flat.reshape(len(column), dim).astype(np.float64))


def _packed(rows: DataFrame, id_column: str, dim: int, size: int, by: str | None = None) -> DataFrame:
    """Blocks `slot, ids, matrix` of unit vectors. The slot is the value of `by`, or 0."""
    id_type = rows.schema[id_column].dataType
    used = rows.filter("embedding is not null").select(id_column, "embedding", *([by] if by else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = batch.column(by).to_numpy() if by else np.zeros(batch.num_rows, np.int64)
            for slot in np.unique(slots):
                some = batch.filter(pa.array(slots == slot))
                for start in range(0, some.num_rows, size):
                    part = some.slice(start, size)
                    matrix = _checked(part.column("embedding"), dim)
                    ids = part.column(id_column)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([int(slot)], pa.int32()),
                        pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                        pa.array([matrix.tobytes()], pa.binary()),
                    ], ["slot", "ids", "matrix"])

    return used.mapInArrow(run, T.StructType([
        T.StructField("slot", T.IntegerType()), T.StructField("ids", T.ArrayType(id_type)),
        T.StructField("matrix", T.BinaryType()),
    ]))


def _meet(vectors: DataFrame, queries: DataFrame, k: int, dim: int, query_id, vector_id) -> DataFrame:
    """The k nearest of the pairs of blocks that share a slot."""
    return _ranked(_found(vectors, queries, k, dim, query_id, vector_id), k, query_id, vector_id)


def _ranked(found: DataFrame, k: int, query_id, vector_id) -> DataFrame:
    best = Window.partitionBy(query_id.name).orderBy("distance", vector_id.name)
    return (
        found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .select(query_id.name, "rank", vector_id.name, "distance")
    )


def _found(vectors: DataFrame, queries: DataFrame, k: int, dim: int, query_id, vector_id) -> DataFrame:
    """What may be among the k nearest, of the pairs of blocks that share a slot.

    A task gives a row only if it is not beyond the k best the task has seen for its query.
    `query_id` and `vector_id` are the fields of the ids.
    """
    asked = queries.select("slot", F.col("ids").alias("asked"), F.col("matrix").alias("wanted"))
    pairs = vectors.join(asked, "slot").select("ids", "matrix", "asked", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        farthest: dict = {}
        for batch in batches:
            for i in range(batch.num_rows):
                own, asked = batch.column("ids")[i].values, batch.column("asked")[i].values
                ids, names = _names(own), asked.to_pylist()
                matrix, wanted = (
                    np.frombuffer(batch.column(c)[i].as_py()).reshape(-1, dim) for c in ("matrix", "wanted"))
                distances = np.round(1.0 - wanted @ matrix.T, RANK_PLACES)
                whose, which, far = [], [], []
                for q, (name, near) in enumerate(zip(names, distances)):
                    limit = farthest.get(name)
                    if limit is not None and np.fmin.reduce(near) > limit:
                        continue
                    best = _nearest(ids, near, k)
                    if len(best) == k and not near[best[-1]] >= (np.inf if limit is None else limit):
                        farthest[name] = near[best[-1]]
                    whose.append(np.full(len(best), q))
                    which.append(best)
                    far.append(near[best])
                if whose:
                    yield pa.RecordBatch.from_arrays(
                        [asked.take(pa.array(np.concatenate(whose))), own.take(pa.array(np.concatenate(which))),
                         pa.array(np.concatenate(far), pa.float64())],
                        [query_id.name, vector_id.name, "distance"])

    return pairs.mapInArrow(run, T.StructType([query_id, vector_id, T.StructField("distance", T.DoubleType())]))


def top_k_batch(
    vectors: DataFrame, queries: DataFrame, k: int = schemas.TOP_K, dim: int = HASH_DIM,
    vector_id: str = "id", query_id: str = "query_id",
) -> DataFrame:
    """(query id, rank, vector id, distance) of the k nearest vectors of every query.

    Null vectors take no part; a vector or query of another width than `dim` is an error.
    """
    query, vector = queries.schema[query_id], vectors.schema[vector_id]
    rows = _packed(vectors, vector_id, dim, VECTOR_BLOCK)
    found = [_found(rows, F.broadcast(some), k, dim, query, vector) for some in in_rounds(_packed(queries, query_id, dim, QUERY_BLOCK))]
    return _ranked(reduce(DataFrame.unionByName, found), k, query, vector)


def in_rounds(blocks: DataFrame, most: int = ROUND_BYTES) -> list[DataFrame]:
    """Query blocks, written once, in parts of at most about `most` bytes, each small enough to be broadcast."""
    spark = blocks.sparkSession
    folder = new_folder(spark, "asked")
    numbered = blocks.withColumn("_nth", F.monotonically_increasing_id())
    numbered.write.parquet(folder)
    written = spark.read.schema(numbered.schema).parquet(folder)
    sizes = written.select("_nth", F.octet_length("matrix").alias("size")).orderBy("_nth").collect()
    rounds, held = [], 0
    for row in sizes:
        if not rounds or held + row.size > most:
            rounds.append([])
            held = 0
        rounds[-1].append(row["_nth"])
        held += row.size
    if len(rounds) < 2:
        return [written.drop("_nth")]
    return [written.filter(F.col("_nth").between(part[0], part[-1])).drop("_nth") for part in rounds]


def top_k(
    vectors: DataFrame, text: str, k: int = schemas.TOP_K, provider: Provider | None = None,
    dim: int = HASH_DIM, vector_id: str = "id", refnum1: int | None = None,
    refnum2: int | None = None,
) -> DataFrame:
    """The k rows nearest to a text. A blank text finds nothing; a text that the provider
    cannot embed is an error.

    A reference number that is given restricts the rows before they are ranked.
    """
    one = vectors.sparkSession.range(0, 1, 1, 1)
    asked = one.select(F.col("id").alias("query_id"), F.lit(text).cast("string").alias("content"))
    made = embed(asked.filter(not_blank(F.col("content"))), provider, dim)
    failed = F.raise_error(F.concat(F.lit("the query could not be embedded: "), F.col("error")))
    queries = made.withColumn("embedding", F.when(F.col("error").isNotNull(), failed.cast("array<float>")).otherwise(F.col("embedding")))
    rows = vectors.filter(refnum_filter(refnum1, refnum2))
    return top_k_batch(rows, queries, k, dim, vector_id).drop("query_id")


def refnum_filter(refnum1: int | None, refnum2: int | None) -> Column:
    wanted = F.lit(True)
    for name, value in (("refnum1", refnum1), ("refnum2", refnum2)):
        if value is not None:
            wanted = wanted & (F.col(name) == value)
    return wanted


def with_rows(found: DataFrame, vectors: DataFrame, vector_id: str, *columns: str) -> DataFrame:
    """Columns of the rows found. The found side is k rows per query, so it is broadcast
    by its measured size, and the scan reads only the columns asked for."""
    return found.join(vectors.select(vector_id, *columns), vector_id)


def find_by_refnums(vectors: DataFrame, refnum1, refnum2, limit, vector_id="id") -> DataFrame:
    return vectors.filter(refnum_filter(refnum1, refnum2)).orderBy(vector_id).limit(limit)


def refnum_statistics(vectors: DataFrame) -> DataFrame:
    """Stored rows per pair of reference numbers."""
    return vectors.groupBy("refnum1", "refnum2").agg(F.count("*").alias("n_rows"))


def refnum_summary(vectors: DataFrame) -> DataFrame:
    """Distinct numbers, range, and rows without numbers, over the few distinct pairs."""
    pairs = refnum_statistics(vectors)
    missing = F.col("refnum1").isNull() & F.col("refnum2").isNull()
    return pairs.agg(
        F.sum("n_rows").alias("n_rows"),
        F.count(F.when(~missing, True)).alias("n_pairs"),
        F.count_distinct("refnum1").alias("n_refnum1"),
        F.count_distinct("refnum2").alias("n_refnum2"),
        F.min("refnum1").alias("min_refnum1"),
        F.max("refnum1").alias("max_refnum1"),
        F.min("refnum2").alias("min_refnum2"),
        F.max("refnum2").alias("max_refnum2"),
        F.coalesce(F.sum(F.when(missing, F.col("n_rows"))), F.lit(0)).alias("n_without"),
    )


# --- approximate search ------------------------------------------------------
# The bucket of a vector is the signs of its products with a few random planes
# (Charikar 2002). A table partitioned by bucket is read only where a query looks.


def planes(bits: int, dim: int, seed: int = 0) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((bits, dim))


def _signs(matrix: np.ndarray, across: np.ndarray) -> np.ndarray:
    return (matrix @ across.T > 0) @ (1 << np.arange(len(across)))


def with_bucket(vectors: DataFrame, bits: int = 8, dim: int = HASH_DIM, seed: int = 0) -> DataFrame:
    """Add the bucket an index table is partitioned by."""
    across = planes(bits, dim, seed)

    @F.arrow_udf("int")
    def bucket_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            flat = batch.flatten().to_numpy(zero_copy_only=False)
            yield pa.array(_signs(flat.reshape(len(batch), dim), across).astype(np.int32))

    rows = vectors.filter("embedding is not null")
    return rows.withColumn("bucket", bucket_of("embedding"))


def approx_top_k(
    index: DataFrame, queries: DataFrame, k: int = schemas.TOP_K, bits: int = 8, share: float = 0.9,
    dim: int = HASH_DIM, seed: int = 0, vector_id: str = "id", query_id: str = "query_id",
) -> DataFrame:
    """As `top_k_batch`, but a query meets only the `share` of the buckets nearest to it.

    Near are buckets on the other side of planes the query is close to (Lv et al. 2007).
    `share = 1` looks everywhere and is exact. The buckets of a query are found in the
    tasks, in the order of their cost, and the folders of no others are opened. Signs
    know nothing of how vectors are spread: `lists` reads less for the same recall.
    """
    if bits > 16:
        raise ValueError(f"{bits} bits, expected at most 16")
    across = planes(bits, dim, seed)
    wanted = max(1, round(share * (1 << bits)))
    kind = queries.schema[query_id]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = _checked(batch.column("embedding"), dim)
            margins = (matrix @ across.T) ** 2
            own = _signs(matrix, across)
            for i in range(len(matrix)):
                flips = _cheapest(margins[i], wanted)
                n = len(flips)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[i] ^ flips, pa.int32()), batch.column(query_id).take(pa.array([i] * n)),
                     batch.column("embedding").take(pa.array([i] * n))],
                    ["bucket", query_id, "embedding"])

    routed = queries.filter("embedding is not null").select(query_id, "embedding").mapInArrow(
        probe, T.StructType([T.StructField("bucket", T.IntegerType()), kind, queries.schema["embedding"]]))
    folder = new_folder(queries.sparkSession, "routed")
    routed.write.parquet(folder)
    routed = queries.sparkSession.read.schema(routed.schema).parquet(folder)
    # At most 2 ** bits numbers, as a literal filter on the partitions of the index.
    buckets = [row.bucket for row in routed.select("bucket").distinct().collect()]
    asked = _packed(routed, query_id, dim, QUERY_BLOCK, by="bucket")
    rows = _packed(index.filter(F.col("bucket").isin(sorted(buckets))), vector_id, dim, VECTOR_BLOCK, by="bucket")
    return _meet(rows, asked, k, dim, kind, index.schema[vector_id])


def _cheapest(margins: np.ndarray, wanted: int) -> np.ndarray:
    """The `wanted` cheapest sets of flipped signs as bit masks, cheapest first.

    Sets grow by one sign at a time, and only the cheapest are kept.
    """
    masks, costs = np.zeros(1, np.int64), np.zeros(1)
    for place, margin in enumerate(margins):
        masks = np.concatenate([masks, masks | (1 << place)])
        costs = np.concatenate([costs, costs + margin])
        keep = np.argsort(costs, kind="stable")[:wanted]
        masks, costs = masks[keep], costs[keep]
    return masks
