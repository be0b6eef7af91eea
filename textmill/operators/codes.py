"""Exact nearest vectors through 8-bit codes.

A unit vector x is written as a scale s and whole numbers c from -127 to 127, together with
the length of the error x - s c. For a unit query q the error of s (q c) is at most that length
(Cauchy-Schwarz), so the codes alone bound every distance from both sides. The first pass reads
only the codes, n + 24 bytes for n numbers instead of 4 n, and keeps the rows whose lower bound is
not above the k-th smallest upper bound of the query. Exact distances are computed for those.

Bounds also allow for the 32-bit products of the first pass and for the rounding of distances, so
the answer is that of `top_k_batch`, ties included. Of equal vectors, told by a digest of 128 bits,
a block gives at most k to a query, those of the smallest ids. A vector or a query without direction has no
distance; such rows come last, by id, as there. Null vectors take no part.
"""

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill import schemas
from textmill.functions.vectors import RANK_PLACES
from textmill.operators.embedding import HASH_DIM
from textmill.operators.search import QUERY_BLOCK, VECTOR_BLOCK, _checked, _names, _packed, _ranked, in_rounds
from textmill.session import new_folder

LEVELS = 127
COLUMNS = ("codes", "scale", "error", "digests")


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """codes, scales and error lengths of unit vectors; the error of one without direction is NaN."""
    known = np.nan_to_num(unit)
    scale = (np.abs(known).max(axis=1, initial=0) / LEVELS).astype(np.float32)
    scale[scale == 0] = 1
    wide = scale.astype(np.float64)[:, None]
    codes = np.clip(np.rint(known / wide), -LEVELS, LEVELS).astype(np.int8)
    error = np.linalg.norm(unit - codes * wide, axis=1).astype(np.float32)
    return codes, scale, np.nextafter(error, np.float32(np.inf))


def bounds(wanted: np.ndarray, codes: np.ndarray, scale: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the rounded distances of queries (rows) and vectors; infinite where there is none."""
    about = 1.0 - (wanted.astype(np.float32) @ codes.astype(np.float32).T).astype(np.float64) * scale
    # Of two unit vectors: n products and sums of 32 bits, with a factor of two to spare.
    slack = error + (codes.shape[1] + 4) * 2.0**-22 + 10.0**-RANK_PLACES
    return (np.nan_to_num(x, nan=np.inf, posinf=np.inf) for x in (about - slack, about + slack))


def encoded(vectors: DataFrame, vector_id: str = "id", dim: int = HASH_DIM) -> DataFrame:
    """Blocks of ids, codes, scales, errors and digests. Store them beside the vectors; a new batch is appended."""
    id_type = vectors.schema[vector_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                unit = np.frombuffer(batch.column("matrix")[i].as_py()).reshape(-1, dim)
                digests = b"".join(hashlib.blake2b(row.tobytes(), digest_size=16).digest() for row in unit)
                parts = [pa.array([x], pa.binary()) for x in (*(x.tobytes() for x in encode(unit)), digests)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("slot").slice(i, 1), batch.column("ids").slice(i, 1), *parts],
                    ["slot", "ids", *COLUMNS])

    return _packed(vectors, vector_id, dim, VECTOR_BLOCK).mapInArrow(run, T.StructType([
        T.StructField("slot", T.IntegerType()), T.StructField("ids", T.ArrayType(id_type)),
        *(T.StructField(name, T.BinaryType()) for name in COLUMNS),
    ]))


def _place_among_equals(names: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """For each row, how many rows of a smaller id have the same digest."""
    order = np.lexsort((names, digests["b"], digests["a"]))
    new = np.ones(len(order), bool)
    new[1:] = digests[order[1:]] != digests[order[:-1]]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    return place


def _bounded(codes: DataFrame, queries: DataFrame, k: int, dim: int, query: T.StructField, vector: T.StructField) -> DataFrame:
    """Rows that may be among the k nearest, as far as the task that saw them knows."""
    asked = queries.select("slot", F.col("ids").alias("asked"), F.col("matrix").alias("wanted"))
    pairs = codes.join(asked, "slot").drop("slot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits: dict = {}
        for batch in batches:
            for i in range(batch.num_rows):
                own, asked = batch.column("ids")[i].values, batch.column("asked")[i].values
                block, scale, error, wanted = (
                    np.frombuffer(batch.column(name)[i].as_py(), kind)
                    for name, kind in (("codes", np.int8), ("scale", np.float32), ("error", np.float32), ("wanted", np.float64)))
                digests = np.frombuffer(batch.column("digests")[i].as_py(), [("a", np.uint64), ("b", np.uint64)])
                place = _place_among_equals(_names(own), digests)
                lower, upper = bounds(wanted.reshape(-1, dim), block.reshape(-1, dim), scale, error)
                kth = np.partition(upper, k - 1, axis=1)[:, k - 1] if len(own) >= k else np.full(len(upper), np.inf)
                whose, which = [], []
                for q, name in enumerate(asked.to_pylist()):
                    limit = limits[name] = min(limits.get(name, np.inf), kth[q])
                    near = np.flatnonzero((lower[q] <= limit) & (lower[q] < np.inf) & (place < k))
                    if limit == np.inf:
                        lost = np.flatnonzero(lower[q] == np.inf)
                        near = np.concatenate([near, lost[np.argsort(_names(own)[lost], kind="stable")[:k]]])
                    whose.append(np.full(len(near), q))
                    which.append(near)
                whose, which = np.concatenate(whose), np.concatenate(which)
                yield pa.RecordBatch.from_arrays(
                    [asked.take(pa.array(whose)), own.take(pa.array(which)),
                     pa.array(lower[whose, which]), pa.array(upper[whose, which])],
                    [query.name, vector.name, "lower", "upper"])

    return pairs.mapInArrow(run, T.StructType([
        query, vector, T.StructField("lower", T.DoubleType()), T.StructField("upper", T.DoubleType())]))


def candidates(codes: DataFrame, queries: DataFrame, k: int = schemas.TOP_K, dim: int = HASH_DIM,
               vector_id: str = "id", query_id: str = "query_id") -> DataFrame:
    """(query id, vector id) of all rows that the codes do not rule out; the k nearest are among them."""
    query = queries.schema[query_id]
    vector = T.StructField(vector_id, codes.schema["ids"].dataType.elementType)
    rounds = in_rounds(_packed(queries, query_id, dim, QUERY_BLOCK))
    found = reduce(DataFrame.unionByName, [_bounded(codes, F.broadcast(some), k, dim, query, vector) for some in rounds])
    folder = new_folder(found.sparkSession, "bounded")
    found.write.parquet(folder)
    found = found.sparkSession.read.schema(found.schema).parquet(folder)
    # Tasks send k rows of a query, so the limit of a query does not need all that is left for it in one place.
    nth = F.row_number().over(Window.partitionBy(query_id).orderBy("upper"))
    lowest = found.withColumn("nth", nth).filter(F.col("nth") <= k).groupBy(query_id)
    limits = lowest.agg(F.when(F.count(F.lit(1)) == k, F.max("upper")).otherwise(F.lit(float("inf"))).alias("limit"))
    return found.join(limits, query_id).filter("lower <= limit").select(query_id, vector_id).dropDuplicates()


def top_k_codes(codes: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = schemas.TOP_K, dim: int = HASH_DIM,
                vector_id: str = "id", query_id: str = "query_id") -> DataFrame:
    """(query id, rank, vector id, distance) as from `top_k_batch`; `codes` is the table of `encoded(vectors)`."""
    query, vector = queries.schema[query_id], vectors.schema[vector_id]
    near = candidates(codes, queries, k, dim, vector_id, query_id)
    rows = vectors.filter("embedding is not null").select(vector_id, F.col("embedding").alias("own"))
    asked = queries.filter("embedding is not null").select(query_id, F.col("embedding").alias("wanted"))
    pairs = near.join(rows, vector_id).join(asked, query_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dots = np.einsum("ij,ij->i", *(_checked(batch.column(name), dim) for name in ("own", "wanted")))
            yield pa.RecordBatch.from_arrays(
                [batch.column(query.name), batch.column(vector.name), pa.array(np.round(1.0 - dots, RANK_PLACES))],
                [query.name, vector.name, "distance"])

    exact = pairs.mapInArrow(run, T.StructType([query, vector, T.StructField("distance", T.DoubleType())]))
    return _ranked(exact, k, query, vector)
