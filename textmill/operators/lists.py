"""Approximate nearest neighbours from inverted lists, of which a query reads only its own.

Centroids are trained on a bounded sample; every vector belongs to the list of its
nearest centroid, and a list is a partition of the table. A query asks the lists whose
centroids are nearest to it. Those of all queries are at most as many numbers as there
are lists; they become a literal filter on the partition column, so the scan opens no
other folder. How many lists a query needs is measured when the table is written: the
exact neighbours of a sample of its rows say in which lists neighbours are.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill import schemas
from textmill.operators.embedding import HASH_DIM
from textmill.operators.search import QUERY_BLOCK, VECTOR_BLOCK, _checked, _meet, _packed, _unit, top_k_batch
from textmill.session import new_folder

# Rows that centroids are trained on, per list, and lists at most: what the driver holds is
# their product with the width of a vector.
ROWS_PER_LIST, MOST_LISTS = 64, 65_536
# Rows whose exact neighbours say how many lists to ask, and the recall wanted of them.
ASKED, RECALL = 200, 0.95


@dataclass(frozen=True)
class Lists:
    """A table of lists: its rows, the unit centroids, rows per list, and how many lists a query asks."""

    rows: DataFrame
    centroids: np.ndarray
    sizes: np.ndarray
    probes: int


def hashed_sample(rows: DataFrame, size: int, by: str) -> DataFrame:
    """About `size` rows with the smallest hashes of `by`, at most `size`; the same ones every time.

    A bound on the hash leaves little more than `size` rows before they are ranked.
    """
    share = min(1.0, (1.25 * size + 50) / max(1, rows.count()))
    bound = min((1 << 63) - 1, int(-(1 << 63) + share * (1 << 64)))
    hashed = rows.withColumn("_hash", F.xxhash64(by)).filter(F.col("_hash") <= bound)
    return hashed.orderBy("_hash", by).limit(size).drop("_hash")


def _usable(vectors: DataFrame) -> DataFrame:
    """Vectors that have a direction."""
    return vectors.filter(F.exists("embedding", lambda x: x != 0))


def train(vectors: DataFrame, lists: int, vector_id: str = "id", seed: int = 0) -> np.ndarray:
    """At most `lists` unit centroids from at most `lists * ROWS_PER_LIST` rows, the nearer rows the nearer centroids."""
    if not 1 <= lists <= MOST_LISTS:
        raise ValueError(f"{lists} lists, expected 1 to {MOST_LISTS}")
    sample = hashed_sample(_usable(vectors).select(vector_id, "embedding"), lists * ROWS_PER_LIST, vector_id)
    points = sample.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    if points.isEmpty():
        return np.zeros((0, 0))
    model = KMeans(k=lists, distanceMeasure="cosine", maxIter=15, seed=seed).fit(points) if lists > 1 else None
    if model is None:
        width = points.first()["features"].size
        return _unit(np.ones((1, width)))
    return _unit(np.array(model.clusterCenters()))


def with_list(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Add list_id, the nearest centroid. A vector without direction is in list 0; null vectors are left out."""
    dim = centroids.shape[1]

    @F.arrow_udf("int")
    def nearest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            near = np.nan_to_num(_checked(batch, dim)) @ centroids.T
            yield pa.array(near.argmax(axis=1).astype(np.int32))

    return vectors.filter("embedding is not null").withColumn("list_id", nearest("embedding"))


def write_lists(vectors: DataFrame, path: str, lists: int, vector_id: str = "id", k: int = schemas.TOP_K,
                recall: float = RECALL, seed: int = 0) -> None:
    """Train, assign and measure, and write the table: `rows` by list, `centroids`, and `probes`.

    Ranges of (list, id) keep the files few, and split a list that holds much of the table.
    """
    spark = vectors.sparkSession
    centroids = train(vectors, lists, vector_id, seed)
    if not len(centroids):
        raise ValueError("no vector has a direction")
    assigned = with_list(vectors, centroids).repartitionByRange("list_id", vector_id)
    assigned.write.mode("overwrite").partitionBy("list_id").parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    sizes = dict(rows.groupBy("list_id").count().collect())
    places = [(i, sizes.get(i, 0), [float(x) for x in c]) for i, c in enumerate(centroids)]
    made = spark.createDataFrame(places, "list_id int, n_rows long, centroid array<double>")
    made.coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    asked = probes_for(rows, centroids, vector_id, k, recall)
    spark.createDataFrame([(asked,)], "probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/probes")


def probes_for(rows: DataFrame, centroids: np.ndarray, vector_id: str, k: int, recall: float) -> int:
    """How many lists a query has to ask so that `recall` of the k nearest are found.

    Measured on `ASKED` rows of the table: each is asked for its k nearest others, exactly,
    and each of those counts at the place its list has in the order of the row's lists.
    """
    dim = centroids.shape[1]
    asked = hashed_sample(_usable(rows).select(F.col(vector_id).alias("query_id"), "embedding"), ASKED, "query_id")
    vectors = {r.query_id: r.embedding for r in asked.collect()}
    near = top_k_batch(rows, asked, k + 1, dim, vector_id).filter(F.col("query_id") != F.col(vector_id))
    homes = near.filter(F.col("rank") <= k + 1).join(rows.select(vector_id, "list_id"), vector_id)
    found = homes.select("query_id", "list_id").collect()
    if not found:
        return 1
    place = {}
    for query_id, vector in vectors.items():
        order = np.argsort(-(centroids @ np.array(vector, float)), kind="stable")
        place[query_id] = np.argsort(order)
    needed = np.sort([place[row.query_id][row.list_id] for row in found]) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])


def read_lists(spark: SparkSession, path: str) -> Lists:
    """Open a table as written by `write_lists`. The centroids come to the driver."""
    places = spark.read.parquet(f"{path}/centroids").orderBy("list_id").collect()
    return Lists(
        spark.read.parquet(f"{path}/rows"), np.array([p.centroid for p in places]),
        np.array([p.n_rows for p in places]), spark.read.parquet(f"{path}/probes").first().probes)


def _routed(queries: DataFrame, index: Lists, probes: int, query_id: str) -> DataFrame:
    """query_id, embedding, and the lists to ask, nearest centroid first; written once."""
    centroids, dim = index.centroids, index.centroids.shape[1]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.nan_to_num(_checked(batch.column("embedding"), dim)) @ centroids.T
            lists = np.argsort(-near, axis=1, kind="stable")[:, :probes].astype(np.int32)
            offsets = np.arange(len(lists) + 1, dtype=np.int32) * lists.shape[1]
            asked = pa.ListArray.from_arrays(pa.array(offsets), pa.array(lists.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(query_id), batch.column("embedding"), asked],
                                             [query_id, "embedding", "lists"])

    schema = T.StructType([queries.schema[query_id], queries.schema["embedding"], T.StructField("lists", T.ArrayType(T.IntegerType()))])
    folder = new_folder(queries.sparkSession, "routed")
    queries.filter("embedding is not null").select(query_id, "embedding").mapInArrow(route, schema).write.parquet(folder)
    return queries.sparkSession.read.schema(schema).parquet(folder)


def top_k_lists(index: Lists, queries: DataFrame, k: int = schemas.TOP_K, probes: int | None = None,
                vector_id: str = "id", query_id: str = "query_id") -> DataFrame:
    """As `top_k_batch`, from the lists nearest to each query: `probes`, or as many as were measured.

    With as many probes as lists it is exact.
    """
    count = len(index.centroids)
    routed = _routed(queries, index, max(1, min(count, probes or index.probes)), query_id)
    asked = [row.list_id for row in routed.select(F.explode("lists").alias("list_id")).distinct().collect()]
    rows = index.rows.filter(F.col("list_id").isin(sorted(asked)))
    by_list = routed.select(F.explode("lists").alias("list_id"), query_id, "embedding")
    dim = index.centroids.shape[1]
    return _meet(
        _packed(rows, vector_id, dim, VECTOR_BLOCK, by="list_id"), _packed(by_list, query_id, dim, QUERY_BLOCK, by="list_id"),
        k, dim, queries.schema[query_id], index.rows.schema[vector_id])


def share_read(index: Lists, queries: DataFrame, probes: int | None = None, query_id: str = "query_id") -> DataFrame:
    """query_id and the share of the rows that are in the lists it asks."""
    routed = _routed(queries, index, max(1, min(len(index.centroids), probes or index.probes)), query_id)
    sizes = F.lit([int(n) for n in index.sizes])
    total = max(1, int(index.sizes.sum()))
    read = F.aggregate("lists", F.lit(0).cast("long"), lambda n, i: n + F.get(sizes, i))
    return routed.select(query_id, (read / total).alias("share"))
