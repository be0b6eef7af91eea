"""The vector table: a parquet folder, appended to batch by batch.

A row's id follows from its URL, position and content. A batch of a run owns the folder
`run=<id>/batch_id=<n>`, so writing a batch again replaces it, and nothing else; other
runs only add. Below it a folder per outcome
keeps errors apart from vectors without a second pass over the texts.
"""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill import schemas
from textmill.functions.metadata import metadata_value
from textmill.functions.text import preview
from textmill.sources import compaction
from textmill.sources.compaction import open_table
from textmill.sources.files import folder_exists

_TABLE = T.StructType([
    *schemas.VECTOR_ROW, T.StructField("run", T.StringType()), T.StructField("batch_id", T.LongType()),
])


def row_id(url: Column, chunk_no: Column, content: Column) -> Column:
    content_hash = F.sha2(content, 256)
    return F.sha2(F.concat_ws("\n", url, chunk_no.cast("string"), content_hash), 256)


def new_run() -> str:
    return uuid.uuid4().hex


def append_rows(rows: DataFrame, path: str, run: str, batch_id: int = 0) -> None:
    """Write all rows of a batch in one pass, whatever became of them.

    `run` names the job that appends; only a repetition of the same job gives it again.
    """
    have = set(rows.columns)
    columns = [
        F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schemas.VECTOR_ROW
    ]
    batch = rows.select(*columns).write.mode("overwrite").partitionBy("outcome")
    batch.parquet(f"{path}/run={run}/batch_id={batch_id}")


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the table, whatever became of them."""
    return open_table(spark, path, _TABLE)


def compact(spark: SparkSession, path: str, **options) -> int | None:
    """Rewrite settled batches in the order that searches by number can skip; see `compaction`."""
    return compaction.compact(spark, path, _TABLE, **options)


def read_batch(spark: SparkSession, path: str, run: str, batch_id: int) -> DataFrame:
    """The rows of one batch; no other folder is listed or opened while the batch has its own."""
    if not folder_exists(spark, f"{path}/run={run}/batch_id={batch_id}"):
        return read_rows(spark, path).filter((F.col("run") == run) & (F.col("batch_id") == batch_id))
    return spark.read.schema(_TABLE).option("basePath", path).parquet(f"{path}/run={run}/batch_id={batch_id}")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows; only their folders are read."""
    stored = read_rows(spark, path).filter(F.col("outcome") == schemas.STORED)
    return stored.drop("error", "dropped_words", "outcome", "run", "batch_id")


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    """Refused chunks and missing files, with the reason."""
    failed = read_rows(spark, path).filter(F.col("outcome").isin(schemas.REJECTED, schemas.FAILED, schemas.MISSING))
    return failed.select("url", "chunk_no", "document_type", "refnum1", "refnum2", "error", "run", "batch_id")


def write_index(rows: DataFrame, path: str, vector_id: str = "id") -> None:
    """The table for approximate search, partitioned by bucket.

    Ranges of (bucket, id) keep the files few, and split a bucket that holds much of the table.
    """
    ranged = rows.repartitionByRange("bucket", vector_id)
    ranged.write.mode("overwrite").partitionBy("bucket").parquet(path)


def list_stored(rows: DataFrame, limit: int = schemas.LIST_LIMIT) -> DataFrame:
    """The first rows by id with their metadata values and a preview.

    Texts are shortened before they are sorted, metadata is read of the rows listed only.
    """
    short = rows.select("id", "metadata", preview(F.col("content")).alias("preview"))
    listed = short.orderBy("id").limit(limit)
    return listed.select(
        "id",
        *[metadata_value(F.col("metadata"), key).alias(key) for key in ("refnum1", "refnum2", "timestamp")],
        "preview",
    )


def stored_count(rows: DataFrame, limit: int = schemas.LIST_LIMIT) -> DataFrame:
    """How many rows the listing shows, of how many, and the notice if there are none."""
    return rows.agg(F.count("*").alias("n_stored")).select(
        "n_stored",
        F.least("n_stored", F.lit(limit).cast("bigint")).alias("n_listed"),
        F.when(F.col("n_stored") == 0, "nothing stored").alias("notice"),
    )
