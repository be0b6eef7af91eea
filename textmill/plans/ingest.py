"""The two ingest jobs: work messages to chunk vectors, and a folder to file vectors."""

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill import schemas
from textmill.schemas import EMPTY, FAILED, MISSING, REJECTED, STORED
from textmill.functions.metadata import build_metadata, no_metadata
from textmill.functions.refnums import parse_refnums, refnum_error, resolve_refnums
from textmill.functions.text import not_blank
from textmill.functions.urls import document_type, filename_for_refnum
from textmill.operators.chunking import pack_chunks, whole_documents
from textmill.operators.embedding import HASH_DIM, Provider, embed
from textmill.operators.search import top_k
from textmill.sources.files import scan_text_dir
from textmill.sources.messages import work_documents
from textmill.sources.vector_table import append_rows, list_stored, new_run, read_rows, read_vectors, row_id

NOT_FOUND = "content not found"


@cache
def _from_url(defaults: tuple) -> tuple[Column, Column]:
    """Type and numbers. Made once, as are those below: a stream would wait for them at every batch."""
    parsed = parse_refnums(filename_for_refnum(F.col("url")))
    return document_type(F.col("url")), resolve_refnums(parsed, F.col("document_type"), defaults)


@cache
def _of_chunk() -> tuple[Column, Column]:
    """Why its numbers are refused, and its id."""
    refused = refnum_error(F.col("document_type"), F.col("refnum1"), F.col("refnum2"))
    return refused, row_id(F.col("url"), F.col("chunk_no"), F.col("content"))


@cache
def _fate() -> dict[str, Column]:
    outcome = (
        F.when(F.col("_missing"), MISSING)
        .when(F.col("chunk_no").isNull(), EMPTY)
        .when(F.col("_refused").isNotNull(), REJECTED)
        .when(F.col("error").isNotNull(), FAILED)
        .otherwise(STORED)
    )
    return {"error": F.coalesce("_refused", "error", F.when(F.col("_missing"), NOT_FOUND)), "outcome": outcome}


def classified(rows: DataFrame, defaults=schemas.DEFAULT_REFNUMS) -> DataFrame:
    """Add `document_type, refnum1, refnum2`, all from the URL."""
    kind, refnums = _from_url(tuple(defaults))
    return (
        rows.withColumn("document_type", kind)
        .withColumn("_refnums", refnums)
        .withColumns({"refnum1": F.col("_refnums.refnum1"), "refnum2": F.col("_refnums.refnum2")})
        .drop("_refnums")
    )


def _finished(rows: DataFrame, with_metadata: bool, defaults, ingest_ms: Column,
              provider: Provider | None, dim: int, done: DataFrame | None = None) -> DataFrame:
    """Metadata, id, vector and outcome of rows with `url, chunk_no, content`, without the ids in `done`."""
    if with_metadata:
        rows = classified(rows, defaults)
        refnums = F.col("document_type"), F.col("refnum1"), F.col("refnum2")
        refused = _of_chunk()[0]
        metadata = build_metadata(*refnums, F.col("url"), ingest_ms)
    else:
        nothing = F.lit(None)
        rows = rows.withColumns({
            "document_type": nothing.cast("string"),
            "refnum1": nothing.cast("int"), "refnum2": nothing.cast("int"),
        })
        refused, metadata = nothing.cast("string"), no_metadata()
    rows = rows.withColumns({
        "metadata": metadata,
        "_refused": refused,
        "_text": F.when(refused.isNull(), F.col("content")),
        "id": _of_chunk()[1],
    })
    if done is not None:
        rows = rows.join(done, "id", "left_anti")
    made = embed(rows, provider, dim, text="_text")
    return made.withColumns(_fate()).drop("_refused", "_text", "_missing")


def ingest(
    messages: DataFrame, files: DataFrame, *, with_metadata=True,
    defaults=schemas.DEFAULT_REFNUMS, ingest_ms: Column | None = None,
    provider: Provider | None = None, dim=HASH_DIM,
    max_words=schemas.MAX_WORDS, min_words=schemas.MIN_WORDS, overlap_words=0,
    parts: int | None = None, done: DataFrame | None = None,
) -> DataFrame:
    """Messages with a `url` to rows of the vector table, with an `outcome` each.

    Only a `stored` row belongs in the table. A file without content or without any
    chunk still has one row, so that every message can be accounted for. The join is
    the only possible shuffle of the texts. `done` has ids of chunks that an earlier attempt
    has stored; they are not embedded again.
    """
    packed = pack_chunks(
        work_documents(messages, files, parts), max_words=max_words, min_words=min_words, overlap_words=overlap_words
    ).withColumn("_missing", F.col("content").isNull())
    keep = [c for c in packed.columns if c not in ("chunks", "content")]
    chunks = packed.select(*keep, F.posexplode_outer("chunks").alias("chunk_no", "_chunk")).select(
        *keep, "chunk_no", "_chunk.n_words", "_chunk.content"
    )
    return _finished(chunks, with_metadata, defaults, _now_ms(ingest_ms), provider, dim, done)


def ingest_files(
    files: DataFrame, *, with_metadata=True, defaults=schemas.DEFAULT_REFNUMS,
    ingest_ms: Column | None = None, provider: Provider | None = None, dim=HASH_DIM,
    parts: int | None = None,
) -> DataFrame:
    """Files to rows of the vector table, one row per file whatever its length."""
    rows = whole_documents(files.repartition(parts) if parts else files).withColumn("_missing", F.lit(False))
    return _finished(rows, with_metadata, defaults, _now_ms(ingest_ms), provider, dim)


def _now_ms(ingest_ms):
    return F.unix_millis(F.current_timestamp()) if ingest_ms is None else ingest_ms


def stored(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("outcome") == STORED)


def rejected(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("outcome").isin(REJECTED, FAILED, MISSING)).select(
        "url", "chunk_no", "document_type", "refnum1", "refnum2", "error"
    )


@cache
def _progress(batch: int) -> tuple[list[Column], dict[str, Column]]:
    chunk = F.col("outcome").isin(STORED, REJECTED, FAILED)
    return [
        F.count(F.when(chunk, True)).alias("n_chunks"),
        F.count(F.when(F.col("outcome") == STORED, True)).alias("n_stored"),
        F.count(F.when(F.col("outcome").isin(REJECTED, FAILED), True)).alias("n_rejected"),
        F.max("dropped_words").alias("dropped_words"),
        F.max((F.col("outcome") == MISSING).cast("int")).alias("missing"),
    ], {
        "percent_done": F.when(F.col("n_chunks") > 0,
                               F.col("n_stored") * F.lit(100.0) / F.col("n_chunks")),
        "n_batches": F.ceil(F.col("n_chunks") / batch).cast("bigint"),
    }


def file_progress(rows: DataFrame, batch=schemas.OUTER_BATCH) -> DataFrame:
    """Per file: chunks, stored, share done, batches, words lost to small chunks."""
    sums, shares = _progress(batch)
    return rows.groupBy("url").agg(*sums).withColumns(shares)


def ingest_summary(rows: DataFrame) -> DataFrame:
    """Totals over all files. A file is done when one of its chunks is stored."""
    return file_progress(rows).agg(
        F.sum("n_stored").alias("chunks_stored"),
        F.sum("n_rejected").alias("chunk_errors"),
        F.count(F.when(F.col("n_stored") > 0, True)).alias("files_done"),
        F.sum("missing").cast("bigint").alias("files_missing"),
        F.sum("dropped_words").cast("bigint").alias("dropped_words"),
    )


def file_complete_events(rows: DataFrame) -> DataFrame:
    """One FILE_COMPLETE event per file that is done."""
    return file_progress(rows).filter("n_stored > 0").select(
        F.lit("FILE_COMPLETE").alias("event"),
        filename_for_refnum(F.col("url")).alias("filename"), "url", "n_chunks",
    )


def run_folder(spark: SparkSession, folder: str, table: str, query_text: str | None = None,
               k: int = schemas.TOP_K, run: str | None = None, events: str | None = None, **options):
    """The folder job: ingest, append, list, and answer one query if there is one.

    `run` is given only to repeat a run that failed. `events` is a folder for the
    FILE_COMPLETE events of the run.
    """
    run = run or new_run()
    append_rows(ingest_files(scan_text_dir(spark, folder), **options), table, run)
    if events:
        rows = read_rows(spark, table).filter(F.col("run") == run)
        file_complete_events(rows).write.mode("overwrite").parquet(f"{events}/run={run}")
    vectors = read_vectors(spark, table)
    hits = None
    if query_text and query_text.strip():
        hits = top_k(vectors, query_text, k, options.get("provider"), options.get("dim", HASH_DIM))
    return list_stored(vectors), hits


def run_messages(messages: DataFrame, files: DataFrame, table: str, run: str | None = None,
                 batch_id: int = 0, **options) -> str:
    """The message job, and the id of its run. Vectors, errors, progress and events are read
    from the table after it; a run that failed is repeated under its id."""
    run = run or new_run()
    append_rows(ingest(messages, files, **options), table, run, batch_id)
    return run


def not_blank_rows(rows: DataFrame, text: str = "content") -> DataFrame:
    return rows.filter(not_blank(F.col(text)))
