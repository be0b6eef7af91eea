"""Streaming twins. Each reads a given table as a stream of files until nothing is left."""

from pyspark.sql import functions as F

from textmill.functions.urls import extract_url
from textmill.operators import counters as ct
from textmill.operators.embedding import HashProvider
from textmill.plans.catalog.control import GATE_SQL
from textmill.plans.catalog.ingest import INGEST_MS, INGEST_SQL, chunk_columns
from textmill.plans.catalog.metrics import (
    _WINDOWS, HOUR, LIMITS, LIVENESS_SQL, REGISTRY_SQL, SNAPSHOT_SQL, snapshot_columns, timed, with_presence,
)
from textmill.plans.catalog.registry import query
from textmill.plans.catalog.search import TEXT
from textmill.plans.catalog.sql import HASHED, ISO, NORMAL_URL
from textmill.plans.views import over, view
from textmill.session import new_folder
from textmill.sources.files import stream_table
from textmill.sources.messages import stream_messages as sm_messages
from textmill.sources.vector_table import read_vectors
from textmill.streaming import admission as ad
from textmill.streaming import gate as sg
from textmill.streaming import ingest as si
from textmill.streaming import metrics as sm
from textmill.streaming.sinks import batch_folder, run_available


def streamed_log(spark, folder):
    return over(spark, "metric_events", stream_table(spark, folder, "events"))


@query("messages", INGEST_SQL)
def stream_ingest_chunks(spark, folder):
    documents = stream_table(spark, folder, "documents")
    messages = over(spark, "messages", over(spark, "src_docs", documents))
    out = new_folder(spark, "stream-ingest")
    si.stream_ingest(
        messages, view(spark, folder, "src_docs"), f"{out}/table", f"{out}/events",
        f"{out}/checkpoint", max_words=300, min_words=100, ingest_ms=F.lit(INGEST_MS), parts=spark.sparkContext.defaultParallelism)
    return chunk_columns(read_vectors(spark, f"{out}/table"))


# Rows of a file of a queue, where they are spread evenly over time.
FILE_ROWS = 500_000


def in_late_batches(rows, path, parts=3, most=FILE_ROWS):
    """A queue in `path` of several files, in order of time but for a tenth of the rows, which come a file late.

    More rows are more files, at least `parts`, and not larger ones: a stream sorts a key's rows of a file, and
    holds those of the delay, in one task. Rows are read once, and dealt out to the files by all tasks; the files
    are then written one after the other, since a stream takes them by age."""
    span = rows.agg(F.min("_at").alias("low"), F.max("_at").alias("high"), F.count("_at").alias("n")).first()
    parts = max(parts, -(-span.n // most))
    width = (span.high - span.low) // parts + 1
    part = F.floor((F.col("_at") - span.low) / width) + F.when(F.abs(F.xxhash64("_at")) % 10 == 0, 1).otherwise(0)
    spark, numbered = rows.sparkSession, rows.withColumn("_part", part.cast("int")).filter("_part is not null")
    numbered.write.partitionBy("_part").parquet(f"{path}-dealt")
    dealt = spark.read.schema(numbered.schema).parquet(f"{path}-dealt")
    for n in range(parts + 1):
        dealt.filter(F.col("_part") == n).select(*rows.columns).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path), 2 * width / 1_000_000


def closing_ticks(rows, path):
    """One more file: the clock of every instance far beyond its last row."""
    keys = [c for c in ("service", "instance_id") if c in rows.columns]
    last = rows.groupBy(*keys).agg(F.max("_at").alias("_last"))
    blank = {f.name: F.lit("" if f.dataType.simpleString() == "string" else 0).cast(f.dataType)
             for f in rows.schema if f.name not in (*keys, "_at", "_tick")}
    end = rows.agg(F.max("_at")).first()[0]
    ticks = last.withColumns({"_at": F.lit(end + 366 * 86_400_000_000), "_tick": F.lit(True), **blank})
    ticks.select(*rows.columns).coalesce(1).write.mode("append").parquet(path)


@query("control_log metric_events", GATE_SQL)
def stream_gate(spark, folder):
    """Messages and commands as one stream of several batches, some rows a batch late."""
    messages = view(spark, folder, "metric_events").filter("event = 'CHUNK_COMPLETE'").select(
        F.col("event_id").alias("msg_id"), "ts", "instance_id")
    rows = sg.together(messages, view(spark, folder, "control_log"))
    out = new_folder(spark, "stream-gate")
    queue, delay = in_late_batches(rows, f"{out}/queue")
    closing_ticks(rows, f"{out}/queue")
    gated = sg.stream_gate(queue, f"{out}/table", f"{out}/checkpoint", delay)
    return timed(gated.withColumn("msg_id", F.col("msg_id").cast("bigint")), "ts", "consumed_at")


def late_log(spark, folder, out):
    rows = sm.counted(view(spark, folder, "metric_events"))
    queue, delay = in_late_batches(rows, f"{out}/queue")
    closing_ticks(rows, f"{out}/queue")
    return queue, delay


@query("metric_events", SNAPSHOT_SQL)
def stream_snapshots(spark, folder):
    """Every event with the running counters after it, from a stream of several batches, some rows a batch late."""
    out = new_folder(spark, "stream-snapshots")
    queue, delay = late_log(spark, folder, out)
    return snapshot_columns(sm.stream_snapshots(queue, f"{out}/table", f"{out}/checkpoint", delay))


@query("metric_events", f"""
    with {_WINDOWS}
    select service, instance_id, {ISO('start')} as window_start, newest_event,
           cast(sum(total_delta) over w as bigint) as total_chunks,
           cast(sum(processed_delta) over w as bigint) as processed_chunks,
           cast(sum(error_delta) over w as bigint) as error_count,
           cast(sum(files_delta) over w as bigint) as files_processed
    from windows window w as (partition by service, instance_id order by start)""")
def stream_window_snapshots(spark, folder):
    """Counters at the end of every hour that saw an event; an hour that was cut by a batch is corrected by the next."""
    out = new_folder(spark, "stream-window-snapshots")
    queue, delay = late_log(spark, folder, out)
    windows = sm.stream_window_snapshots(queue, f"{out}/table", f"{out}/checkpoint", delay, 3600)
    return timed(windows, "window_start").withColumnRenamed("event", "newest_event").drop("current_file", "last_error")


@query("messages", INGEST_SQL)
def stream_work_limit(spark, folder):
    """Ingest with at most 1,000 files, and a quarter of all bytes, in hand at a time."""
    out = new_folder(spark, "stream-limit")
    messages, files = view(spark, folder, "messages"), view(spark, folder, "src_docs")
    sizes = ad.file_sizes(files)
    most = max(1, (sizes.agg(F.sum("size")).first()[0] or 0) // 4)
    ad.deal(messages, sizes, f"{out}/queue", 1000, most, files=files)
    queue = ad.stream_dealt(spark, f"{out}/queue", f"msg_id bigint, body string, {ad.DEALT} string")
    si.stream_ingest(queue, ad.dealt_files(spark, f"{out}/queue"), f"{out}/table", f"{out}/events", f"{out}/checkpoint",
                     few=True, max_words=300, min_words=100, ingest_ms=F.lit(INGEST_MS), parts=spark.sparkContext.defaultParallelism)
    return chunk_columns(read_vectors(spark, f"{out}/table"))


@query("messages", f"""
    with asked as (select 0 as query_id, '{TEXT}' as text),
    chosen as (
      select * from (
        select case when json_valid(body) then json_extract_string(body, '$.url') end as raw from messages) named
      where trim(raw) <> ''),
    files as (select url as raw, content from src_docs where trim(content) <> ''),
    named as (
      select {NORMAL_URL.replace('url', 'raw')} as url, content from (select distinct raw from chosen) join files using (raw)),
    {HASHED('d', 'named', 'url', 'content')},
    {HASHED('q', 'asked', 'query_id', 'text')},
    lengths as (select url, sqrt(sum(value * value)) as length from d group by url),
    dots as (select d.url, sum(d.value * q.value) as dot from d join q using (pos) group by d.url),
    ranked as (
      select url, round(1 - coalesce(dot, 0) / (length * (select sqrt(sum(value * value)) from q)), 9) as distance
      from lengths left join dots using (url))
    select rank, round(distance, 6) as distance from (
      select row_number() over (order by distance, url) as rank, distance from ranked)
    where rank <= 5""")
def stream_query_once(spark, folder):
    """One query, answered after the first finished files of a stream, with whole documents as chunks.

    The answer stays when more files come: the messages are sent a second time."""
    out = new_folder(spark, "stream-once")
    messages, files = view(spark, folder, "messages"), view(spark, folder, "src_docs")
    for _ in range(2):
        messages.write.mode("append").parquet(f"{out}/queue")
        queue = spark.readStream.schema(messages.schema).parquet(f"{out}/queue")
        si.stream_ingest(queue, files, f"{out}/table", f"{out}/events", f"{out}/checkpoint", query_text=TEXT,
                         answer=f"{out}/answer", max_words=1_000_000, min_words=0)
    return spark.read.parquet(f"{out}/answer").select(
        F.col("rank").cast("bigint").alias("rank"), F.round("distance", 6).alias("distance"))


@query("messages", """
    select url, count(*) as deliveries, count(*) as n_ids
    from (select case when json_valid(body) then json_extract_string(body, '$.url') end as url from messages) named
    where trim(url) <> '' group by url""")
def stream_text_messages(spark, folder):
    """Messages as lines of text files, read as a stream a file at a time; every line has an id of its own."""
    out = new_folder(spark, "stream-text")
    view(spark, folder, "messages").select("body").repartition(3).write.text(f"{out}/inbox")
    messages = sm_messages(spark, f"{out}/inbox", files_at_once=1).withColumn("url", extract_url(F.col("body")))
    run_available(messages.writeStream.foreachBatch(batch_folder(f"{out}/read")), f"{out}/checkpoint")
    read = spark.read.parquet(f"{out}/read").filter("trim(url) <> ''")
    return read.groupBy("url").agg(F.count("*").alias("deliveries"), F.count_distinct("msg_id").alias("n_ids"))


class Outage(HashProvider):
    """The hashing model, out of reach for every text whose length is a multiple of three."""

    def __reduce__(self):
        return Outage, (self.dim,)

    def __call__(self, texts):
        if any(len(text) % 3 == 0 for text in texts):
            raise ConnectionError("model is down")
        return super().__call__(texts)


@query("messages", INGEST_SQL)
def stream_redelivery(spark, folder):
    """Work that an outage lost comes again, with what was stored and what was not yet sent.

    Three batches: half of the messages while the model fails on a third of the chunks, that
    half again while it fails still, and then all messages. Nothing is lost or stored twice.
    """
    out = new_folder(spark, "stream-redelivery")
    messages = view(spark, folder, "messages")
    files = view(spark, folder, "src_docs")
    for rows, provider in ((messages.filter("msg_id % 2 = 0"), Outage()), (messages.filter("msg_id % 2 = 0"), Outage()), (messages, None)):
        rows.write.mode("append").parquet(f"{out}/queue")
        queue = spark.readStream.schema(messages.schema).parquet(f"{out}/queue")
        si.stream_ingest(queue, files, f"{out}/table", f"{out}/events", f"{out}/checkpoint", provider=provider,
                         max_words=300, min_words=100, ingest_ms=F.lit(INGEST_MS), parts=spark.sparkContext.defaultParallelism)
    return chunk_columns(read_vectors(spark, f"{out}/table"))


@query("", """
    select distinct '/inbox/' || user_id::varchar || '-' || event_type || '.txt' as url from events""")
def stream_dedup(spark, folder):
    """Every event delivers a file of its user and type; deliveries repeat for a month."""
    name = F.concat(F.lit("/inbox/"), F.col("user_id").cast("string"), F.lit("-"),
                    F.col("event_type"), F.lit(".txt"))
    deliveries = sm.event_clock(stream_table(spark, folder, "events")).select("ts", name.alias("url"))
    out = new_folder(spark, "stream-dedup")
    distinct = si.stream_dedup(deliveries, "60 days")
    run_available(distinct.writeStream.foreachBatch(batch_folder(f"{out}/urls")), f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/urls").select("url")


@query("metric_events", REGISTRY_SQL)
def stream_registry(spark, folder):
    out = new_folder(spark, "stream-registry")
    registry = sm.stream_registry(
        with_presence(streamed_log(spark, folder)), f"{out}/table", f"{out}/checkpoint")
    return timed(registry, "last_activity", "last_heartbeat")


@query("metric_events", f"""
    with {_WINDOWS}
    select service, instance_id, {ISO('start')} as window_start, total_delta, processed_delta,
           error_delta, files_delta, n_events, newest_event from windows""")
def stream_metrics_windows(spark, folder):
    out = new_folder(spark, "stream-windows")
    windows = sm.stream_windows(
        streamed_log(spark, folder), HOUR, "2 hours", f"{out}/table", f"{out}/checkpoint")
    return timed(windows, "window_start")


@query("metric_events", LIVENESS_SQL)
def stream_liveness(spark, folder):
    newest = sm.event_clock(view(spark, folder, "metric_events")).agg(F.unix_micros(F.max("ts"))).first()[0]
    out = new_folder(spark, "stream-liveness")
    table = sm.stream_liveness(
        streamed_log(spark, folder), f"{out}/table", f"{out}/checkpoint", now_us=newest, **LIMITS)
    return table.select(*ct.INSTANCE, "liveness", "heartbeat_stale")
