"""Counters of a metrics log: running values, resets, windows and reports.

A log row has `event_id, ts, service, instance_id, event, filename, error_text`
and the changes `total_delta, processed_delta, error_delta, files_delta`.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill import schemas
from textmill.functions import status as st
from textmill.functions.urls import instance_url
from textmill.operators.ordered import BLOCK, KEY, OrderedLog

INSTANCE = ["service", "instance_id"]
ORDER = ["ts", "event_id"]
COUNTERS = {
    "total_chunks": "total_delta",
    "processed_chunks": "processed_delta",
    "error_count": "error_delta",
    "files_processed": "files_delta",
}
# Event names on the shared log.
FILE_START_EVENTS = ("FILE_START", "CHUNK_COMPLETE")
FILE_END_EVENTS = ("FILE_COMPLETE", "FILE_PROCESSED", "ERROR")
ERROR_EVENT = "ERROR"
RESET_EVENT = "RESET"
COMPLETE_EVENTS = ("FILE_COMPLETE", "FILE_PROCESSED")


def _file_change(event: Column, filename: Column) -> Column:
    """`struct<file>` where the file in work changes; a null file means none."""
    starts = event.isin(*FILE_START_EVENTS)
    ends = event.isin(*FILE_END_EVENTS)
    return F.when(starts, F.struct(filename.alias("file"))).when(
        ends, F.struct(F.lit(None).cast("string").alias("file"))
    )


def _error_change(text: Column) -> Column:
    return F.when(text.isNotNull(), F.struct(text.alias("error")))


def _deltas():
    return {name: F.col(delta) for name, delta in COUNTERS.items()}


def running_counters(log: DataFrame, keys=INSTANCE, order=ORDER) -> DataFrame:
    """Every event with the counters after it."""
    used = [*keys, *order, "event", *COUNTERS.values()]
    done = OrderedLog(log.select(*used), keys, order).scan(sums=_deltas())
    return done.result().drop(*COUNTERS.values())


def last_error(log: DataFrame, keys=INSTANCE, order=ORDER) -> DataFrame:
    """Every event with the newest error so far."""
    done = OrderedLog(log.select(*keys, *order, "event", "error_text"), keys, order).scan(
        lasts={"last_error": F.col("error_text")}
    )
    return done.result().drop("error_text")


def current_file(log: DataFrame, keys=INSTANCE, order=ORDER) -> DataFrame:
    """Every event with the file in work after it."""
    done = OrderedLog(log.select(*keys, *order, "event", "filename"), keys, order).scan(
        lasts={"_file": _file_change(F.col("event"), F.col("filename"))}
    )
    return done.result().withColumn("current_file", F.col("_file.file")).drop("_file", "filename")


def counters_since_reset(log: DataFrame, keys=INSTANCE, order=ORDER) -> DataFrame:
    """As `running_counters`, but a RESET event zeroes counters, file and error. One scan.

    Inside a block, totals at the newest reset are taken off the running totals. A block
    without a reset adds to what it began with, one with a reset begins anew; running
    totals over blocks give what each begins with.
    """
    resets = F.col("event") == RESET_EVENT
    nothing = F.lit(None).cast("string")
    changes = {
        "_file": F.when(resets, F.struct(nothing.alias("file"))).otherwise(
            _file_change(F.col("event"), F.col("filename"))),
        "_error": F.when(resets, F.struct(nothing.alias("error"))).otherwise(
            _error_change(F.col("error_text"))),
    }
    used = [*keys, *order, "event", *COUNTERS.values()]
    rows = OrderedLog(log.select(*used, *[c.alias(f"{n}_change") for n, c in changes.items()]), keys, order)
    up_to, _ = rows.inside()
    rows = rows.with_columns({
        **{n: F.sum(delta).over(up_to) for n, delta in COUNTERS.items()},
        **{n: F.last(f"{n}_change", True).over(up_to) for n in changes},
    })
    rows = rows.with_columns({"_base": F.last(F.when(resets, F.struct(*COUNTERS)), True).over(up_to)})
    position, end = F.struct(*order), "_end"
    blocks = rows.blocks(_end=F.max_by(F.struct(*COUNTERS, "_base", *changes), position)).select("*", f"{end}.*")
    earlier = rows.earlier_blocks()
    with_this = earlier.rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumns({f"_all_{n}": F.sum(n).over(with_this) for n in COUNTERS})
    # Totals of the whole log at the newest reset of a block.
    at_reset = F.when(F.col("_base").isNotNull(), F.struct(
        *[(F.col(f"_all_{n}") - F.col(n) + F.col(f"_base.{n}")).alias(n) for n in COUNTERS]))
    blocks = blocks.withColumn("_reset_at", at_reset)
    reset_before = F.last("_reset_at", True).over(earlier)
    blocks = blocks.select(
        KEY, BLOCK,
        *[(F.col(f"_all_{n}") - F.col(n) - F.coalesce(reset_before[n], F.lit(0))).alias(f"_begin_{n}") for n in COUNTERS],
        *[F.last(n, True).over(earlier).alias(f"_begin{n}") for n in changes])
    scanned = rows.carry(blocks).result()
    since = {
        n: F.col(n) - F.when(F.col("_base").isNotNull(), F.col(f"_base.{n}")).otherwise(-F.col(f"_begin_{n}"))
        for n in COUNTERS
    }
    return scanned.select(
        *keys, *order, "event", *[c.alias(n) for n, c in since.items()],
        F.coalesce("_file", "_begin_file")["file"].alias("current_file"),
        F.coalesce("_error", "_begin_error")["error"].alias("last_error"),
    )


def instance_totals(log: DataFrame, keys=INSTANCE, order=ORDER) -> DataFrame:
    """Final counters, file in work, last error and first and last time per instance.

    Sums and newest values only, so a busy instance is reduced before the shuffle.
    """
    position = F.struct(*order)
    file_change = _file_change(F.col("event"), F.col("filename"))
    return log.groupBy(*keys).agg(
        *[F.sum(delta).alias(name) for name, delta in COUNTERS.items()],
        F.max_by(file_change, F.when(file_change.isNotNull(), position))["file"].alias("current_file"),
        F.max_by("error_text", F.when(F.col("error_text").isNotNull(), position)).alias("last_error"),
        F.min("ts").alias("boot_ts"),
        F.max("ts").alias("last_ts"),
        F.count("*").alias("n_events"),
    )


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds, rounded down."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.floor(micros / 1000000).cast("bigint")


def files_seen(log: DataFrame, keys=INSTANCE) -> DataFrame:
    """Files that the events of an instance name. Names are made distinct before they are counted."""
    names = log.filter("filename is not null").select(*keys, "filename").distinct()
    return names.groupBy(*keys).agg(F.count("*").alias("files_total"))


def beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys that may be null."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(named, same, "left").drop(*[f"_right_{k}" for k in keys])


def status_report(totals: DataFrame, now: Column) -> DataFrame:
    """The report of every instance at `now`: processing, files, chunks, system, time.

    `totals` as from `instance_totals`. Switch and file count are taken from columns of
    `control.final_state` and `files_seen` where these were joined; else an instance is
    off, and its count null.
    """
    total, processed, errors = (F.col(c) for c in ("total_chunks", "processed_chunks", "error_count"))
    uptime = seconds_between(F.col("boot_ts"), now)

    def joined(name, kind, default=None):
        value = F.col(name) if name in totals.columns else F.lit(None)
        return F.coalesce(value.cast(kind), F.lit(default).cast(kind))

    return totals.select(
        *INSTANCE, now.alias("timestamp"),
        F.struct(
            joined("enabled", "boolean", False).alias("enabled"),
            joined("control_status", "string", "STOPPED").alias("status"),
            joined("consumer_status", "string", "IDLE").alias("consumerStatus"),
            joined("last_changed", "timestamp").alias("lastChanged"),
            joined("last_change_reason", "string").alias("lastChangeReason"),
        ).alias("processing"),
        F.struct(
            F.col("files_processed").alias("processed"), joined("files_total", "bigint").alias("total"),
            F.coalesce("current_file", F.lit("none")).alias("current"),
        ).alias("files"),
        F.struct(
            processed.alias("processed"), total.alias("total"),
            st.pending(total, processed).alias("pending"),
            st.processing_rate(processed, uptime).alias("rate"),
        ).alias("chunks"),
        F.struct(
            st.status(total, processed, errors).alias("status"),
            st.format_uptime(uptime).alias("uptime"),
            errors.alias("errors"), F.col("last_error"),
        ).alias("system"),
    )


def snapshot_events(log: DataFrame, input_mode: str | None = None, version: str | None = None,
                    port: int = schemas.DEFAULT_PORT) -> DataFrame:
    """Every log row as an event of the shared log, with the counters, file, error and files
    seen after it. Times run from the first row of an instance.

    Memory is not in the log and stays null. `hostname`, `public_hostname` and `url` are used
    where the log has them; an instance without a name for its host is its own host.
    """
    have = {c: F.col(c) if c in log.columns else F.lit(None).cast("string") for c in ("hostname", "public_hostname", "url")}
    names = [F.when(F.col("filename").isNotNull(), F.struct(*ORDER)).alias("_named")]
    firsts = log.select(*INSTANCE, "filename", *names).groupBy(*INSTANCE, "filename").agg(F.min("_named").alias("_first"))
    marked = beside(log, firsts.filter("filename is not null"), [*INSTANCE, "filename"])
    new_file = F.coalesce((F.struct(*ORDER) == F.col("_first")).cast("long"), F.lit(0).cast("long"))
    used = marked.select(
        *INSTANCE, *ORDER, "event", "filename", "error_text", *COUNTERS.values(), new_file.alias("_new_file"),
        *[c.alias(f"_{n}") for n, c in have.items()])
    rows = OrderedLog(used, INSTANCE, ORDER).scan(
        sums={**_deltas(), "files_total": F.col("_new_file")},
        lasts={"last_error": F.col("error_text"), "_file": _file_change(F.col("event"), F.col("filename"))},
    ).result()
    boots = log.groupBy(*INSTANCE).agg(F.min("ts").alias("boot_ts"))
    rows = beside(rows, boots, INSTANCE).withColumn("current_file", F.col("_file.file"))
    return as_events(rows, input_mode, version, port)


def as_events(rows: DataFrame, input_mode: str | None = None, version: str | None = None,
              port: int = schemas.DEFAULT_PORT) -> DataFrame:
    """Log rows with the running values after them as events of the shared log; in batch and in a stream."""
    total, processed, errors = (F.col(c) for c in ("total_chunks", "processed_chunks", "error_count"))
    uptime, file = seconds_between(F.col("boot_ts"), F.col("ts")), F.col("current_file")
    event = F.col("event")
    host = F.coalesce("_hostname", "instance_id")
    return rows.select(
        "event_id", F.col("instance_id").alias("instanceId"), st.iso_time(F.col("ts")).alias("timestamp"),
        total.alias("totalChunks"), processed.alias("processedChunks"), errors.alias("errorCount"),
        st.processing_rate(processed, uptime).alias("processingRate"), st.format_uptime(uptime).alias("uptime"),
        st.event_override(st.status_override(event), st.status(total, processed, errors)).alias("status"),
        file.alias("currentFile"), F.col("files_processed").alias("filesProcessed"), F.col("files_total").alias("filesTotal"),
        F.col("last_error").alias("lastError"), F.lit(None).cast("bigint").alias("memoryUsedMB"),
        st.pending(total, processed).alias("pendingMessages"),
        F.struct(
            F.col("service"),
            st.event_override(st.stage_override(event), st.processing_stage(event, file)).alias("processingStage"),
            F.lit("running").alias("bindingState"), F.lit(None).cast("boolean").alias("hdfsProcessedDirExists"),
            F.lit(input_mode).cast("string").alias("inputMode"),
        ).alias("meta"),
        host.alias("hostname"), F.col("_public_hostname").alias("publicHostname"), "event", "filename",
        instance_url(F.col("_url"), F.col("_public_hostname"), host, F.lit(port)).alias("url"),
        F.unix_millis(F.col("boot_ts").cast("timestamp")).alias("bootEpoch"), F.lit(version).cast("string").alias("version"),
    )


def files_processed(log: DataFrame) -> DataFrame:
    """Files done and files seen, over the whole log.

    Seen are the files that any event names; names are first made distinct.
    """
    names = log.filter("filename is not null").groupBy("filename").agg(
        F.max(F.col("event").isin(*COMPLETE_EVENTS).cast("int")).alias("done")
    )
    return names.agg(F.sum("done").alias("files_processed"), F.count("*").alias("files_total"))


def fleet_rollup(log: DataFrame) -> DataFrame:
    """Throughput, progress and error rate by instance, by service and in all.

    The log is summed per instance first; only those sums are rolled up.
    """
    per_instance = log.groupBy(*INSTANCE).agg(
        *[F.sum(delta).alias(name) for name, delta in COUNTERS.items()],
        F.count("*").alias("n_events"),
    )
    names = [*COUNTERS, "n_events"]
    rolled = per_instance.rollup(*INSTANCE).agg(
        F.grouping_id().cast("int").alias("level"), *[F.sum(n).alias(n) for n in names]
    )
    done = F.col("processed_chunks")
    return rolled.withColumns({
        "progress_percent": F.when(F.col("total_chunks") > 0, st.percent_done(done, F.col("total_chunks"))),
        "error_rate": F.when(done > 0, F.col("error_count") / done),
    })


def event_counts(log: DataFrame) -> DataFrame:
    """Events, active instances and errors, counted over one row per instance."""
    per_instance = log.groupBy(*INSTANCE).agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col("event") == ERROR_EVENT, True)).alias("errors"),
    )
    return per_instance.agg(
        F.sum("n").alias("total_events"),
        F.count("*").alias("active_instances"),
        F.sum("errors").alias("error_events"),
    )


def recent_events(log: DataFrame, n: int = schemas.RECENT_EVENTS) -> DataFrame:
    return log.orderBy(*map(F.desc, ORDER)).limit(n)


def window_deltas(log: DataFrame, interval: str, key_time: str = "ts") -> DataFrame:
    """Counter changes and the newest event per instance and tumbling window.

    The same in batch and in a stream, where `ts` has to be a timestamp.
    """
    return (
        log.groupBy(*INSTANCE, F.window(key_time, interval).alias("window"))
        .agg(
            *[F.sum(delta).alias(delta) for delta in COUNTERS.values()],
            F.count("*").alias("n_events"),
            F.max_by("event", F.struct(*ORDER)).alias("newest_event"),
        )
        .select(*INSTANCE, F.col("window.start").alias("window_start"),
                *COUNTERS.values(), "n_events", "newest_event")
    )


def window_snapshots(log: DataFrame, interval: str = schemas.SNAPSHOT_INTERVAL) -> DataFrame:
    """Counters at the end of every window that saw an event.

    The running sum goes over one row per window, not over the events.
    """
    done = OrderedLog(window_deltas(log, interval), INSTANCE, ["window_start"]).scan(sums=_deltas())
    return done.result().drop(*COUNTERS.values())


def instance_registry(log: DataFrame) -> DataFrame:
    """What is known of every instance: newest activity, heartbeat, event, status and address."""
    position = F.struct(*ORDER)
    newest = lambda value: F.max_by(value, F.when(F.col(value).isNotNull(), position)).alias(value)
    known = [newest(c) for c in ("event", "status", "url") if c in log.columns]
    return log.groupBy(*INSTANCE).agg(
        F.max("ts").alias("last_activity"),
        F.max(F.when(st.is_heartbeat(F.col("event")), F.col("ts"))).alias("last_heartbeat"),
        *known,
    )


def liveness(registry: DataFrame, now: Column, alive=schemas.ALIVE_SECONDS,
             degraded=schemas.DEGRADED_SECONDS, stale=schemas.HEARTBEAT_STALE_SECONDS) -> DataFrame:
    micros = lambda ts: F.unix_micros(ts.cast("timestamp"))
    silent = (micros(now) - micros(F.col("last_activity"))) / 1000000
    quiet = (micros(now) - micros(F.col("last_heartbeat"))) / 1000000
    return registry.withColumns({
        "liveness": st.liveness(silent, alive, degraded),
        "heartbeat_stale": F.coalesce(quiet > stale, F.lit(True)),
    })


def heartbeat_gaps(log: DataFrame, stale=schemas.HEARTBEAT_STALE_SECONDS) -> DataFrame:
    """Seconds since the heartbeat before, for every heartbeat."""
    beats = log.filter(st.is_heartbeat(F.col("event"))).select(*INSTANCE, *ORDER)
    gap = (F.unix_micros(F.col("ts").cast("timestamp"))
           - F.unix_micros(F.col("previous_ts").cast("timestamp"))) / 1000000
    done = OrderedLog(beats, INSTANCE, ORDER).scan(previous={"previous_ts": F.col("ts")})
    return done.result().withColumn("gap_seconds", gap).withColumn("stale", F.col("gap_seconds") > stale)


def with_address(registry: DataFrame, port=schemas.DEFAULT_PORT) -> DataFrame:
    """The URL of every instance, from its own or from its host names."""
    return registry.withColumn("url", instance_url(
        F.col("url"), F.col("public_hostname"), F.col("hostname"), F.lit(port)))
