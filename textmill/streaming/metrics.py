"""Streams over the metrics log: instance registry, liveness, windows."""

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textmill import schemas
from textmill.functions.status import is_heartbeat
from textmill.operators.counters import (
    COUNTERS, FILE_END_EVENTS, FILE_START_EVENTS, INSTANCE, as_events, beside, instance_registry, window_deltas,
)
from textmill.operators.ordered import OrderedLog
from textmill.streaming.inorder import AT, TICK, in_order, with_clock
from textmill.streaming.levels import newest_versions, open_segments, versions_sink
from textmill.streaming.sinks import batch_folder, run_available

SECOND = 1_000_000
WINDOW = [*INSTANCE, "window_start"]
NAMED = [*INSTANCE, "filename"]
# Rows of a block in which an instance's new files of a batch are counted.
BLOCK_ROWS = 4096


def event_clock(events: DataFrame) -> DataFrame:
    """Watermarks need a timestamp with a zone; event times are UTC."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_registry(events: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Keep the instance registry up to date in `path`, and return it."""
    updates = instance_registry(event_clock(events))
    run_available(
        updates.writeStream.outputMode("update").foreachBatch(versions_sink(path, INSTANCE)), checkpoint
    )
    return newest_versions(events.sparkSession, path, INSTANCE)


def stream_windows(events: DataFrame, interval: str, delay: str, path: str,
                   checkpoint: str) -> DataFrame:
    """Keep the window table up to date in `path`, and return it.

    A window is forgotten by the state once it is older than `delay`.
    """
    updates = window_deltas(event_clock(events).withWatermark("ts", delay), interval)
    run_available(
        updates.writeStream.outputMode("update").foreachBatch(versions_sink(path, WINDOW)), checkpoint
    )
    return newest_versions(events.sparkSession, path, WINDOW)


def _newest_times(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.groupby(INSTANCE, as_index=False, dropna=False)[["activity", "heartbeat"]].max()


def liveness_changes(
    events: DataFrame, now_us: int | None = None, alive=schemas.ALIVE_SECONDS,
    degraded=schemas.DEGRADED_SECONDS, stale=schemas.HEARTBEAT_STALE_SECONDS,
    forget=schemas.FORGET_SECONDS,
) -> DataFrame:
    """Liveness of an instance whenever it is heard of, and again when it falls silent.

    Times are reduced to the newest per instance inside every Arrow batch before the
    shuffle. Without a fixed `now_us` the clock is the processing time, and a timeout
    at the next limit reports the change. An instance silent for `forget` seconds has been
    reported offline and leaves the state; if it speaks again, it is new.
    """

    def report(key, times: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        activity, heartbeat = state.get if state.exists else (-1, -1)
        for batch in times:
            if batch.empty:  # a timeout brings no rows
                continue
            activity = max(activity, int(batch["activity"].max()))
            heartbeat = max(heartbeat, int(batch["heartbeat"].max()))
        now = now_us if now_us is not None else int(time.time() * SECOND)
        silent = (now - activity) / SECOND
        level = "alive" if silent <= alive else "degraded" if silent <= degraded else "offline"
        if level == "offline" and silent > forget:
            state.remove()
        else:
            state.update((activity, heartbeat))
            if now_us is None:
                limit = {"alive": alive, "degraded": degraded, "offline": forget}[level]
                state.setTimeoutDuration(max(1, int((limit - silent) * 1000) + 1))
        yield pd.DataFrame({
            "service": [key[0]], "instance_id": [key[1]], "last_activity": [activity],
            "last_heartbeat": [heartbeat], "liveness": [level],
            "heartbeat_stale": [heartbeat < 0 or now - heartbeat > stale * SECOND],
        })

    micros = F.unix_micros(F.col("ts"))
    times = event_clock(events).select(
        *INSTANCE, micros.alias("activity"),
        F.when(is_heartbeat(F.col("event")), micros).otherwise(F.lit(-1)).alias("heartbeat"),
    ).mapInPandas(
        _newest_times, "service string, instance_id string, activity bigint, heartbeat bigint"
    )
    return times.groupBy(*INSTANCE).applyInPandasWithState(
        report,
        "service string, instance_id string, last_activity bigint, last_heartbeat bigint, "
        "liveness string, heartbeat_stale boolean",
        "activity bigint, heartbeat bigint",
        "update",
        GroupStateTimeout.NoTimeout if now_us is not None else GroupStateTimeout.ProcessingTimeTimeout,
    )


def stream_liveness(events: DataFrame, path: str, checkpoint: str, now_us: int, **options) -> DataFrame:
    """Bring the liveness table in `path` up to date as of `now_us`, and return it."""
    changes = liveness_changes(events, now_us, **options)
    run_available(
        changes.writeStream.outputMode("update").foreachBatch(versions_sink(path, INSTANCE)), checkpoint
    )
    return newest_versions(events.sparkSession, path, INSTANCE)


def watch_liveness(events: DataFrame, path: str, checkpoint: str, every="5 seconds", **options):
    """Start a stream that never ends: timeouts need batches even when nothing arrives."""
    changes = liveness_changes(events, **options)
    writer = changes.writeStream.outputMode("update").foreachBatch(versions_sink(path, INSTANCE))
    return writer.option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


# --- running counters while the stream runs ----------------------------------------------

_RUNNING = (f"event_id bigint, {AT} bigint, event string, filename string, boot bigint, current_file string, last_error string, "
            + "nth bigint, first_named boolean, " + ", ".join(f"{name} bigint" for name in COUNTERS))


def counted(events: DataFrame) -> DataFrame:
    """The columns that running counters need, with a clock; counters that did not change changed by 0."""
    deltas = [F.coalesce(F.col(d), F.lit(0)).cast("bigint").alias(d) for d in COUNTERS.values()]
    return with_clock(events).select(*INSTANCE, AT, TICK, "event_id", "event", "filename", "error_text", *deltas)


def _newest(changed: np.ndarray, values: np.ndarray, before):
    """For every row the value of the newest row that changed it."""
    at = np.maximum.accumulate(np.where(changed, np.arange(len(changed)), -1))
    return [before if i < 0 else values[i] for i in at]


def _run_on(rows: pd.DataFrame, carried: dict) -> tuple[pd.DataFrame, dict]:
    """Rows in order with the counters, file and error after them, and the last of these.

    `nth` is a row's place among them, and `first_named` says that none before it names its file."""
    out = rows[["event_id", AT, "event", "filename"]].copy()
    for name, delta in COUNTERS.items():
        out[name] = rows[delta].cumsum() + carried.get(name, 0)
    out["boot"] = min(carried.get("boot", rows[AT].iloc[0]), rows[AT].iloc[0])
    starts, ends = rows["event"].isin(FILE_START_EVENTS).to_numpy(), rows["event"].isin(FILE_END_EVENTS).to_numpy()
    files = np.where(starts, rows["filename"].astype(object).where(rows["filename"].notna(), None), None)
    out["current_file"] = _newest(starts | ends, files, carried.get("current_file"))
    said = rows["error_text"].notna().to_numpy()
    out["last_error"] = _newest(said, rows["error_text"].to_numpy(object), carried.get("last_error"))
    out["nth"] = np.arange(len(out))
    out["first_named"] = (rows["filename"].notna() & ~rows["filename"].duplicated()).to_numpy()
    last = out.iloc[-1]
    carry = {name: int(last[name]) for name in (*COUNTERS, "boot")}
    return out, {**carry, "current_file": last["current_file"], "last_error": last["last_error"]}


def running(events: DataFrame, delay: float, every: float | None = None) -> DataFrame:
    """Events of a stream as from `counted`, with the counters after them, once, in the order of their times.

    Rows that are late by at most `delay` seconds are counted in their place. With `every`,
    only the last event of each window of so many seconds is given; a window that is cut by a
    batch is given again by the next.
    """
    width = None if every is None else int(every * SECOND)

    def step(rows, carried):
        out, carry = _run_on(rows, carried)
        return (out if width is None else out.groupby(out[AT] // width).tail(1)), carry

    return in_order(events, INSTANCE, ["event_id"], step, _RUNNING, delay)


def names_path(path: str) -> str:
    """Where the files seen by a table of snapshots are: beside it, since the table is read as a whole."""
    return f"{path.rstrip('/')}_names"


def snapshot_sink(path: str, **options) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` sink for rows from `running`: their snapshot events, in a folder of the batch.

    How many files an instance has named up to a row does not fit its state, which would hold
    every name. The names are a table of versions, one row per file of an instance, in which a
    batch looks up the names that it brings; its new ones are counted in blocks of its rows.
    """

    def write(rows: DataFrame, batch_id: int) -> None:
        spark, rows = rows.sparkSession, rows.persist()
        known = open_segments(spark, names_path(path), batch_id, ", ".join(f"{c} string" for c in NAMED))
        known = spark.createDataFrame([], rows.select(*NAMED).schema) if known is None else known
        brought = rows.filter("first_named").select(*NAMED, F.lit(True).alias("_brought"))
        seen = beside(known, brought, NAMED).filter("_brought").select(*NAMED, F.lit(True).alias("_seen")).persist()
        try:
            new_file = F.col("first_named") & F.col("_seen").isNull()
            marked = beside(rows, seen, NAMED).withColumn("_new", new_file.cast("long"))
            counted = OrderedLog(marked, INSTANCE, ["nth"], BLOCK_ROWS).scan(sums={"_files": F.col("_new")}).result()
            before = known.groupBy(*INSTANCE).agg(F.count("*").alias("_before"))
            done = beside(counted, before, INSTANCE).withColumns({
                "ts": F.timestamp_micros(F.col(AT)), "boot_ts": F.timestamp_micros("boot"),
                "files_total": F.col("_files") + F.coalesce("_before", F.lit(0)),
                **{c: F.lit(None).cast("string") for c in ("_hostname", "_public_hostname", "_url")}})
            batch_folder(path)(as_events(done, **options), batch_id)
            versions_sink(names_path(path), NAMED)(marked.filter("_new = 1").select(*NAMED), batch_id)
        finally:
            seen.unpersist()
            rows.unpersist()

    return write


def stream_snapshots(events: DataFrame, path: str, checkpoint: str, delay: float, **options) -> DataFrame:
    """Bring the table of snapshot events in `path` up to date, and return it."""
    writer = running(events, delay).writeStream.outputMode("append").foreachBatch(snapshot_sink(path, **options))
    run_available(writer, checkpoint)
    return events.sparkSession.read.parquet(path)


def stream_window_snapshots(events: DataFrame, path: str, checkpoint: str, delay: float, every: float) -> DataFrame:
    """Bring the table of the counters at the end of every window up to date, and return it."""
    width = int(every * SECOND)
    windows = running(events, delay, every).withColumn(
        "window_start", F.timestamp_micros((F.floor(F.col(AT) / width) * width).cast("bigint")))
    kept = windows.select(*WINDOW, "event", *COUNTERS, "current_file", "last_error")
    run_available(kept.writeStream.outputMode("append").foreachBatch(versions_sink(path, WINDOW)), checkpoint)
    return newest_versions(events.sparkSession, path, WINDOW)
