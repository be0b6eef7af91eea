"""Status formulas over counters and events."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill import schemas

# Status and stage names, and the colour each status is shown in.
ERROR, PROCESSING, IDLE = "ERROR", "PROCESSING", "IDLE"
STAGES = {
    "INIT": "starting",
    "FILE_START": "processing",
    "FILE_COMPLETE": "processing",
    "ERROR": "error",
    "SHUTDOWN": "stopping",
}
STATUS_COLORS = {
    "RUNNING": "green",
    "PROCESSING": "green",
    "IDLE": "yellow",
    "STARTING": "yellow",
    "STOPPING": "yellow",
    "ERROR": "red",
}
HEARTBEATS = ("INIT", "HEARTBEAT")
STATUS_OVERRIDES = {"INIT": "STARTING"}
STAGE_OVERRIDES = {"INIT": "starting"}


def processing_rate(processed: Column, uptime_seconds: Column) -> Column:
    return F.when(uptime_seconds == 0, F.lit(0.0)).otherwise(
        processed.cast("double") / uptime_seconds.cast("double")
    )


def format_uptime(seconds: Column) -> Column:
    hours, minutes = (F.floor(seconds / size).cast("bigint") for size in (3600, 60))
    return F.concat(
        hours.cast("string"), F.lit("h "), (minutes % 60).cast("string"), F.lit("m")
    )


def status(total: Column, processed: Column, errors: Column) -> Column:
    return (
        F.when(errors > processed * F.lit(0.1), ERROR)
        .when((total > 0) & (processed < total), PROCESSING)
        .otherwise(IDLE)
    )


def pending(total: Column, processed: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), total - processed)


def percent_done(processed: Column, total: Column) -> Column:
    return processed * F.lit(100.0) / total


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(text) for item in table.items() for text in item]
    return F.try_element_at(F.create_map(*pairs), key)


def processing_stage(event: Column, current_file: Column) -> Column:
    by_file = F.when(current_file.isNotNull(), "processing").otherwise("idle")
    return F.coalesce(_lookup(STAGES, event), by_file)


def status_color(name: Column) -> Column:
    return _lookup(STATUS_COLORS, name)


def status_override(event: Column) -> Column:
    return _lookup(STATUS_OVERRIDES, event)


def stage_override(event: Column) -> Column:
    return _lookup(STAGE_OVERRIDES, event)


def event_override(override: Column, derived: Column) -> Column:
    """A value the caller gave wins over the derived one."""
    return F.coalesce(override, derived)


def is_heartbeat(event: Column) -> Column:
    return event.isin(*HEARTBEATS)


def event_time(text: Column) -> Column:
    """ISO-8601 text or epoch milliseconds to a timestamp; anything else is null."""
    return F.coalesce(
        F.timestamp_millis(text.try_cast("bigint")), F.try_to_timestamp(text)
    )


def liveness(silent_seconds: Column, alive=schemas.ALIVE_SECONDS,
             degraded=schemas.DEGRADED_SECONDS) -> Column:
    return (
        F.when(silent_seconds <= alive, "alive")
        .when(silent_seconds <= degraded, "degraded")
        .otherwise("offline")
    )


def iso_time(ts: Column) -> Column:
    """The text form events carry: ISO-8601, UTC, microseconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
