"""Queries over the metrics log."""

from pyspark.sql import functions as F

from textmill.functions import status as st
from textmill.functions.urls import instance_url as address_of
from textmill.operators import control as co
from textmill.operators import counters as ct
from textmill.plans.catalog.registry import query
from textmill.plans.catalog.sql import ISO
from textmill.plans.views import dealt, view
from textmill.session import new_folder
from textmill.sources import metrics_log as ml

HOUR = "1 hour"
BY_INSTANCE = "partition by service, instance_id order by ts, event_id"


def log(spark, folder):
    return view(spark, folder, "metric_events")


def timed(rows, *columns):
    """Times as the text events carry."""
    return rows.withColumns({c: st.iso_time(F.col(c)) for c in columns})


def now_of(events):
    """The newest time in the log, as a scalar."""
    return events.agg(F.max("ts").alias("now")).scalar()


# --- events as JSON ----------------------------------------------------------

def snapshots(spark, folder):
    """Every log row as an event in the schema of the shared log."""
    file = F.when(F.col("event") == "CHUNK_COMPLETE", F.col("filename"))
    derived = st.status(F.col("total_delta"), F.col("processed_delta"), F.col("error_delta"))
    return dealt(log(spark, folder)).select(
        "event_id",
        F.col("instance_id").alias("instanceId"),
        st.iso_time(F.col("ts")).alias("timestamp"),
        F.col("total_delta").alias("totalChunks"),
        F.col("processed_delta").alias("processedChunks"),
        F.col("error_delta").alias("errorCount"),
        st.event_override(st.status_override(F.col("event")), derived).alias("status"),
        file.alias("currentFile"),
        F.col("error_text").alias("lastError"),
        st.pending(F.col("total_delta"), F.col("processed_delta")).alias("pendingMessages"),
        F.struct(
            F.col("service"),
            st.event_override(st.stage_override(F.col("event")), st.processing_stage(F.col("event"), file))
            .alias("processingStage"),
            F.lit("running").alias("bindingState"),
        ).alias("meta"),
        "event",
        F.col("filename"),
        F.concat(F.lit("http://"), F.col("instance_id"), F.lit(":8080")).alias("url"),
    )


_SNAPSHOT = f"""
    snapshots as (
      select event_id, instance_id, service, event, filename, error_text, {ISO('ts')} as event_ts,
             'http://' || instance_id || ':8080' as url,
             case when event = 'INIT' then 'STARTING'
                  when error_delta > processed_delta * 0.1::double then 'ERROR'
                  when total_delta > 0 and processed_delta < total_delta then 'PROCESSING'
                  else 'IDLE' end as status,
             case event when 'INIT' then 'starting' when 'FILE_COMPLETE' then 'processing'
                        when 'ERROR' then 'error'
                        else case when event = 'CHUNK_COMPLETE' then 'processing' else 'idle' end
             end as stage,
             greatest(total_delta - processed_delta, 0) as pending, total_delta, processed_delta
      from metric_events)"""


@query("metric_events", f"""
    with {_SNAPSHOT}
    select event_id, instance_id, event_ts, status, service, stage, filename, cast(pending as varchar) as pending,
           10 + (event = 'CHUNK_COMPLETE')::int + (error_text is not null)::int
              + (filename is not null)::int as n_fields
    from snapshots""")
def metrics_to_json(spark, folder):
    bodies = ml.events_to_json(snapshots(spark, folder))
    value = lambda path: F.get_json_object("body", f"$.{path}")
    return bodies.select(
        "event_id", value("instanceId").alias("instance_id"), value("timestamp").alias("event_ts"),
        value("status").alias("status"), value("meta.service").alias("service"),
        value("meta.processingStage").alias("stage"), value("filename").alias("filename"),
        value("pendingMessages").alias("pending"),
        F.size(F.json_object_keys("body")).alias("n_fields"))


def _bodies(spark, folder):
    """The shared log as JSON; INIT events lack their instance, ERROR events are cut short."""
    made = ml.events_to_json(snapshots(spark, folder).withColumn(
        "instanceId", F.when(F.col("event") != "INIT", F.col("instanceId"))).withColumn("kind", F.col("event")))
    broken = F.when(F.col("kind") == "ERROR", F.expr("substr(body, 1, 20)")).otherwise(F.col("body"))
    return made.select("event_id", broken.alias("body"))


@query("metric_events", f"""
    with {_SNAPSHOT}
    select event_id, instance_id, event_ts, event, status, url, service, stage, filename,
           total_delta as total_chunks, processed_delta as processed_chunks
    from snapshots where event not in ('INIT', 'ERROR')""")
def metrics_parse(spark, folder):
    parsed = ml.parse_metrics(_bodies(spark, folder))
    return parsed.select(
        "event_id", F.col("instanceId").alias("instance_id"),
        st.iso_time(st.event_time(F.col("timestamp"))).alias("event_ts"), "event", "status", "url",
        "meta.service", F.col("meta.processingStage").alias("stage"), "filename",
        F.col("totalChunks").alias("total_chunks"), F.col("processedChunks").alias("processed_chunks"))


@query("metric_events", """
    select event_id,
           case event when 'INIT' then 'instanceId'
             else 'instanceId,timestamp,event,status,url,meta.service,meta.processingStage' end as missing
    from metric_events where event in ('INIT', 'ERROR')""")
def metrics_invalid(spark, folder):
    return ml.invalid_metrics(_bodies(spark, folder)).select("event_id", "missing")


@query("metric_events", """
    select event_id, service, event,
           case when service <> 'watch' then filename end as filename,
           case when service <> 'extract' then error_text end as error_text
    from metric_events""")
def metrics_union(spark, folder):
    """Three services on one log, two of which leave a field out."""
    common = ["event_id", "service", "event"]
    of = lambda name, *more: log(spark, folder).filter(F.col("service") == name).select(*common, *more)
    return ml.union_metrics(of("embed", "filename", "error_text"), of("watch", "error_text"),
                            of("extract", "filename"))


@query("metric_events", """
    select event_id,
           case when event = 'ERROR' then null
                when event = 'HEARTBEAT' then epoch_us(ts) // 1000 * 1000 else epoch_us(ts) end as micros
    from metric_events""")
def event_time(spark, folder):
    """ISO text, epoch milliseconds for heartbeats, and nonsense for errors."""
    ts = F.col("ts").cast("timestamp")
    text = (
        F.when(F.col("event") == "ERROR", "soon")
        .when(F.col("event") == "HEARTBEAT", F.unix_millis(ts).cast("string"))
        .otherwise(st.iso_time(ts))
    )
    return log(spark, folder).select("event_id", F.unix_micros(st.event_time(text)).alias("micros"))


@query("metric_events", """
    select event_id,
           case when event = 'INIT' then 'https://ui.example.org/' || instance_id
                when event = 'ERROR' then 'http://' || service || '.example.org:8080'
                when event = 'HEARTBEAT' then null
                else 'http://' || instance_id || ':8080' end as url
    from metric_events""")
def instance_url(spark, folder):
    own = F.when(F.col("event") == "INIT", F.concat(F.lit("https://ui.example.org/"), F.col("instance_id"))).otherwise(" ")
    public = F.when(F.col("event") == "ERROR", F.concat(F.col("service"), F.lit(".example.org")))
    host = F.when(F.col("event") != "HEARTBEAT", F.col("instance_id"))
    return log(spark, folder).select(
        "event_id", address_of(own, public, host, F.lit(8080)).alias("url"))


@query("metric_events", f"""
    with {_SNAPSHOT}
    select event_id, event, stage as processing_stage, status from snapshots""")
def processing_stage(spark, folder):
    return snapshots(spark, folder).select(
        "event_id", "event", F.col("meta.processingStage").alias("processing_stage"), "status")


@query("metric_events", f"""
    with {_SNAPSHOT}
    select event_id, status,
           case when status in ('RUNNING', 'PROCESSING') then 'green'
                when status in ('IDLE', 'STARTING', 'STOPPING') then 'yellow'
                when status = 'ERROR' then 'red' end as color
    from snapshots""")
def status_color(spark, folder):
    return snapshots(spark, folder).select(
        "event_id", "status", st.status_color(F.col("status")).alias("color"))


# --- values after every event --------------------------------------------------

@query("metric_events", f"""
    select event_id, service, instance_id, event,
           cast(sum(total_delta) over w as bigint) as total_chunks,
           cast(sum(processed_delta) over w as bigint) as processed_chunks,
           cast(sum(error_delta) over w as bigint) as error_count,
           cast(sum(files_delta) over w as bigint) as files_processed
    from metric_events
    window w as ({BY_INSTANCE} rows between unbounded preceding and current row)""")
def running_counters(spark, folder):
    return ct.running_counters(log(spark, folder)).drop("ts")


@query("metric_events", f"""
    select event_id, service, instance_id, event,
           last_value(error_text ignore nulls) over (
             {BY_INSTANCE} rows between unbounded preceding and current row) as last_error
    from metric_events""")
def last_error(spark, folder):
    return ct.last_error(log(spark, folder)).drop("ts")


@query("metric_events", f"""
    with changes as (
      select *, case when event = 'CHUNK_COMPLETE' then filename
                     when event in ('FILE_COMPLETE', 'ERROR') then '' end as change
      from metric_events)
    select event_id, service, instance_id, event,
           nullif(last_value(change ignore nulls) over (
             {BY_INSTANCE} rows between unbounded preceding and current row), '') as current_file
    from changes""")
def current_file(spark, folder):
    return ct.current_file(log(spark, folder)).drop("ts")


@query("metric_events", f"""
    select event_id, service, instance_id, {ISO('ts')} as ts, {ISO('before')} as previous_ts,
           (epoch_us(ts) - epoch_us(before)) / 1000000 as gap_seconds,
           (epoch_us(ts) - epoch_us(before)) / 1000000 > 20 as stale
    from (select *, lag(ts) over ({BY_INSTANCE}) as before
          from metric_events where event in ('INIT', 'HEARTBEAT'))""")
def heartbeat_gaps(spark, folder):
    return timed(ct.heartbeat_gaps(log(spark, folder)), "ts", "previous_ts")


_WINDOWS = """
    windows as (
      select service, instance_id, date_trunc('hour', ts) as start,
             cast(sum(total_delta) as bigint) as total_delta,
             cast(sum(processed_delta) as bigint) as processed_delta,
             cast(sum(error_delta) as bigint) as error_delta,
             cast(sum(files_delta) as bigint) as files_delta,
             count(*) as n_events, arg_max(event, (ts, event_id)) as newest_event
      from metric_events group by 1, 2, 3)"""


@query("metric_events", f"""
    with {_WINDOWS}
    select service, instance_id, {ISO('start')} as window_start, n_events, newest_event,
           cast(sum(total_delta) over w as bigint) as total_chunks,
           cast(sum(processed_delta) over w as bigint) as processed_chunks,
           cast(sum(error_delta) over w as bigint) as error_count,
           cast(sum(files_delta) over w as bigint) as files_processed
    from windows
    window w as (partition by service, instance_id order by start)""")
def metrics_windows(spark, folder):
    return timed(ct.window_snapshots(log(spark, folder), HOUR), "window_start")


# --- fields that the schema does not name ----------------------------------------

@query("metric_events", """
    select event_id, instance_id, service, 'c' || event_id::varchar as commit, event_id * 0.5::double as load,
           event_id % 3 = 0 as canary, case when event_id % 5 = 0 then 'tag "' || event_id::varchar || '"' end as tag,
           'zone-' || (user_zone)::varchar as zone, 6::bigint as n_extra
    from (select *, event_id % 4 as user_zone from metric_events)""")
def metrics_extra_fields(spark, folder):
    """Events with fields of their own, parsed, written again and read back: each keeps its name, place and type."""
    events = snapshots(spark, folder)
    number = F.col("event_id")
    tags = F.when(number % 5 == 0, F.array(F.concat(F.lit('tag "'), number.cast("string"), F.lit('"')))).otherwise(F.array())
    own = F.struct(
        F.concat(F.lit("c"), number.cast("string")).alias("commit"), (number * 0.5).alias("load"),
        (number % 3 == 0).alias("canary"), tags.alias("tags"), F.struct(number.alias("id")).alias("pod"))
    meta = F.struct("meta.*", F.struct(F.concat(F.lit("zone-"), (number % 4).cast("string")).alias("zone")).alias("place"))
    plain = [c for c in events.columns if c not in ("event_id", "meta")]
    bodies = events.withColumns({"meta": meta, "_own": own}).select(F.to_json(F.struct(*plain, "meta", "_own.*")).alias("body"))
    path = new_folder(spark, "extra")
    ml.write_metrics(ml.parse_metrics(bodies, extra=True), path)
    found = ml.parse_metrics(spark.read.text(path).withColumnRenamed("value", "body"), extra=True)
    of = lambda name, path, kind: F.try_variant_get(F.col("extra")[name], path, kind)
    return found.select(
        of("pod", "$.id", "bigint").alias("event_id"), F.col("instanceId").alias("instance_id"), F.col("meta.service").alias("service"),
        of("commit", "$", "string").alias("commit"), of("load", "$", "double").alias("load"), of("canary", "$", "boolean").alias("canary"),
        of("tags", "$[0]", "string").alias("tag"), F.try_variant_get(F.col("extra_meta")["place"], "$.zone", "string").alias("zone"),
        (F.size("extra") + F.size("extra_meta")).cast("bigint").alias("n_extra"))


# --- reports -------------------------------------------------------------------

def with_presence(events):
    """The log with the status and address its instances report."""
    return events.withColumns({
        "status": st.event_override(
            st.status_override(F.col("event")), F.when(F.col("event") == "ERROR", st.ERROR).otherwise(st.PROCESSING)),
        "url": F.concat(F.lit("http://"), F.col("instance_id"), F.lit(":8080")),
    })


REGISTRY = """
    registry as (
      select service, instance_id, max(ts) as last_activity,
             max(ts) filter (event in ('INIT', 'HEARTBEAT')) as last_heartbeat,
             arg_max(event, (ts, event_id)) as event,
             arg_max(case event when 'INIT' then 'STARTING' when 'ERROR' then 'ERROR'
                                else 'PROCESSING' end, (ts, event_id)) as status,
             arg_max('http://' || instance_id || ':8080', (ts, event_id)) as url
      from metric_events group by service, instance_id)"""


REGISTRY_SQL = f"""
    with {REGISTRY}
    select service, instance_id, {ISO('last_activity')} as last_activity,
           {ISO('last_heartbeat')} as last_heartbeat, event, status, url from registry"""


@query("metric_events", REGISTRY_SQL)
def instance_registry(spark, folder):
    registry = ct.instance_registry(with_presence(log(spark, folder)))
    return timed(registry, "last_activity", "last_heartbeat")


LIVENESS_SQL = f"""
    with {REGISTRY},
    silent as (
      select *, (epoch_us(now) - epoch_us(last_activity)) / 1000000 as quiet,
             (epoch_us(now) - epoch_us(last_heartbeat)) / 1000000 as no_beat
      from registry, (select max(ts) as now from metric_events))
    select service, instance_id,
           case when quiet <= 300 then 'alive' when quiet <= 3600 then 'degraded' else 'offline' end as liveness,
           coalesce(no_beat > 600, true) as heartbeat_stale
    from silent"""

# The given log has minutes between events, not seconds.
LIMITS = {"alive": 300, "degraded": 3600, "stale": 600}


@query("metric_events", LIVENESS_SQL)
def liveness(spark, folder):
    events = log(spark, folder)
    found = ct.liveness(ct.instance_registry(events), now_of(events), **LIMITS)
    return found.select("service", "instance_id", "liveness", "heartbeat_stale")


@query("metric_events", f"""
    select event_id, {ISO('ts')} as ts, service, instance_id, event from metric_events
    order by metric_events.ts desc, event_id desc limit 50""")
def recent_events(spark, folder):
    rows = ct.recent_events(log(spark, folder).select("event_id", "ts", "service", "instance_id", "event"))
    return timed(rows, "ts")


@query("metric_events", """
    select count(*) as total_events, count(distinct (service, instance_id)) as active_instances,
           count(*) filter (event = 'ERROR') as error_events
    from metric_events""")
def event_counts(spark, folder):
    return ct.event_counts(log(spark, folder))


@query("metric_events", """
    select service, instance_id, cast(grouping_id(service, instance_id) as int) as level,
           cast(sum(total_delta) as bigint) as total_chunks,
           cast(sum(processed_delta) as bigint) as processed_chunks,
           cast(sum(error_delta) as bigint) as error_count,
           cast(sum(files_delta) as bigint) as files_processed, count(*) as n_events,
           case when sum(total_delta) > 0
                then round(sum(processed_delta) * 100.0::double / sum(total_delta), 6) end as progress_percent,
           case when sum(processed_delta) > 0
                then round(sum(error_delta)::double / sum(processed_delta), 6) end as error_rate
    from metric_events group by rollup (service, instance_id)""")
def fleet_rollup(spark, folder):
    rolled = ct.fleet_rollup(log(spark, folder))
    return rolled.withColumns({c: F.round(c, 6) for c in ("progress_percent", "error_rate")})


@query("metric_events control_log", f"""
    with totals as (
      select service, instance_id, cast(sum(total_delta) as bigint) as total,
             cast(sum(processed_delta) as bigint) as processed, cast(sum(error_delta) as bigint) as errors,
             cast(sum(files_delta) as bigint) as files,
             arg_max(case when event = 'CHUNK_COMPLETE' then filename else '' end, (ts, event_id))
               filter (event in ('CHUNK_COMPLETE', 'FILE_COMPLETE', 'ERROR')) as file,
             arg_max(error_text, (ts, event_id)) filter (error_text is not null) as last_error,
             min(ts) as boot
      from metric_events group by service, instance_id),
    timed as (
      select *, (epoch_us(now) - epoch_us(boot)) // 1000000 as up
      from totals, (select max(ts) as now from metric_events)),
    sets as (
      select instance_id, max((ts, cmd_id)) as at, arg_max(command, (ts, cmd_id)) as command
      from control_log where command in ('start', 'stop') group by instance_id),
    states as (
      select c.instance_id,
             (coalesce(any_value(s.command), 'stop') = 'start')
               <> (count(*) filter (c.command = 'toggle' and (s.at is null or (c.ts, c.cmd_id) > s.at)) % 2 = 1)
             as enabled
      from control_log c left join sets s using (instance_id) group by c.instance_id)
    select service, instance_id, coalesce(enabled, false) as enabled,
           case when enabled then 'STARTED' else 'STOPPED' end as control_status, files as files_done,
           (select count(distinct filename) from metric_events e
            where e.service = timed.service and e.instance_id = timed.instance_id) as files_total,
           coalesce(nullif(file, ''), 'none') as file,
           processed, total, greatest(total - processed, 0) as pending,
           case when up = 0 then 0.0 else round(processed::double / up::double, 6) end as rate,
           case when errors > processed * 0.1::double then 'ERROR'
                when total > 0 and processed < total then 'PROCESSING' else 'IDLE' end as status,
           (up // 3600)::varchar || 'h ' || (up // 60 % 60)::varchar || 'm' as uptime,
           errors, last_error
    from timed left join states using (instance_id)""")
def status_report(spark, folder):
    events = log(spark, folder)
    totals = ct.beside(ct.instance_totals(events), ct.files_seen(events), ct.INSTANCE)
    totals = ct.beside(totals, co.final_state(view(spark, folder, "control_log")), ["instance_id"])
    return ct.status_report(totals, now_of(events)).select(
        "service", "instance_id", "processing.enabled", F.col("processing.status").alias("control_status"),
        F.col("files.processed").alias("files_done"), F.col("files.total").alias("files_total"),
        F.col("files.current").alias("file"), "chunks.processed", "chunks.total", "chunks.pending",
        F.round("chunks.rate", 6).alias("rate"), "system.status", "system.uptime", "system.errors",
        "system.last_error")


@query("metric_events", """
    select count(distinct filename) filter (event = 'FILE_COMPLETE') as files_processed,
           count(distinct filename) as files_total
    from metric_events""")
def files_processed(spark, folder):
    return ct.files_processed(log(spark, folder))


SNAPSHOT_SQL = f"""
    with firsts as (
      select *, row_number() over (partition by service, instance_id, filename order by ts, event_id) = 1
                and filename is not null as new_file
      from metric_events),
    running as (
      select *,
             cast(sum(total_delta) over w as bigint) as total, cast(sum(processed_delta) over w as bigint) as processed,
             cast(sum(error_delta) over w as bigint) as errors, cast(sum(files_delta) over w as bigint) as files,
             cast(sum(new_file::int) over w as bigint) as files_total,
             last_value(error_text ignore nulls) over w as last_error,
             nullif(last_value(case when event = 'CHUNK_COMPLETE' then filename
                                    when event in ('FILE_COMPLETE', 'ERROR') then '' end ignore nulls) over w, '') as file,
             first_value(ts) over w as boot
      from firsts
      window w as ({BY_INSTANCE} rows between unbounded preceding and current row)),
    timed as (select *, (epoch_us(ts) - epoch_us(boot)) // 1000000 as up from running)
    select event_id, total as total_chunks, processed as processed_chunks, errors, files, files_total,
           case when up = 0 then 0.0 else round(processed::double / up::double, 6) end as rate,
           (up // 3600)::varchar || 'h ' || (up // 60 % 60)::varchar || 'm' as uptime, file, last_error,
           case when event = 'INIT' then 'STARTING' when errors > processed * 0.1::double then 'ERROR'
                when total > 0 and processed < total then 'PROCESSING' else 'IDLE' end as status,
           case event when 'INIT' then 'starting' when 'FILE_COMPLETE' then 'processing' when 'ERROR' then 'error'
                else case when file is null then 'idle' else 'processing' end end as stage,
           greatest(total - processed, 0) as pending, 'http://' || instance_id || ':8080' as url,
           epoch_us(boot) // 1000 as boot_epoch
    from timed"""


@query("metric_events", SNAPSHOT_SQL)
def metrics_snapshots(spark, folder):
    """Events from the running counters, as an instance sends them."""
    return snapshot_columns(ct.snapshot_events(log(spark, folder)))


def snapshot_columns(rows):
    return rows.select(
        "event_id", F.col("totalChunks").alias("total_chunks"), F.col("processedChunks").alias("processed_chunks"),
        F.col("errorCount").alias("errors"), F.col("filesProcessed").alias("files"),
        F.col("filesTotal").alias("files_total"), F.round("processingRate", 6).alias("rate"), "uptime",
        F.col("currentFile").alias("file"), F.col("lastError").alias("last_error"), "status",
        F.col("meta.processingStage").alias("stage"), F.col("pendingMessages").alias("pending"), "url",
        F.col("bootEpoch").alias("boot_epoch"))


# --- keys that are null ------------------------------------------------------

@query("loose_events", f"""
    select event_id, service, instance_id, event,
           cast(sum(total_delta) over w as bigint) as total_chunks,
           cast(sum(processed_delta) over w as bigint) as processed_chunks,
           cast(sum(error_delta) over w as bigint) as error_count,
           cast(sum(files_delta) over w as bigint) as files_processed
    from loose_events
    window w as ({BY_INSTANCE} rows between unbounded preceding and current row)""")
def running_counters_null_keys(spark, folder):
    return ct.running_counters(view(spark, folder, "loose_events")).drop("ts")


@query("loose_control", """
    with runs as (
      select *, sum((command in ('start', 'stop'))::int) over (
               partition by instance_id order by ts, cmd_id) as run
      from loose_control)
    select cmd_id, instance_id,
           (coalesce(first_value(case when command in ('start', 'stop') then command end) over r, 'stop') = 'start')
           <> (sum((command = 'toggle')::int) over r % 2 = 1) as enabled
    from runs
    window r as (partition by instance_id, run order by ts, cmd_id
                 rows between unbounded preceding and current row)""")
def control_state_null_keys(spark, folder):
    return co.control_state(view(spark, folder, "loose_control")).select("cmd_id", "instance_id", "enabled")
