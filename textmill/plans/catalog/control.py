"""Queries over the control log."""

from pyspark.sql import functions as F

from textmill.operators import control as co
from textmill.operators import counters as ct
from textmill.plans.catalog.metrics import timed
from textmill.plans.catalog.registry import query
from textmill.plans.catalog.sql import ISO
from textmill.plans.views import view

# The state after every command, by runs that begin at a start or stop.
STATES = """
    runs as (
      select *, sum((command in ('start', 'stop'))::int) over (
               partition by instance_id order by ts, cmd_id) as run
      from control_log),
    states as (
      select *,
             (coalesce(first_value(case when command in ('start', 'stop') then command end) over r, 'stop') = 'start')
             <> (sum((command = 'toggle')::int) over r % 2 = 1) as enabled
      from runs
      window r as (partition by instance_id, run order by ts, cmd_id
                   rows between unbounded preceding and current row)),
    changes as (
      select * from (
        select *, lag(enabled, 1, false) over (partition by instance_id order by ts, cmd_id) as before
        from states)
      where enabled <> before)"""


@query("control_log", f"""
    with {STATES}
    select cmd_id, instance_id, {ISO('ts')} as ts, command, enabled from states""")
def control_state(spark, folder):
    return timed(co.control_state(view(spark, folder, "control_log")), "ts")


@query("control_log", f"""
    with {STATES}
    select cmd_id, instance_id, {ISO('ts')} as ts, command, before as previous_enabled, enabled,
           case when trim(reason) <> '' then reason
                when command = 'start' then 'Processing enabled via API'
                when command = 'stop' then 'Processing disabled via API'
                when enabled then 'Processing toggled on via API'
                else 'Processing toggled off via API' end as reason
    from changes""")
def state_transitions(spark, folder):
    return timed(co.state_transitions(view(spark, folder, "control_log")), "ts")


@query("control_log", f"""
    with {STATES}
    select instance_id, {ISO('ts')} as from_ts,
           {ISO('lead(ts) over (partition by instance_id order by ts, cmd_id)')} as to_ts,
           case when enabled then 'STARTED' else 'STOPPED' end as status,
           case when enabled then 'CONSUMING' else 'IDLE' end as consumer_status
    from changes""")
def state_intervals(spark, folder):
    return timed(co.state_intervals(view(spark, folder, "control_log")), "from_ts", "to_ts")


@query("metric_events control_log", """
    with log as (
      select event_id, ts, instance_id, 0 as seq, event, filename, error_text,
             total_delta, processed_delta, error_delta, files_delta from metric_events
      union all
      select cmd_id, ts, instance_id, 1, 'RESET', null, null, 0, 0, 0, 0
      from control_log where command = 'reset'),
    grouped as (
      select *, sum((event = 'RESET')::int) over (
               partition by instance_id order by ts, event_id, seq) as life
      from log)
    select event_id, instance_id, seq, event,
           cast(sum(total_delta) over w as bigint) as total_chunks,
           cast(sum(processed_delta) over w as bigint) as processed_chunks,
           cast(sum(error_delta) over w as bigint) as error_count,
           cast(sum(files_delta) over w as bigint) as files_processed,
           nullif(last_value(case when event = 'CHUNK_COMPLETE' then filename
                                  when event in ('FILE_COMPLETE', 'ERROR') then '' end ignore nulls)
                  over w, '') as current_file,
           last_value(error_text ignore nulls) over w as last_error
    from grouped
    window w as (partition by instance_id, life order by ts, event_id, seq
                 rows between unbounded preceding and current row)""")
def counters_since_reset(spark, folder):
    """The metrics log with the reset commands of the control log in it."""
    nothing = {name: F.lit(0).cast("bigint") for name in ct.COUNTERS.values()}
    events = view(spark, folder, "metric_events").drop("service").withColumn("seq", F.lit(0))
    resets = view(spark, folder, "control_log").filter("command = 'reset'").select(
        F.col("cmd_id").alias("event_id"), "ts", "instance_id", F.lit(1).alias("seq"),
        F.lit(ct.RESET_EVENT).alias("event"), *[c.alias(n) for n, c in nothing.items()])
    both = events.unionByName(resets, allowMissingColumns=True)
    return ct.counters_since_reset(both, ["instance_id"], ["ts", "event_id", "seq"]).drop("ts")


GATE_SQL = f"""
    with {STATES},
    messages as (select event_id as msg_id, ts, instance_id from metric_events where event = 'CHUNK_COMPLETE'),
    marks as (
      select instance_id, ts, cmd_id as id, 0 as kind, enabled from states
      union all select instance_id, ts, msg_id, 1, null from messages),
    filled as (
      select *, coalesce(last_value(enabled ignore nulls) over (
                 partition by instance_id order by ts, kind, id
                 rows between unbounded preceding and current row), false) as state
      from marks),
    next_on as (
      select *, min(case when state then ts end) over (
               partition by instance_id order by ts, kind, id
               rows between current row and unbounded following) as consumed
      from filled)
    select id as msg_id, instance_id, {ISO('ts')} as ts,
           case when state then 'STARTED' else 'STOPPED' end as status, {ISO('consumed')} as consumed_at
    from next_on where kind = 1"""


@query("control_log metric_events", GATE_SQL)
def gate_messages(spark, folder):
    """Chunk events as the messages that have to pass the switch."""
    messages = view(spark, folder, "metric_events").filter("event = 'CHUNK_COMPLETE'").select(
        F.col("event_id").alias("msg_id"), "ts", "instance_id")
    gated = co.gate_messages(messages, view(spark, folder, "control_log"))
    return timed(gated, "ts", "consumed_at")
