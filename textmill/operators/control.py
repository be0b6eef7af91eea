"""On/off history. A command row has `cmd_id, ts, instance_id, command, reason`."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions.text import not_blank
from textmill.operators.ordered import BLOCK, KEY, OrderedLog

KEYS = ["instance_id"]
ORDER = ["ts", "cmd_id"]

# The reason recorded when a command gives none, and state names.
DEFAULT_REASONS = {
    "start": "Processing enabled via API",
    "stop": "Processing disabled via API",
    "toggle_on": "Processing toggled on via API",
    "toggle_off": "Processing toggled off via API",
}
STARTED, STOPPED = "STARTED", "STOPPED"
CONSUMING, IDLE = "CONSUMING", "IDLE"


def _with_state(commands: DataFrame, keys=KEYS, order=ORDER) -> OrderedLog:
    """Add `enabled` and `previous_enabled`, the state after and before every row, and
    `next_on` and `next_off`, the times from the row on at which it is on and off.
    It starts off. One scan of the log.

    Inside a block all four are found for either state the block may begin in (0: off,
    1: on). With T toggles so far, a set command records its value xor T's parity; a
    later state is the newest such record xor its own parity. A block as a whole sets the
    state, flips it or leaves it, and the same rule over blocks gives the state in which
    each begins.
    """
    command, odd = F.col("command"), lambda count: count % 2 == 1
    log = OrderedLog(commands, keys, order)
    up_to, onward = log.inside()
    toggles = F.sum((command == "toggle").cast("int")).over(up_to)
    log = log.with_columns({"_odd": odd(toggles)})
    record = F.when(command.isin("start", "stop"), (command == "start") != F.col("_odd"))
    log = log.with_columns({"_set": F.last(record, True).over(up_to)})
    for begin in (False, True):
        log = log.with_columns({f"_on{begin:d}": F.coalesce("_set", F.lit(begin)) != F.col("_odd")})
    in_order = up_to.rowsBetween(-1, -1)
    both = {}
    for begin in (0, 1):
        on = F.col(f"_on{begin}")
        both |= {
            f"_was{begin}": F.coalesce(F.last(on).over(in_order), F.lit(bool(begin))),
            f"_next_on{begin}": F.last(F.when(on, F.col("ts")), True).over(onward),
            f"_next_off{begin}": F.last(F.when(~on, F.col("ts")), True).over(onward),
        }
    log = log.with_columns(both)

    position = F.struct(*order)
    ends = {f"_end{b}": F.max_by(f"_on{b}", position) for b in (0, 1)}
    firsts = {f"_first_{to}{b}": F.min_by(f"_next_{to}{b}", position) for to in ("on", "off") for b in (0, 1)}
    blocks = log.blocks(**ends, **firsts)
    earlier, later = log.earlier_blocks(), log.later_blocks()
    up_to_block = earlier.rowsBetween(Window.unboundedPreceding, 0)
    flips = (F.col("_end0") & ~F.col("_end1")).cast("int")
    blocks = blocks.withColumns({
        "_flips": F.sum(flips).over(up_to_block), "_flips_before": F.coalesce(F.sum(flips).over(earlier), F.lit(0)),
    })
    fixed = F.when(F.col("_end0") == F.col("_end1"), F.col("_end0") != odd(F.col("_flips")))
    blocks = blocks.withColumn(
        "_begin", F.coalesce(F.last(fixed, True).over(earlier), F.lit(False)) != odd(F.col("_flips_before")))
    as_begun = lambda name: F.when(F.col("_begin"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    blocks = blocks.select(
        KEY, BLOCK, "_begin",
        *[F.last(as_begun(f"_first_{to}"), True).over(later).alias(f"_later_{to}") for to in ("on", "off")])
    rows = log.carry(blocks).with_columns({
        "enabled": as_begun("_on"), "previous_enabled": as_begun("_was"),
        **{f"next_{to}": F.coalesce(as_begun(f"_next_{to}"), f"_later_{to}") for to in ("on", "off")},
    })
    return rows.keep(*commands.columns, "enabled", "previous_enabled", "next_on", "next_off")


def control_state(commands: DataFrame) -> DataFrame:
    return _with_state(commands).result().select(*KEYS, *ORDER, "command", "enabled")


def _reason(command: Column, enabled: Column, reason: Column) -> Column:
    default = (
        F.when(command == "start", DEFAULT_REASONS["start"])
        .when(command == "stop", DEFAULT_REASONS["stop"])
        .when(enabled, DEFAULT_REASONS["toggle_on"])
        .otherwise(DEFAULT_REASONS["toggle_off"])
    )
    return F.when(not_blank(reason), reason).otherwise(default)


def _transitions(commands: DataFrame) -> OrderedLog:
    """Only commands that really change the state."""
    return _with_state(commands).filter(F.col("enabled") != F.col("previous_enabled"))


def state_transitions(commands: DataFrame) -> DataFrame:
    reason = _reason(F.col("command"), F.col("enabled"), F.col("reason"))
    return _transitions(commands).result().select(
        *KEYS, *ORDER, "command", "previous_enabled", "enabled", reason.alias("reason")
    )


def state_intervals(commands: DataFrame) -> DataFrame:
    """Spans between changes; the last one of an instance is open.

    A span ends when the state is next the other one.
    """
    on = F.col("enabled")
    return _transitions(commands).result().select(
        *KEYS, F.col("ts").alias("from_ts"),
        F.when(on, F.col("next_off")).otherwise(F.col("next_on")).alias("to_ts"),
        F.when(on, STARTED).otherwise(STOPPED).alias("status"),
        F.when(on, CONSUMING).otherwise(IDLE).alias("consumer_status"),
    )


def final_state(commands: DataFrame) -> DataFrame:
    """State of every instance at the end, with its last change; off if it never changed."""
    changed = F.col("enabled") != F.col("previous_enabled")
    reason = _reason(F.col("command"), F.col("enabled"), F.col("reason"))
    newest = F.max_by(
        F.struct("enabled", "ts", reason.alias("reason")), F.when(changed, F.struct(*ORDER))
    )
    last = _with_state(commands).result().groupBy(*KEYS).agg(newest.alias("last"))
    on = F.coalesce("last.enabled", F.lit(False))
    return last.select(
        *KEYS, on.alias("enabled"),
        F.when(on, STARTED).otherwise(STOPPED).alias("control_status"),
        F.when(on, CONSUMING).otherwise(IDLE).alias("consumer_status"),
        F.col("last.ts").alias("last_changed"), F.col("last.reason").alias("last_change_reason"),
    )


def gate_messages(messages: DataFrame, commands: DataFrame) -> DataFrame:
    """Every message with the state in force when it came, and when it may be consumed:
    at once, or as soon as the instance is next on (null: it still waits).

    A message row has `msg_id, ts, instance_id`. At the same time a command acts first.
    """
    position = [F.struct(F.lit(kind).alias("kind"), F.col(c).alias("id")).alias("cmd_id")
                for kind, c in ((0, "cmd_id"), (1, "msg_id"))]
    both = commands.select(*KEYS, "ts", position[0], "command").unionByName(
        messages.select(*KEYS, "ts", position[1], F.lit("message").alias("command"))
    )
    return _with_state(both).result().filter(F.col("command") == "message").select(
        F.col("cmd_id.id").alias("msg_id"), *KEYS, "ts",
        F.when(F.col("enabled"), STARTED).otherwise(STOPPED).alias("status"),
        F.col("next_on").alias("consumed_at"),
    )
