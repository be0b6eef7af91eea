"""Messages that wait while their instance is off, and go on in order when it is on again.

Messages and commands of an instance are worked on in order (`inorder`). The state knows
whether the instance is on and the number of the span it is in, from one change to the
next; it does not hold the messages that wait. These are rows of the table `decided` with
the number of their span, so however many wait, the state stays small. When an instance
comes on, a row in `releases` ends the span, and the batch that wrote it hands on the
messages that were waiting in it, together with those that came while it was on.
"""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.operators.control import KEYS, STARTED, STOPPED
from textmill.operators.counters import beside
from textmill.sources.files import folder_exists
from textmill.streaming.inorder import AT, TICK, in_order, with_clock
from textmill.streaming.sinks import BATCH, run_available

COMMAND, MESSAGE, RELEASE = 0, 1, 2
_OUTPUT = f"kind int, msg_id string, {AT} bigint, enabled boolean, span bigint"


def together(messages: DataFrame, commands: DataFrame, ticks: DataFrame | None = None) -> DataFrame:
    """Messages (`msg_id, ts, instance_id`) and commands (`cmd_id, ts, instance_id, command`) as one log.

    Ids of both are texts in it; `_number` orders ids that are numbers.
    """
    def rows(frame, kind, id_column, command):
        named = F.col(id_column).cast("string")
        number = F.coalesce(named.try_cast("bigint"), F.lit(0).cast("bigint"))
        return with_clock(frame).select(
            *KEYS, AT, TICK, F.lit(kind).alias("kind"), number.alias("_number"), F.coalesce(named, F.lit("")).alias("id"),
            command.alias("command"))

    both = rows(commands, COMMAND, "cmd_id", F.coalesce("command", F.lit(""))).unionByName(
        rows(messages, MESSAGE, "msg_id", F.lit("")))
    if ticks is None:
        return both
    nothing = with_clock(ticks).withColumn(TICK, F.lit(True)).select(
        *KEYS, AT, TICK, F.lit(COMMAND).alias("kind"), F.lit(0).cast("bigint").alias("_number"), F.lit("").alias("id"), F.lit("").alias("command"))
    return both.unionByName(nothing)


def _decide(rows: pd.DataFrame, carried: dict) -> tuple[pd.DataFrame, dict]:
    """The switch after every row, and the span: changes so far. An instance starts off, in span 0."""
    on, span = bool(carried.get("on", False)), int(carried.get("span", 0))
    places, states, spans, releases = [-1], [on], [span], []
    times = rows[AT].to_numpy()
    acts = rows.index[(rows["kind"] == COMMAND) & rows["command"].isin(["start", "stop", "toggle"])]
    for place, command in zip(acts, rows.loc[acts, "command"]):
        after = not on if command == "toggle" else command == "start"
        if after == on:
            continue
        if after:
            releases.append((int(times[place]), span))
        on, span = after, span + 1
        places.append(place)
        states.append(on)
        spans.append(span)
    said = rows[rows["kind"] == MESSAGE]
    known = np.searchsorted(places, said.index.to_numpy(), side="right") - 1
    decided = pd.DataFrame({
        "kind": MESSAGE, "msg_id": said["id"].to_numpy(), AT: said[AT].to_numpy(),
        "enabled": np.array(states)[known], "span": np.array(spans)[known]})
    ended = pd.DataFrame({
        "kind": RELEASE, "msg_id": "", AT: [at for at, _ in releases], "enabled": True, "span": [s for _, s in releases]})
    parts = [part for part in (decided, ended) if len(part)]
    return (pd.concat(parts, ignore_index=True) if parts else decided), {"on": on, "span": span}


def gate(log: DataFrame, delay: float) -> DataFrame:
    """Decided messages and the ends of spans, of a stream as from `together`; late rows within `delay` seconds count in order."""
    return in_order(log, KEYS, ["kind", "_number", "id"], _decide, _OUTPUT, delay)


def _folder(path: str, kind: str, batch_id: int) -> str:
    return f"{path}/{kind}/{BATCH}={batch_id}"


def _read(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    folder = f"{path}/{kind}"
    if not folder_exists(spark, folder):
        return spark.createDataFrame([], f"{schema}, {BATCH} bigint")
    return spark.read.schema(f"{schema}, {BATCH} bigint").parquet(folder)


_DECIDED = f"instance_id string, msg_id string, {AT} bigint, enabled boolean, span bigint"
_RELEASES = "instance_id string, span bigint, released bigint"


def gate_sink(path: str, then: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` sink: folders of the batch below `decided`, `releases` and `consumed`.

    `then` is given the messages consumed in the batch, in order. Waiting messages are read
    of the spans that ended only; a span's number is a column the scan is filtered by.
    """

    def write(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        rows = rows.persist()
        try:
            rows.filter(F.col("kind") == MESSAGE).select(*KEYS, "msg_id", AT, "enabled", "span").sortWithinPartitions(
                "span").write.mode("overwrite").parquet(_folder(path, "decided", batch_id))
            ended = rows.filter(F.col("kind") == RELEASE).select(*KEYS, "span", F.col(AT).alias("released"))
            ended.write.mode("overwrite").parquet(_folder(path, "releases", batch_id))
        finally:
            rows.unpersist()
        ended = _read(spark, path, "releases", _RELEASES).filter(F.col(BATCH) == batch_id).drop(BATCH)
        decided = _read(spark, path, "decided", _DECIDED).filter(F.col(BATCH) <= batch_id)
        bounds = ended.agg(F.min("span").alias("low"), F.max("span").alias("high")).first()
        at_once = decided.filter((F.col(BATCH) == batch_id) & F.col("enabled")).withColumn("released", F.col(AT))
        held = decided.filter(~F.col("enabled") & F.col("span").between(bounds.low, bounds.high)) if bounds.low is not None else decided.limit(0)
        let_go = beside(held, ended, [*KEYS, "span"]).filter("released is not null")
        consumed = at_once.unionByName(let_go).select(*KEYS, "msg_id", AT, F.col("released").alias("consumed_at"))
        consumed.sort("consumed_at", AT, "msg_id").write.mode("overwrite").parquet(_folder(path, "consumed", batch_id))
        if then is not None:
            then(_read(spark, path, "consumed", f"instance_id string, msg_id string, {AT} bigint, consumed_at bigint").filter(
                F.col(BATCH) == batch_id).drop(BATCH), batch_id)

    return write


def stream_gate(log: DataFrame, path: str, checkpoint: str, delay: float,
                then: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Work on what there is of `log`, and return the decisions so far."""
    run_available(gate(log, delay).writeStream.outputMode("append").foreachBatch(gate_sink(path, then)), checkpoint)
    return read_gate(log.sparkSession, path)


def read_gate(spark: SparkSession, path: str) -> DataFrame:
    """As `control.gate_messages`, of the messages decided so far; `consumed_at` is null while they wait."""
    decided = _read(spark, path, "decided", _DECIDED).drop(BATCH)
    ends = _read(spark, path, "releases", _RELEASES).drop(BATCH)
    time = F.timestamp_micros(F.when(F.col("enabled"), F.col(AT)).otherwise(F.col("released")))
    return beside(decided, ends, [*KEYS, "span"]).select(
        "msg_id", *KEYS, F.timestamp_micros(F.col(AT)).alias("ts"),
        F.when(F.col("enabled"), STARTED).otherwise(STOPPED).alias("status"), time.alias("consumed_at"))
