"""A stream of log rows, worked on in the order of their times although they arrive late.

Rows of a key wait in its state until the key has been heard of `delay` later; then they
are worked on in order, once, and what the next rows need of them is carried in the state.
So the state of a key holds what it carries and the rows of the last `delay`. A row that
comes later than that is worked on at once, after what was already done. A tick moves the
clock of its key and is nothing else: a key that falls silent needs one to finish.

A key's rows of one batch are sorted in one task, so the source has to bound its batches.
"""

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# A function of the sorted rows and of what was carried so far gives rows and what to carry.
Step = Callable[[pd.DataFrame, dict], tuple[pd.DataFrame, dict]]
AT, TICK = "_at", "_tick"


def with_clock(rows: DataFrame, time: str = "ts") -> DataFrame:
    """Add the event time in microseconds; rows of a log are no ticks."""
    return rows.withColumns({AT: F.unix_micros(F.col(time).cast("timestamp")), TICK: F.lit(False)})


def _pack(frame: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas()


def in_order(rows: DataFrame, keys: list[str], order: list[str], step: Step, output: str, delay: float) -> DataFrame:
    """Keys and `output` of the rows, by `step`. `rows` have a clock; `order` breaks ties of time.

    `delay` is in seconds. Rows without a time are left out. Times are rows of the result as
    `_at` where `output` names it.
    """
    names = [c for c in rows.columns if c not in keys]
    schema = T.StructType([*(T.StructField(k, rows.schema[k].dataType) for k in keys), *T.StructType.fromDDL(output)])
    wanted = [f.name for f in schema]
    width = int(delay * 1_000_000)

    def work(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        carried, clock, waiting = "{}", None, None
        if state.exists:
            carried, clock, waiting = state.get
        frames = [batch[names] for batch in batches if len(batch)]
        if not frames:
            return
        clock = max(int(frame[AT].max()) for frame in frames) if clock is None else max(clock, *(int(f[AT].max()) for f in frames))
        frames = [frame[~frame[TICK].astype(bool)] for frame in frames]
        if waiting:
            frames.insert(0, _unpack(waiting))
        frames = [frame for frame in frames if len(frame)]
        if not frames:
            state.update((carried, clock, b""))
            return
        known = pd.concat(frames, ignore_index=True) if len(frames) > 1 else frames[0]
        known = known.sort_values([AT, *order], kind="stable", ignore_index=True)
        ripe = int(known[AT].searchsorted(clock - width, side="right"))
        later = known.iloc[ripe:].reset_index(drop=True)
        if ripe:
            found, carry = step(known.iloc[:ripe].reset_index(drop=True), json.loads(carried))
            carried = json.dumps(carry)
            if len(found):
                for name, value in zip(keys, key):
                    found[name] = value
                yield found[wanted]
        state.update((carried, clock, _pack(later) if len(later) else b""))

    timed = rows.filter(F.col(AT).isNotNull())
    return timed.groupBy(*keys).applyInPandasWithState(
        work, schema, "carried string, clock bigint, waiting binary", "append", GroupStateTimeout.NoTimeout)
