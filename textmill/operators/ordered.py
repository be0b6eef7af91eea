"""Values that depend on all earlier rows of a key, for keys of any size.

A plain window would put a whole key into one task. Here a key is cut into blocks
of fixed width in time, each block is summed up in one row, and the sums of the
blocks before are carried into a window that never looks beyond its block. The
block of a row follows from the row alone, so nothing has to be stored: the log is
read twice, once for the sums, which meet as one row per block, and once for the rows,
which are shuffled by (key, block) once.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY, BLOCK = "_key", "_block"

# Width of a block in seconds, or in units of a numeric order column. A key has as
# many blocks as its log is long in time, and a block what a key logs in an hour.
WIDTH = 3600


def _block(log: DataFrame, column: str, width: int) -> Column:
    kind = log.schema[column].dataType
    value = F.col(column)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        value = F.unix_micros(value.cast("timestamp")) / 1_000_000
    # A row without a position comes first, as nulls do.
    return F.coalesce(F.floor(value / width).cast("bigint"), F.lit(-(1 << 62)))


class OrderedLog:
    """A log in blocks. `order` begins with a time or a number and is unique within `keys`.

    Rows whose keys are null belong together, as in a window or a grouping.
    """

    def __init__(self, log: DataFrame, keys: list[str], order: list[str], width: int = WIDTH):
        self.keys, self.order = keys, order
        # One text for all keys: null keys are left out of it, so that it is never null
        # and an ordinary join on it loses nothing.
        self.rows = log.withColumns({
            KEY: F.to_json(F.struct(*[F.col(k).cast("string").alias(k) for k in keys])),
            BLOCK: _block(log, order[0], width),
        })

    def scan(
        self, *, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None,
        previous: dict[str, Column] | None = None, nexts: dict[str, Column] | None = None,
    ) -> "OrderedLog":
        """Add columns and return the log again, in the same blocks.

        sums      running total up to and including the row
        lasts     newest value that is not null, up to and including the row
        previous  newest value that is not null, of the rows before
        nexts     first value that is not null, from the row on
        """
        sums, lasts, previous, nexts = (part or {} for part in (sums, lasts, previous, nexts))
        inputs = {**sums, **lasts, **previous, **nexts}
        position = F.struct(*self.order)
        rows = self.rows.select("*", *[c.alias(f"_in_{name}") for name, c in inputs.items()])

        def known(name):
            return F.when(F.col(f"_in_{name}").isNotNull(), position)

        blocks = rows.groupBy(KEY, BLOCK).agg(
            *[F.sum(f"_in_{n}").alias(f"_of_{n}") for n in sums],
            *[F.max_by(f"_in_{n}", known(n)).alias(f"_of_{n}") for n in {**lasts, **previous}],
            *[F.min_by(f"_in_{n}", known(n)).alias(f"_of_{n}") for n in nexts],
        )
        before, after = self.earlier_blocks(), self.later_blocks()
        carried = blocks.select(
            KEY, BLOCK,
            *[F.sum(f"_of_{n}").over(before).alias(f"_carry_{n}") for n in sums],
            *[F.last(f"_of_{n}", True).over(before).alias(f"_carry_{n}") for n in {**lasts, **previous}],
            *[F.last(f"_of_{n}", True).over(after).alias(f"_carry_{n}") for n in nexts],
        )
        up_to, onward = self.inside()
        earlier = up_to.rowsBetween(Window.unboundedPreceding, -1)
        local = rows.select(
            *self.rows.columns,
            *[F.sum(f"_in_{n}").over(up_to).alias(n) for n in sums],
            *[F.last(f"_in_{n}", True).over(up_to).alias(n) for n in lasts],
            *[F.last(f"_in_{n}", True).over(earlier).alias(n) for n in previous],
            *[F.last(f"_in_{n}", True).over(onward).alias(n) for n in nexts],
        )
        joined = local.join(carried, [KEY, BLOCK])
        done = joined.select(
            *self.rows.columns,
            *[(F.coalesce(n, F.lit(0)) + F.coalesce(f"_carry_{n}", F.lit(0))).alias(n) for n in sums],
            *[F.coalesce(n, f"_carry_{n}").alias(n) for n in {**lasts, **previous, **nexts}],
        )
        return self._with(done)

    def inside(self) -> tuple[Window, Window]:
        """Windows over a block, forwards and backwards, up to and with the row."""
        block = Window.partitionBy(KEY, BLOCK)
        up_to = Window.unboundedPreceding, 0
        return (
            block.orderBy(*self.order).rowsBetween(*up_to),
            block.orderBy(*map(F.desc, self.order)).rowsBetween(*up_to),
        )

    def blocks(self, **values: Column) -> DataFrame:
        """One row per block with aggregates of its rows."""
        return self.rows.groupBy(KEY, BLOCK).agg(*[c.alias(name) for name, c in values.items()])

    def carry(self, blocks: DataFrame) -> "OrderedLog":
        """Add the columns of `blocks`, one row per block, to every row."""
        return self._with(self.rows.join(blocks, [KEY, BLOCK]))

    def filter(self, condition: Column) -> "OrderedLog":
        return self._with(self.rows.filter(condition))

    def keep(self, *columns: str) -> "OrderedLog":
        return self._with(self.rows.select(KEY, BLOCK, *columns))

    def with_columns(self, columns: dict[str, Column]) -> "OrderedLog":
        return self._with(self.rows.withColumns(columns))

    def _with(self, rows: DataFrame) -> "OrderedLog":
        again = object.__new__(OrderedLog)
        again.keys, again.order, again.rows = self.keys, self.order, rows
        return again

    @staticmethod
    def earlier_blocks() -> Window:
        return Window.partitionBy(KEY).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)

    @staticmethod
    def later_blocks() -> Window:
        """Nearest block last; a frame that ends at the last row would be computed anew for every row."""
        return Window.partitionBy(KEY).orderBy(F.desc(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)

    def result(self) -> DataFrame:
        return self.rows.drop(KEY, BLOCK)
