"""Putting documents into shards of near equal bytes, with equal texts together.

Groups of equal texts are placed longest first, each on the least loaded shard
of a heap. The groups are first counted by size: the scheduler sees one row per
distinct group size, of which n bytes can have at most sqrt(2 n), and places all
groups of a size in one step that ends as placing them one by one would. So it
streams over a short sorted list and keeps one load per shard. A group finds its
shard by its rank among the groups of its size, and a document its slot by its
rank in the shard; both ranks are prefix sums over blocks of a hash order.

Edge cases: a null text counts as empty (8 bytes), and null and empty texts are
one group. A group larger than a fair share fills its shard alone. Repeated rows
are members of the same group and get slots of their own. An empty table gives no
rows. Columns beyond doc_id and text are ignored by `described`, which fixes those of `shard`.
"""

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import running_totals

SHARDS = 24
OVERHEAD = 8


def described(docs: DataFrame) -> DataFrame:
    """Narrow rows: doc_id, size, text_crc32, and the identity `same` of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("same"),
    )


def place(loads: list[tuple[int, int]], size: int, count: int) -> dict[int, int]:
    """Put `count` groups of `size` on a heap of (load, shard); groups by shard.

    Each shard first gets the groups that keep it strictly below the level where
    all are even, at once; the few that remain go through the heap one by one.
    """
    given: dict[int, int] = {}
    if count > 2 * len(loads):
        low = sorted(loads)
        total, level = 0, 0
        for i, (load, _) in enumerate(low, 1):
            total += load
            level = (total + size * count) // i
            if i == len(low) or level <= low[i][0]:
                break
        for i, (load, shard) in enumerate(low):
            n = max(0, (level - load) // size - 1)
            given[shard] = n
            low[i] = (load + n * size, shard)
        loads[:] = low
        heapq.heapify(loads)
    for _ in range(count - sum(given.values())):
        load, shard = loads[0]
        heapq.heapreplace(loads, (load + size, shard))
        given[shard] = given.get(shard, 0) + 1
    return {shard: n for shard, n in given.items() if n}


def schedule(sizes: DataFrame, shards=SHARDS) -> DataFrame:
    """Longest processing time first over rows (group_size, groups): which ranks of a size go where."""
    def assign(batches):
        loads = [(0, shard) for shard in range(shards)]
        for batch in batches:
            out = []
            for size, count in zip(batch["group_size"].tolist(), batch["groups"].tolist()):
                start = 0
                for shard, n in sorted(place(loads, size, count).items()):
                    out.append((size, start, start + n, shard))
                    start += n
            yield pd.DataFrame(out, columns=["group_size", "first", "end", "shard"])

    ordered = sizes.coalesce(1).sortWithinPartitions(F.desc("group_size"))
    return ordered.mapInPandas(assign, "group_size long, first long, end long, shard int")


def shard(rows: DataFrame, shards=SHARDS) -> DataFrame:
    """Add group_size, shard and slot to rows as from `described`."""
    groups = rows.groupBy("same").agg(F.sum("size").alias("group_size")).withColumn("_one", F.lit(1))
    ranked = running_totals(groups, "group_size", "same", "_one")
    plan = schedule(groups.groupBy("group_size").agg(F.count(F.lit(1)).alias("groups")), shards)
    ranges = plan.groupBy("group_size").agg(F.sort_array(F.collect_list(F.struct("first", "end", "shard"))).alias("_ranges"))
    homes = ranked.join(ranges, "group_size").select(
        "same", "group_size",
        F.get(F.filter("_ranges", lambda r: (r["first"] <= F.col("before")) & (F.col("before") < r["end"])), F.lit(0))["shard"].alias("shard"),
    )
    placed = rows.join(homes, "same").withColumn("_one", F.lit(1)).withColumn(
        "_spot", F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "same")),
    )
    slotted = running_totals(placed, "shard", "_spot", "_one", ("doc_id",))
    return slotted.withColumnRenamed("before", "slot").drop("_one", "_spot")
