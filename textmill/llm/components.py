"""Connected components by repeated contraction."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """From links `a, b` (long) to one row per linked node: node, root.

    In each round every node moves to the smallest node among itself and its
    neighbours, by a hash of the node, and links are redrawn between the nodes
    moved to; the hash keeps the rounds logarithmic whatever the chain of ids.
    A round is stored in the shared folder. Minima are formed before the
    shuffle, and joins on a node with many links are split by Spark.
    """
    def order(c):
        return F.struct(F.xxhash64(F.lit("order"), c).alias("h"), F.col(c).alias("v"))

    moves = None
    while True:
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moved = stored(
            both.groupBy(F.col("a").alias("node"))
            .agg(F.min(order("b")).alias("m"))
            .select("node", F.least(order("node"), "m")["v"].alias("root")), "moves",
        )
        if moves is None:
            moves = moved
        else:
            step = moved.select(F.col("node").alias("root"), F.col("root").alias("_next"))
            moves = stored(
                moves.join(step, "root", "left").select("node", F.coalesce("_next", "root").alias("root")), "moves",
            )
        ends = links
        for c in ("a", "b"):
            ends = ends.join(moved.select(F.col("node").alias(c), F.col("root").alias(f"_{c}")), c)
        links = stored(
            ends.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).filter("a <> b").distinct(), "links",
        )
        if links.isEmpty():
            return moves
