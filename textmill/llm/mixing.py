"""Mixing sources to target weights by cutting hash-ordered prefix sums at each source's budget.

Sources are ranked by code point, null last, and weigh 5, 2, 1, repeating. They
share all words by weight; a source stops at `most` times its own size, and what
it leaves is shared again by weight until no source is above its limit. Then the
documents of a source are put in hash-random order, running word counts are
formed block by block, and the order is cut at the exact budget: whole epochs
first, then documents up to the budget, the one on the cut in part.

Edge cases: null and empty texts have size 0 and nothing is taken from them. A
source without words has target 0. Rows repeated in full are each counted; where
rows agree in id and size, it does not matter which of them comes first. A null
doc_id is ordered by its text. Extra columns are kept by `shown`, and an
empty table gives no rows.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import running_totals, word_count

WEIGHTS = (5, 2, 1)
MOST = 3


def sized(docs: DataFrame) -> DataFrame:
    """Narrow rows of what mixing needs: doc_id, source, size and the random place `spot`."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _spot().alias("spot"))


def _spot():
    seed = F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))
    return F.md5(F.concat(F.lit("mix:"), seed))


def targets(rows: DataFrame, weights=WEIGHTS, most=MOST) -> DataFrame:
    """One row per source: source, source_size, target, by water filling.

    Ordered by limit over weight, a source is at its limit when the level that
    the others share would lift it there; the level is read off running sums.
    The windows see one row per source.
    """
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source")))
    weighed = sources.withColumn("_w", F.get(F.array(*map(F.lit, weights)), (rank - 1) % len(weights)))
    limited = weighed.withColumn("_limit", most * F.col("source_size")).withColumn("_ratio", F.col("_limit") / F.col("_w"))
    everything = Window.partitionBy(F.lit(0))
    earlier = everything.orderBy("_ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(earlier), F.lit(0))) / (
        F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(earlier), F.lit(0))
    )
    levels = limited.withColumn("_level", level)
    shared = levels.withColumn("_shared", F.min(
        F.when(F.col("_ratio") > F.col("_level"), F.struct("_ratio", "_level"))
    ).over(everything)["_level"])
    target = F.least(F.col("_limit").cast("double"), F.coalesce(F.col("_w") * F.col("_shared"), F.lit(0.0)))
    return shared.select("source", "source_size", target.alias("target"))


def mix(rows: DataFrame, weights=WEIGHTS, most=MOST) -> DataFrame:
    """Add source_size, target, taken, epochs (whole passes) and part (words of the last, cut pass).

    `rows` has source, size, spot and doc_id, as from `sized`.
    """
    keyed = rows.withColumn("_source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")))
    about = targets(rows, weights, most).select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("_source"), "source_size", "target",
    )
    placed = running_totals(keyed, "_source", "spot", "size", ("doc_id", "size"), about)
    budget = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - F.col("epochs") * F.col("source_size")
    return (
        placed.withColumn("epochs", whole)
        .withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before"))).cast("long"))
        .withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))
        .drop("_source", "before")
    )


def shown(docs: DataFrame, weights=WEIGHTS, most=MOST) -> DataFrame:
    """The rows of `docs`, each as often as the mix shows it; the columns stay.

    A document that the last pass takes in part is shown whole. Texts move once,
    to the block of their source in which they are ordered.
    """
    packed = docs.select(F.struct(*docs.columns).alias("row"))
    rows = packed.select("row", "row.doc_id", "row.source", "row.text").select(
        "row", "doc_id", "source", word_count(F.col("text")).alias("size"), _spot().alias("spot"),
    )
    copies = F.col("epochs") + (F.col("part") > 0).cast("long")
    mixed = mix(rows, weights, most).select("row", copies.alias("copies")).filter("copies > 0")
    repeated = F.explode(F.array_repeat("row", F.col("copies").cast("int")))
    return mixed.select(repeated.alias("row")).select("row.*")
