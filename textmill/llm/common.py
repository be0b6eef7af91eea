"""What the operators share: word rules, stored intermediates, and prefix sums without a global order."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import new_folder

# A word is a run of characters other than the six ASCII white space characters.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    The result is computed once, has no lineage to repeat, and survives the
    executors that made it.
    """
    spark = df.sparkSession
    folder = new_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def once(value, use):
    """`use(value)` with `value` evaluated once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_count(text):
    """Words of a text; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hashed_sample(rows: DataFrame, size: int, *by: str) -> DataFrame:
    """At most `size` rows, those with the smallest hashes of the columns `by`.

    Rows are counted first and filtered by a bound on the hash that leaves little
    more than `size` of them, so tasks do not each hand over `size` rows.
    """
    n = rows.count()
    share = min(1.0, (1.25 * size + 50) / max(1, n))
    bound = min((1 << 63) - 1, int(-(1 << 63) + share * (1 << 64)))
    hashed = rows.withColumn("_hash", F.xxhash64(*by)).filter(F.col("_hash") <= bound)
    return hashed.orderBy("_hash", *by).limit(size).drop("_hash")


def running_totals(rows: DataFrame, key: str, spot: str, amount: str, ties=(), about: DataFrame | None = None) -> DataFrame:
    """Add `before`, the sum of `amount` over the earlier rows of the same `key`.

    `spot` is a hexadecimal digest that puts the rows of a key in random order;
    rows of equal spot are ordered by `ties`. Three digits of the digest cut a
    key's range into 4,096 even blocks, which are summed before any row moves,
    so a key with most of the rows is spread over the cluster and only sums of
    blocks meet. `about` has more columns for a key, joined at the block sums.
    """
    cut = rows.withColumn("_block", F.substring(spot, 1, 3))
    sums = cut.groupBy(key, "_block").agg(F.sum(amount).alias("_sum"))
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(key, "_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    if about is not None:
        starts = starts.join(about, key)
    inside = Window.partitionBy(key, "_block").orderBy(spot, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.join(starts, [key, "_block"])
        .withColumn("before", F.col("_start") + F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .drop("_block", "_start")
    )


def spread_join(rows: DataFrame, about: DataFrame, key: str, by: str, parts: int = 64) -> DataFrame:
    """Left join of `rows` with `about`, which has one row per `key`, where a key may hold most of the rows.

    A key's rows are dealt over `parts` by a hash of their column `by`, and the row
    of `about` is repeated for the parts that the key has, so at most `parts` times.
    """
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int"))
    present = dealt.select(key, "_part").distinct()
    return dealt.join(present.join(about, key), [key, "_part"], "left").drop("_part")
