"""How filters overlap, over every order in which they may be applied.

Spark counts the documents of a part by which of the five filters they fail, and
how many of those are labelled good or toxic. A part is then three contingency
tensors of 2x2x2x2x2 (pass or fail along each filter's axis), and each figure of
each step of each order is one contraction: earlier filters select pass, the
step's own filter selects fail, and the others select all. The contractions of
all orders are one einsum over a matrix of selectors per axis.

Edge cases: a null text counts as empty, so it equals empty texts. A null doc_id
comes after every id: such a row fails E where a row with an id has its text, and
null ids do not fail each other; it has no labels. Rows repeated in full are each
counted, and fail E only where a smaller id has their text. A document counts as
good or toxic if any of its labels says so. A null source is the part '', together
with an empty one. Without documents there are no parts and no rows. Columns
beyond doc_id, text and source are not looked at.
"""

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import once, spread_join, stored

FILTERS = "ABCDE"
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
# Parts whose figures are worked out together.
AT_ONCE = 256


def facts(docs: DataFrame) -> DataFrame:
    """Narrow rows: doc_id, part, the verdicts fails_a to fails_d, and the identity `same` of the text."""
    def judged(text):
        words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
        return once(words, lambda w: F.struct(
            (F.size(w) < 50).alias("fails_a"),
            (100 * F.size(F.array_distinct(w)) < 65 * F.size(w)).alias("fails_b"),
            (100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text)).alias("fails_c"),
            text.rlike(r"[#$%&*|]").alias("fails_d"),
            F.unhex(F.sha2(text, 256)).alias("same"),
        ))

    text = F.coalesce(F.col("text"), F.lit(""))
    part = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return docs.select("doc_id", part.alias("part"), judged(text).alias("_facts")).select("doc_id", "part", "_facts.*")


def with_copies(rows: DataFrame) -> DataFrame:
    """Add fails_e: a smaller doc_id has the same text. A text with most of the rows is dealt out."""
    texts = rows.groupBy("same").agg(F.count(F.lit(1)).alias("_n"), F.min("doc_id").alias("_first"))
    several = texts.filter("_n > 1").drop("_n")
    smaller = F.coalesce(F.col("doc_id") > F.col("_first"), F.col("_first").isNotNull())
    return spread_join(rows, several, "same", "doc_id").withColumn("fails_e", smaller).drop("_first")


def counts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents per part and pattern of verdicts (first filter in the highest bit): n, n_good, n_toxic."""
    marked = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("_good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("_toxic"),
    ).filter("_good or _toxic")
    pattern = sum(
        (F.col(f"fails_{name.lower()}").cast("int") * (1 << (len(FILTERS) - 1 - i)) for i, name in enumerate(FILTERS)),
        F.lit(0),
    )
    return rows.join(marked, "doc_id", "left").groupBy("part", pattern.alias("pattern")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("_good"), True)).alias("n_good"),
        F.count(F.when(F.col("_toxic"), True)).alias("n_toxic"),
    )


def steps() -> tuple[list[str], np.ndarray, np.ndarray]:
    """Order and filter number of every step of every order: names, step numbers, filters."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    names = [order for order in orders for _ in FILTERS]
    number = np.tile(np.arange(1, len(FILTERS) + 1), len(orders))
    return names, number, np.array([FILTERS.index(order[i - 1]) for order, i in zip(names, number)])


def selectors() -> dict[str, np.ndarray]:
    """Per figure, what every step selects along every axis: arrays of steps x filters x (pass, fail)."""
    names, number, _ = steps()
    chosen: dict[str, list] = {"kept": [], "removed": [], "failing": [], "unique_fails": []}
    for order, i in zip(names, number):
        earlier, own = order[:i - 1], order[i - 1]
        chosen["removed"].append([FAIL if f == own else PASS if f in earlier else ALL for f in FILTERS])
        chosen["kept"].append([PASS if f == own or f in earlier else ALL for f in FILTERS])
        chosen["failing"].append([FAIL if f == own else ALL for f in FILTERS])
        chosen["unique_fails"].append([FAIL if f == own else PASS for f in FILTERS])
    return {figure: np.array(rows, np.int64) for figure, rows in chosen.items()}


def contracted(tensors: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Contract tensors (part x measure x 2x2x2x2x2) with one selector per axis and step: part x measure x step."""
    return np.einsum("pmabcde,sa,sb,sc,sd,se->pms", tensors, *(chosen[:, axis] for axis in range(len(FILTERS))))


def figures(tensors: np.ndarray) -> dict[str, np.ndarray]:
    """All figures of all steps from tensors of all, good and toxic documents; part x step each."""
    chosen = selectors()
    of = steps()[2]
    removed = contracted(tensors, chosen["removed"])
    every = tensors[:, :1]
    by_filter = removed[:, 0] @ np.eye(len(FILTERS), dtype=np.int64)[of]
    return {
        "kept": contracted(every, chosen["kept"])[:, 0],
        "removed": removed[:, 0],
        "redundant": contracted(every, chosen["failing"])[:, 0] - removed[:, 0],
        "unique_fails": contracted(every, chosen["unique_fails"])[:, 0],
        "good_lost": removed[:, 1],
        "toxic_lost": removed[:, 2],
        "shapley": by_filter[:, of],
    }


def interactions(counted: DataFrame) -> DataFrame:
    """From rows as of `counts` to one row per part, order and step.

    The patterns of a part are at most 32 rows, so a part is one row of arrays
    whatever its size, and parts are worked out side by side.
    """
    cells = F.sort_array(F.collect_list(F.struct("pattern", "n", "n_good", "n_toxic"))).alias("cells")
    packed = counted.groupBy("part").agg(cells).select(
        "part", *(F.col(f"cells.{c}").alias(c) for c in ("pattern", "n", "n_good", "n_toxic")))
    names, number, of = steps()
    letters = [FILTERS[i] for i in of]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), AT_ONCE):
                some = batch.iloc[start:start + AT_ONCE]
                flat = np.zeros((len(some), 3, 1 << len(FILTERS)), np.int64)
                for i, (pattern, *measured) in enumerate(zip(some["pattern"], some["n"], some["n_good"], some["n_toxic"])):
                    flat[i, :, pattern] = np.array(measured).T
                found = figures(flat.reshape(len(some), 3, *(2,) * len(FILTERS)))
                yield pd.DataFrame({
                    "part": np.repeat(some["part"].to_numpy(), len(names)),
                    "filter_order": names * len(some), "step": np.tile(number, len(some)),
                    "filter": letters * len(some), **{name: found[name].ravel() for name in FIGURES},
                })

    schema = "part string, filter_order string, step int, filter string, " + ", ".join(f"{name} long" for name in FIGURES)
    return packed.mapInPandas(run, schema)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step; the texts are read once."""
    rows = stored(facts(docs), "audit-facts")
    return interactions(counts(with_copies(rows), labels))
