"""Quality rules whose cutoffs come with a bound on how many good documents they reject.

Every rule rejects documents in which a measured rate is above a cutoff. The
cutoffs of a rule are tried from the loosest to the strictest. A cutoff may be
used in a stratum when the labelled good documents of that stratum prove, by an
exact binomial test, that it rejects at most `risk` of the good ones. The tests
of one rule form a fixed sequence that stops at its first failure; across rules
and strata the error `delta` is divided evenly (Bonferroni). The bound holds for each
rule: together the six may reject at most six times `risk` of a stratum's good documents. With too few
labelled documents no cutoff can be proved, and the rule rejects nothing there.

Edge cases: a null or empty text has no words, so it fails the base rule. A null
or unlisted language is the stratum `other`. Labels other than 0 and 1 are
ignored; a document labelled more than once counts as good only if all its
labels say so. Repeated rows are judged alike. Columns beyond those used are kept. An
empty table gives no rows, and without labels there are no cutoffs.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import with_once
from .common import SPACES, WORD, once

SYMBOLS = "#*$%&|<>"
STRATA = ("en", "de", "fr", "es")

# Rates by rule, with the cutoffs to be tried, loosest first.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / n_words", (4.0, 3.0, 2.0, 1.0, 0.5, 0.3, 0.2)),
    "shouts": ("n_marks / n_words", (4.0, 2.0, 1.0, 0.5, 0.3, 0.2)),
    "capitals": ("n_upper / word_chars", (0.9, 0.7, 0.5, 0.4, 0.3)),
    "repeats": ("n_repeat_words / n_words", (0.9, 0.7, 0.5, 0.3, 0.2)),
    "copied_lines": ("n_dup_lines / n_lines", (0.9, 0.7, 0.5, 0.3, 0.2)),
    "long_words": ("word_chars / n_words", (40.0, 20.0, 15.0, 12.0, 10.0)),
}
RISK, DELTA = 0.01, 0.1
MEASURES = ("n_words", "word_chars", "n_symbols", "n_marks", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words")


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def _repeat_words(words: Column) -> Column:
    """Words covered by windows of three words that occur more than once.

    The windows are sorted by their text, so that equal ones are neighbours;
    the places of those are sorted again and their lengths added up without
    counting a word twice.
    """
    count = F.size(words)
    windows = F.sort_array(F.transform(
        F.sequence(F.lit(0), count - 3),
        lambda i: F.struct(
            F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("text"),
            i.alias("at"),
        ),
    ))

    def covered(sorted_windows):
        def twin(j, step):
            return F.coalesce(F.get(sorted_windows, j + step)["text"] == F.get(sorted_windows, j)["text"], F.lit(False))

        places = F.sort_array(F.transform(
            F.filter(F.sequence(F.lit(0), F.size(sorted_windows) - 1), lambda j: twin(j, -1) | twin(j, 1)),
            lambda j: F.get(sorted_windows, j)["at"],
        ))
        return F.aggregate(
            places,
            F.struct(F.lit(0).alias("words"), F.lit(0).alias("end")),
            lambda done, at: F.struct(
                (done["words"] + at + 3 - F.greatest(at, done["end"])).alias("words"),
                (at + 3).alias("end"),
            ),
            lambda done: done["words"],
        )

    return F.when(count < 4, F.lit(0)).otherwise(once(windows, covered))


def measure(docs: DataFrame) -> DataFrame:
    """Add one struct column `measures` of counts; one pass over the text, no shuffle.

    The column comes out of a generator, so that filters on it do not measure again.
    """
    def counts(text):
        words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
        lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
        chars = F.length(text)
        return once(words, lambda w: once(lines, lambda x: F.struct(
            F.size(w).cast("long").alias("n_words"),
            _without(text, SPACES).cast("long").alias("word_chars"),
            (chars - _without(text, SYMBOLS)).cast("long").alias("n_symbols"),
            (chars - _without(text, "!?")).cast("long").alias("n_marks"),
            F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
        )))

    return with_once(docs, "measures", once(F.coalesce(F.col("text"), F.lit("")), counts))


def stratum(strata=STRATA) -> Column:
    return F.when(F.col("lang").isin(*strata), F.col("lang")).otherwise(F.lit("other"))


def base_failed(m: str = "measures") -> Column:
    return (F.col(f"{m}.n_words") < 50) | (100 * F.col(f"{m}.n_repeat_words") > 50 * F.col(f"{m}.n_words"))


def _rate(rule: str, m: str) -> Column:
    above, below = RULES[rule][0].split(" / ")
    return F.try_divide(F.col(f"{m}.{above}"), F.col(f"{m}.{below}"))


def _tail(count: Column, total: Column, risk: float) -> Column:
    """P(Binomial(total, risk) <= count), exact; 1 where count is no less than the mean."""
    step = F.log(F.lit(risk)) - F.log1p(F.lit(-risk))
    sums = F.aggregate(
        F.sequence(F.lit(0).cast("long"), count),
        F.struct((total * F.log1p(F.lit(-risk))).alias("next"), F.lit(0.0).alias("sum")),
        lambda done, i: F.struct(
            F.when(i < total, done["next"] + F.log((total - i) / (i + 1)) + step).otherwise(F.lit(-1e9)).alias("next"),
            (done["sum"] + F.exp(done["next"])).alias("sum"),
        ),
        lambda done: done["sum"],
    )
    return F.when((total == 0) | (count >= total * risk), F.lit(1.0)).otherwise(sums)


def fit(measured: DataFrame, labels: DataFrame, strata=STRATA, risk=RISK, delta=DELTA) -> DataFrame:
    """One row per stratum with the proved cutoffs: stratum, n_good, cut_<rule>.

    `labels` has doc_id and quality; all its rows are used. The result has at
    most len(strata) + 1 rows, whatever the size of the input.
    """
    level = delta / (len(RULES) * (len(strata) + 1))
    marked = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_good"))
    good = (
        measured.filter("doc_id is not null")
        .select("doc_id", stratum(strata).alias("stratum"), "measures")
        .join(marked.filter("_good = 1"), "doc_id")
    )
    above = {
        (rule, i): F.coalesce(F.count_if(_rate(rule, "measures") > cutoff), F.lit(0))
        for rule, (_, cutoffs) in RULES.items() for i, cutoff in enumerate(cutoffs)
    }
    counted = good.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n_good"), *(c.alias(f"_{rule}_{i}") for (rule, i), c in above.items())
    )

    def strictest(rule):
        # Rejections grow with strictness, so the cutoffs that pass are a prefix
        # of the sequence, and the last that passes is the one to use.
        chosen = F.lit(None).cast("double")
        for i, cutoff in enumerate(RULES[rule][1]):
            passed = _tail(F.col(f"_{rule}_{i}"), F.col("n_good"), risk) <= level
            chosen = F.when(passed, F.lit(cutoff)).otherwise(chosen)
        return chosen.alias(f"cut_{rule}")

    return counted.select("stratum", "n_good", *map(strictest, RULES))


def judge(measured: DataFrame, cutoffs: DataFrame, strata=STRATA) -> DataFrame:
    """Add base_failed, broken_rules and kept. `cutoffs` is the result of `fit`."""
    rules = F.array_compact(F.array(*(
        F.when(_rate(rule, "measures") > F.col(f"_cut.cut_{rule}"), F.lit(rule)) for rule in RULES
    )))
    small = cutoffs.select(F.col("stratum").alias("_stratum"), F.struct(*(f"cut_{r}" for r in RULES)).alias("_cut"))
    joined = measured.join(F.broadcast(small), stratum(strata) == F.col("_stratum"), "left")
    judged = joined.withColumn("base_failed", base_failed()).withColumn("broken_rules", rules)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0)).drop("_stratum", "_cut")
