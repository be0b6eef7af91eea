"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton on folded text.

Folding lower-cases, decomposes, drops accents, turns look-alike letters into
Latin ones and digits and signs used as letters into those letters, and keeps
words of letters with one space between. Lexicon entries are whole words or
beginnings of words; their weights are log ratios of how often they occur in
toxic and in other labelled documents. A match inside an exception phrase does
not count; such phrases are given, or learned as pairs of words that hold a
match but are no more frequent in toxic documents. The summed weight of a text,
as a total and by its length, goes through a logistic curve fitted on the same
labels.

Learning uses at most `size` labelled rows, chosen by a hash of doc_id, and only
those whose crc32(doc_id as text) mod 5 is not 0. Text is the only input of a
score.

Edge cases: a null, empty or wordless text has no matches and gets the score of
such texts. Without toxic labels to learn from the lexicon is empty and every
score is 0. A doc_id with several labels is toxic if one of them says
so; labels other than 0 and 1 are ignored. A null doc_id is never held out and
never learned from. Repeated rows get equal rows, an empty table gives
none; extra columns are ignored.
"""

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, stored

# Look-alike letters and the Latin letters they stand for.
LOOKALIKES = dict(zip(
    "аеорсухіјѕһԁԛԝкмтвнзгαονρτυικεχβηγωσłøđħıæœßþð",
    "aeopcyxijshdqwkmtbheraovptuikexbhywslodhiaesspd",
))
# Digits written for letters, and signs that are so where a letter follows.
SUBSTITUTES = dict(zip("0134578", "oieastb"))
SIGNS = dict(zip("@$!|€", "asiie"))

SAMPLE = 20_000
ENTRIES, PHRASES = 5_000, 1_000
LEAST_DOCS, LEAST_RATIO = 5, 6.0
STEMS = (4, 5, 6)
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

_FOLD = {ord(a): b for a, b in {**LOOKALIKES, **SUBSTITUTES}.items()} | {c: None for c in range(0x300, 0x370)}
_SIGN = re.compile(r"[@$!|€](?=[^\W_])")
_LETTERS = re.compile(r"[^\W\d_]+")


def fold(text: str) -> list[str]:
    """Folded words."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    text = _SIGN.sub(lambda m: SIGNS[m[0]], text)
    return _LETTERS.findall(text.translate(_FOLD))


def entries(words: set[str]) -> set[str]:
    """What a document offers to the lexicon: its words, and beginnings of longer words."""
    return {f" {w} " for w in words if 2 < len(w) < 30} | {f" {w[:n]}" for w in words for n in STEMS if len(w) > n}


class Lexicon:
    """Weights by entry, exception phrases, and the curve from weight to score."""

    def __init__(self, weights: dict[str, float], exceptions=(), curve: tuple[float, float, float] | None = None):
        self.weights, self.exceptions, self.curve = weights, tuple(exceptions), curve
        self._automaton = None

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def matches(self, words: list[str]):
        """(start, weight) of matches in ` w w w `, without those inside exceptions."""
        if not self.weights or not words:
            return []
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                self._automaton.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                self._automaton.add_word(f" {phrase} ", (len(phrase) + 2, None))
            self._automaton.make_automaton()
        found, spared = [], []
        for end, (length, weight) in self._automaton.iter(f" {' '.join(words)} "):
            if weight is None:
                spared.append((end - length + 1, end))
            else:
                found.append((end - length + 1, end, weight))
        if spared:
            # Of the phrases that begin no later than a match, the one that reaches farthest decides.
            spared.sort()
            begins, reach = [s for s, _ in spared], list(accumulate((e for _, e in spared), max))
            before = (bisect_right(begins, m[0]) for m in found)
            found = [m for m, n in zip(found, before) if not (n and reach[n - 1] >= m[1])]
        return [(start, weight) for start, _, weight in found]

    def features(self, words: list[str]) -> tuple[float, float]:
        total = sum(weight for _, weight in self.matches(words))
        return math.log1p(total), math.log1p(1000 * total / max(1, len(words)))

    def score(self, text: str) -> float:
        """0 if nothing was learned."""
        if self.curve is None:
            return 0.0
        a, b = self.features(fold(text))
        z = self.curve[0] + self.curve[1] * a + self.curve[2] * b
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, size=SAMPLE) -> DataFrame:
    """text and toxic (0/1) of at most `size` labels; none of them held out."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    chosen = hashed_sample(usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), size, "doc_id")
    # At most `size` short rows, so the texts stay where they are.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def _counted(sample: DataFrame, offers) -> DataFrame:
    """entry, toxic documents and other documents that offer it; counted per task before the shuffle."""
    def run(batches):
        counts = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic")):
                counts[1 - int(toxic.as_py())].update(offers(text.as_py() or ""))
        names = list(counts[0].keys() | counts[1].keys())
        for i in range(0, len(names), 10_000):
            part = names[i:i + 10_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array([counts[0][n] for n in part], pa.int64()), pa.array([counts[1][n] for n in part], pa.int64())],
                ["entry", "t", "n"],
            )

    return sample.mapInArrow(run, "entry string, t long, n long").groupBy("entry").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))


def learn(docs: DataFrame, labels: DataFrame, size=SAMPLE, exceptions=()) -> Lexicon:
    sample = stored(labelled(docs, labels, size), "labelled")
    totals = {row.toxic: row["count"] for row in sample.groupBy("toxic").count().collect()}
    toxic, other = totals.get(1, 0), totals.get(0, 0)
    if not toxic:
        return Lexicon({}, exceptions)

    ratio = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("n") + 0.5) / (other + 1.0))
    offered = _counted(sample, lambda text: entries(set(fold(text)))).withColumn("w", ratio)
    strong = offered.filter((F.col("t") >= LEAST_DOCS) & (F.col("w") >= math.log(LEAST_RATIO)))
    weights: dict[str, float] = {}
    rows = strong.orderBy(F.desc("t"), "entry").limit(ENTRIES).collect()
    for row in sorted(rows, key=lambda r: (len(r.entry), r.entry)):
        if not any(row.entry[:n + 1] in weights for n in STEMS if n + 1 < len(row.entry)):
            weights[row.entry] = row.w
    lexicon = Lexicon(weights, exceptions)

    def phrases(text):
        words = fold(text)
        place, at = {}, 0
        for i, word in enumerate(words):
            place[at] = i
            at += len(word) + 1
        pairs = set()
        for start, _ in lexicon.matches(words):
            i = place[start]
            pairs |= {" ".join(words[j:j + 2]) for j in (i - 1, i) if 0 <= j < len(words) - 1}
        return pairs

    harmless = _counted(sample, phrases).filter(
        (F.col("n") >= LEAST_DOCS) & (F.col("t") * (other + 1.0) <= F.col("n") * (toxic + 1.0))
    )
    learned = [row.entry for row in harmless.orderBy(F.desc("n"), "entry").limit(PHRASES).collect()]
    lexicon = Lexicon(weights, [*exceptions, *learned])

    def measure(batches):
        for batch in batches:
            pairs = [lexicon.features(fold(text.as_py() or "")) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([p[i] for p in pairs], pa.float64()) for i in range(2)), batch.column("toxic").cast(pa.float64())], ["a", "b", "y"],
            )

    measured = sample.mapInArrow(measure, "a double, b double, y double")
    # Equal rows are counted, and there are at most `size` of them.
    rows = measured.groupBy("a", "b", "y").count().orderBy("a", "b", "y").collect()
    return Lexicon(weights, lexicon.exceptions, fit_curve(*(np.array(c, float) for c in zip(*rows))))


def fit_curve(a, b, y, weight, steps=50, decay=1e-2) -> tuple[float, float, float]:
    """Logistic regression on two features by Newton's method."""
    x = np.stack([np.ones_like(a), a, b], 1)
    beta = np.zeros(3)
    penalty = decay * np.array([1e-3, 1, 1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - penalty * beta
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(bend, slope)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, beta))


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    # At most ENTRIES weights and PHRASES phrases, sent as plain values: workers need no copy of this package.
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.weights, lexicon.exceptions, lexicon.curve))

    def run(batches):
        own = Lexicon(*shared.value)
        for batch in batches:
            scores = [own.score(text.as_py() or "") for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()),
                pa.array([int(s >= 0.5) for s in scores], pa.int32()),
            ], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(run, SCHEMA)
