"""Quality rules, mixing, sharding and byte-level BPE against plain loops."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken

from textmill.llm import bpe, mixing, quality, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = [
    None, "", " \t\n", "one", "a b c a b c a b", "x x x x x", "  café 日本 \U0001f600 <b>#1</b>",
    "same line\nsame line\n\n \nsame line\nother", "a\x0bb\x0cc\rd\x1ce", "word " * 30_000, "a" * 100_000,
    "don't  stop\n\n  12345 it's", "<|endoftext|> plain", "tab\there\r\nthere",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "de", None, "xx")[i % 4], (None, "b", "a", "é")[i % 4], None) for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[4], (None, "a null id here", None, None, 3), (None, "a null id here", None, None, 3)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def plain_measures(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("which", ["docs", "table"])
def test_measures(request, which):
    data = request.getfixturevalue(which)
    for row in quality.measure(data).collect():
        m = row.measures
        assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words) == plain_measures(row.text)


def test_exact_tail(spark):
    cases = [(0, 600, 0.01), (3, 900, 0.01), (5, 1000, 0.01), (20, 1000, 0.01), (0, 0, 0.01), (7, 4000, 0.005)]
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(i, k, n) for i, (k, n, _) in enumerate(cases)], "i int, k long, n long")
    for i, (k, n, p) in enumerate(cases):
        found = frame.filter(f"i = {i}").select(quality._tail(F.col("k"), F.col("n"), p)).first()[0]
        exact = sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)) if n and k < n * p else 1.0
        assert found == pytest.approx(exact, rel=1e-9)


def test_cutoffs_are_proved(spark):
    good = "word" + " another plain word" * 30
    junk = "wo%%%rd" + " ano###ther pl$$$ain wo&&&rd" * 30
    rows = [(i, junk if i % 10 == 0 else f"{good} {i}", "en", "s", 1) for i in range(2000)]
    labels = spark.createDataFrame([(i, int(i % 10 != 0)) for i in range(2000)], "doc_id long, quality int")
    measured = quality.measure(spark.createDataFrame(rows, DOCS))
    loose = [r for r in quality.RULES if r not in ("symbols", "repeats")]
    cutoffs = quality.fit(measured, labels).first().asDict()
    assert cutoffs["stratum"] == "en" and cutoffs["n_good"] == 1800 and cutoffs["cut_symbols"] == 0.2
    assert all(cutoffs[f"cut_{r}"] is not None for r in loose)
    few = quality.fit(measured.filter("doc_id < 400"), labels)
    assert few.first().cut_symbols is None
    bad = labels.filter("doc_id % 10 = 0").selectExpr("doc_id", "1 quality").union(labels.filter("doc_id % 10 != 0"))
    assert quality.fit(measured, bad).first().cut_symbols == 3.0
    judged = quality.judge(measured, quality.fit(measured, labels))
    verdicts = {(r.doc_id % 10 == 0, r.symbols) for r in judged.selectExpr("doc_id", "array_contains(broken_rules, 'symbols') symbols").collect()}
    assert verdicts == {(True, True), (False, False)}


def test_rules_without_labels_or_rows(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    measured = quality.measure(docs)
    judged = quality.judge(measured, quality.fit(measured, labels)).collect()
    assert len(judged) == docs.count() and all(r.kept is (not r.base_failed) for r in judged)
    empty = quality.measure(docs.limit(0))
    assert quality.judge(empty, quality.fit(empty, labels)).count() == 0


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), float(sum(sizes.values())), set(order)
    for _ in range(100):
        total = sum(weight[s] for s in open_)
        if left <= 1e-9 or not total:
            break
        for s in open_:
            target[s] += left * weight[s] / total
        left = sum(max(0, target[s] - most * sizes[s]) for s in open_)
        full = {s for s in open_ if target[s] >= most * sizes[s]}
        target.update({s: float(most * sizes[s]) for s in full})
        open_ -= full
    return target


@pytest.mark.parametrize("which", ["docs", "table"])
def test_mix(request, which):
    data = request.getfixturevalue(which)
    mixed = mixing.mix(mixing.sized(data)).collect()
    assert Counter((r.doc_id, r.size) for r in mixed) == Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in data.collect())
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in mixed:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    expected = plain_targets(sizes)
    for r in mixed:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(expected[r.source])
    assert all(taken[s] == round(expected[s]) for s in sizes)
    again = mixing.mix(mixing.sized(data.repartition(5))).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r.size, r.taken)
    assert sorted(map(key, mixed)) == sorted(map(key, again))
    assert mixing.mix(mixing.sized(data.limit(0))).count() == 0


@pytest.mark.parametrize("which", ["docs", "table"])
def test_shards(request, which):
    data = request.getfixturevalue(which)
    rows = sharding.shard(sharding.described(data)).toPandas()
    texts = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in data.collect())
    ids = rows.doc_id.astype(object).where(rows.doc_id.notna(), None)
    assert Counter(zip((None if i is None else int(i) for i in ids), rows["size"], rows.text_crc32)) == texts
    assert (rows.groupby("same").shard.nunique() == 1).all() and rows["shard"].between(0, 23).all()
    for _, part in rows.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    groups = rows.groupby("same")["size"].sum().sort_values(ascending=False)
    loads = [0] * 24
    for size in groups:
        loads[loads.index(min(loads))] += size
    found = rows.groupby("shard")["size"].sum().reindex(range(24), fill_value=0)
    assert sorted(found) == sorted(loads)
    assert sharding.shard(sharding.described(data.limit(0))).count() == 0


def test_equal_sizes_at_once():
    for loads, size, count in (([0] * 24, 5, 1000), ([3, 50, 7, 1000], 4, 333), ([0, 10**9], 1, 10_000), ([5, 5], 9, 3)):
        slow = sorted(loads)
        for _ in range(count):
            slow[0] += size
            slow.sort()
        heap = [(load, i) for i, load in enumerate(loads)]
        heap.sort()
        given = sharding.place(heap, size, count)
        assert sum(given.values()) == count and sorted(load for load, _ in heap) == slow


PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {token: i for i, token in enumerate(bpe.read_ranks(PATH))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_every_token_encodes_to_itself():
    tokens = bpe.read_ranks(PATH)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=bpe.model_bytes(tokens))
    assert model.encode([bpe.to_characters(t) for t in tokens], num_threads=1) == [[i] for i in range(len(tokens))]


@pytest.mark.parametrize("which", ["docs", "table"])
def test_bpe(request, library, which):
    data = request.getfixturevalue(which)
    rows = bpe.digests(data, PATH, public_tokenizers.PATTERN).collect()
    expected = Counter()
    for r in data.collect():
        ids = library.encode_ordinary(r.text or "")
        expected[
            r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256((r.text or "").encode()).hexdigest(),
        ] += 1
    assert Counter(map(tuple, rows)) == expected
    back = bpe.round_trip(data, PATH, public_tokenizers.PATTERN)
    assert back.columns == data.columns
    assert Counter(r.text for r in back.collect()) == Counter(r.text or "" for r in data.collect())
    assert bpe.digests(data.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_ids_column(docs, library):
    for r in bpe.encoded(docs, PATH, public_tokenizers.PATTERN).collect():
        assert r.ids == library.encode_ordinary(r.text or "")
