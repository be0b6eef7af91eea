"""Embedding and search against brute force."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textmill.functions.vectors import cosine_distance
from textmill.operators import codes as co
from textmill.operators import embedding as em
from textmill.operators import lists as li
from textmill.operators import search as se


def frame(spark, matrix, name, ids=None):
    ids = range(len(matrix)) if ids is None else ids
    kind = "string" if isinstance(ids[0], str) else "long"
    rows = [(i, [float(x) for x in v]) for i, v in zip(ids, matrix)]
    return spark.createDataFrame(rows, f"{name} {kind}, embedding array<float>")


def brute(vectors, queries, k, ids):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    with np.errstate(invalid="ignore"):
        far = np.round(1 - unit(queries) @ unit(vectors).T, 9)
    far = np.where(np.isnan(far), 9.0, far)
    return {q: sorted(ids, key=lambda i: (far[q][ids.index(i)], i))[:k] for q in range(len(queries))}


def found(rows, key="query_id"):
    result = {}
    for row in sorted(rows.collect(), key=lambda r: (r[key], r["rank"])):
        result.setdefault(row[key], []).append(row["id"])
    return result


@pytest.fixture(scope="module")
def data():
    made = np.random.default_rng(1)
    vectors = made.integers(-2, 3, (400, 8)).astype(float)
    vectors[100:240] = vectors[7]  # a third are copies
    vectors[300] = 0  # no direction
    return vectors, made.integers(-2, 3, (9, 8)) + 0.5


@pytest.mark.parametrize("blocks", [(1024, 4096), (2, 37)])
@pytest.mark.parametrize("text_ids", [False, True])
def test_top_k_batch(spark, data, monkeypatch, blocks, text_ids):
    monkeypatch.setattr(se, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(se, "VECTOR_BLOCK", blocks[1])
    vectors, queries = data
    ids = [f"v{'x' * (i % 3)}{i}" if text_ids else i for i in range(len(vectors))]
    rows = se.top_k_batch(
        frame(spark, vectors, "id", ids).repartition(6), frame(spark, queries, "query_id"), 12, 8)
    assert found(rows) == brute(vectors, queries, 12, ids)


def test_more_wanted_than_there_are(spark, data):
    vectors, queries = data
    rows = se.top_k_batch(frame(spark, vectors, "id"), frame(spark, queries, "query_id"), 1000, 8)
    assert {q: len(hits) for q, hits in found(rows).items()} == {q: 400 for q in range(9)}


def test_rounds_of_queries(spark, data, monkeypatch):
    vectors, queries = data
    monkeypatch.setattr(se, "QUERY_BLOCK", 2)
    blocks = se._packed(frame(spark, queries, "query_id"), "query_id", 8, 2)
    parts = se.in_rounds(blocks, 300)
    assert len(parts) >= 3 and sum(part.count() for part in parts) == blocks.count()
    monkeypatch.setattr(se.in_rounds, "__defaults__", (300,))
    rows = se.top_k_batch(frame(spark, vectors, "id"), frame(spark, queries, "query_id"), 7, 8)
    assert found(rows) == brute(vectors, queries, 7, list(range(len(vectors))))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") >= 3


def test_approximate_search(spark):
    made = np.random.default_rng(2)
    vectors, queries = made.standard_normal((500, 16)), made.standard_normal((20, 16))
    index = se.with_bucket(frame(spark, vectors, "id"), dim=16)
    asked = frame(spark, queries, "query_id")
    exact = brute(vectors, queries, 5, list(range(500)))
    everywhere = se.approx_top_k(index, asked, 5, share=1.0, dim=16)
    assert found(everywhere) == exact
    near = found(se.approx_top_k(index, asked, 5, dim=16))
    hits = sum(len(set(near.get(q, [])) & set(exact[q])) for q in exact)
    assert hits / 100 >= 0.9


def clustered(n, clusters, dim, seed):
    made = np.random.default_rng(seed)
    centres = made.standard_normal((clusters, dim))
    return centres[made.integers(0, clusters, n)] + 0.35 * made.standard_normal((n, dim))


def scanned(found_rows):
    """Rows that the scan of the table of lists gave, by its metric."""
    found_rows.collect()
    leaves = found_rows._jdf.queryExecution().executedPlan().collectLeaves()
    scans = [leaves.apply(i) for i in range(leaves.size())]
    return sum(s.metrics().apply("numOutputRows").value() for s in scans if "list_id" in s.simpleString(2000))


def test_inverted_lists_read_only_their_partitions(spark, tmp_path):
    vectors, queries = clustered(3000, 40, 16, 4), clustered(5, 40, 16, 4)
    ids, path = list(range(3000)), str(tmp_path / "lists")
    li.write_lists(frame(spark, vectors, "id", ids), path, 24, k=5)
    index = li.read_lists(spark, path)
    asked = frame(spark, queries, "query_id")
    exact = brute(vectors, queries, 5, ids)
    assert found(li.top_k_lists(index, asked, 5, 24)) == exact
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = li.top_k_lists(index, asked, 5)
        read = scanned(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    near = found(rows)
    hits = sum(len(set(near.get(q, [])) & set(exact[q])) for q in exact)
    assert hits / 25 >= 0.9
    assert 0 < read < 0.4 * 3000
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*list_id", plan)
    share = {r.query_id: r.share for r in li.share_read(index, asked).collect()}
    assert read / 3000 <= sum(share.values()) and max(share.values()) < 0.4


def test_inverted_lists_on_odd_vectors(spark, tmp_path):
    """Null vectors take no part, zero vectors are last, repeated rows and a hot list stay whole."""
    rows = [(i, [1.0, 0.0, 0.1 * (i % 3)]) for i in range(60)] + [(60, None), (61, [0.0, 0.0, 0.0]), (7, [1.0, 0.0, 0.1])]
    rows += [(70 + i, [0.0, 1.0, 0.01 * i]) for i in range(5)]
    vectors = spark.createDataFrame(rows, "id long, embedding array<float>")
    path = str(tmp_path / "odd")
    li.write_lists(vectors, path, 3, k=2)
    index = li.read_lists(spark, path)
    assert index.rows.count() == len(rows) - 1 and index.sizes.sum() == len(rows) - 1
    asked = spark.createDataFrame([(1, [0.0, 1.0, 0.0]), (2, None)], "query_id long, embedding array<float>")
    everything = li.top_k_lists(index, asked, 100, probes=9).orderBy("rank").collect()
    assert [r.id for r in everything[:5]] == [70, 71, 72, 73, 74] and len(everything) == len(rows) - 1
    assert {r.query_id for r in everything} == {1}
    with pytest.raises(ValueError, match="direction"):
        li.write_lists(vectors.filter("id in (60, 61)"), path, 3)
    with pytest.raises(ValueError, match="lists"):
        li.train(vectors, 0)


def test_top_k_of_a_text(spark):
    docs = spark.createDataFrame(
        [(1, "red green blue", 100001), (2, "one two three", 100002), (3, "red green", 100002)],
        "id int, content string, refnum1 int")
    vectors = em.embed(docs)
    assert se.top_k(vectors, "green red", 2).orderBy("rank").first().id == 3
    only = se.top_k(vectors, "green red", 2, refnum1=100001).collect()
    assert [row.id for row in only] == [1]
    assert se.top_k(vectors, "  ", 2).count() == 0
    assert se.top_k(vectors.filter("id > 5"), "red", 2).count() == 0


def test_search_does_not_fail_silently(spark, data):
    vectors, queries = data
    with pytest.raises(Exception, match="vectors of 8 numbers, expected 64"):
        se.top_k_batch(frame(spark, vectors, "id"), frame(spark, queries, "query_id"), 3).collect()

    def down(texts):
        raise ValueError("model is down")

    with pytest.raises(Exception, match="model is down"):
        se.top_k(frame(spark, vectors, "id"), "some words", 3, down, 8).collect()
    some = frame(spark, vectors[:3], "id").union(spark.createDataFrame([(9, None)], "id long, embedding array<float>"))
    assert se.top_k_batch(some, frame(spark, queries[:1], "query_id"), 9, 8).count() == 3


def test_rows_of_what_was_found(spark):
    docs = spark.createDataFrame([(1, "red green", "a"), (2, "one two", "b")], "id int, content string, metadata string")
    vectors = em.embed(docs)
    rows = se.with_rows(se.top_k(vectors, "one", 1), vectors, "id", "content", "metadata").collect()
    assert [(r.id, r["rank"], r.content, r.metadata) for r in rows] == [(2, 1, "one two", "b")]


def test_cheapest_flips():
    margins = np.random.default_rng(3).random(6)
    cost = lambda mask: sum(m for i, m in enumerate(margins) if mask >> i & 1)
    for wanted in (1, 5, 64):
        assert se._cheapest(margins, wanted).tolist() == sorted(range(64), key=cost)[:wanted]


def test_a_failing_batch_is_halved():
    calls = []

    def provider(texts):
        calls.append(len(texts))
        if "bad" in texts:
            raise ValueError("refused")
        return [[1.0]] * len(texts)

    vectors, errors = em._vectors(provider, ["good"] * 200 + ["bad"] + ["good"] * 55, 1)
    assert len(calls) <= 17 and [i for i, e in enumerate(errors) if e] == [200]
    assert sum(v is not None for v in vectors) == 255


def test_texts_leave_an_arrow_batch_a_few_at_a_time():
    """A batch is cut by number and by bytes; a text above the limit is alone, null texts keep their place."""
    texts = ["a" * 10, None, "b" * 95, "c" * 300, "", "d", "e", "f"]
    cut = [part.to_pylist() for part in em._slices(pa.array(texts), 3, 100)]
    assert cut == [["a" * 10, None, "b" * 95], ["c" * 300], ["", "d", "e"], ["f"]]
    assert list(em._slices(pa.array([], pa.string()), 3, 100)) == []


def test_words_are_split_at_ascii_white_space_only():
    one = em.HashProvider(16)
    assert (one([" a\tb\x0bc\x0c\r\nd "])[0] == one(["a b c d"])[0]).all()
    assert (one(["a\u2003b\x85c\x1cd"])[0] != 0).sum() == 1


def test_hash_vectors(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "id int, content string")
    rows = {row.id: row for row in em.embed(docs, dim=16).collect()}
    assert abs(sum(x * x for x in rows[1].embedding) - 1) < 1e-6
    assert sorted(x for x in rows[1].embedding if x) == pytest.approx([1 / 5**0.5, 2 / 5**0.5])
    assert set(rows[2].embedding) == {0.0}
    assert rows[3].embedding is None and rows[3].error is None


def test_one_bad_text_does_not_spoil_its_batch(spark):
    def provider(texts):
        if any("bad" in text for text in texts):
            raise ValueError("refused")
        return [[1.0, 2.0] if "short" in text else [1.0, 2.0, 3.0] for text in texts]

    docs = spark.createDataFrame(
        [(i, "bad" if i == 3 else "short" if i == 5 else "good") for i in range(40)], "id int, content string")
    rows = {r.id: r for r in em.embed(docs.coalesce(1), provider, 3).collect()}
    assert rows[3].embedding is None and "refused" in rows[3].error
    assert rows[5].embedding is None and "expected 3 dimensions, got 2" in rows[5].error
    assert all(r.embedding == [1.0, 2.0, 3.0] for i, r in rows.items() if i not in (3, 5))


def test_providers(spark):
    local, remote = object(), object()
    assert em.choose_provider("standalone", local, remote) is local
    assert em.choose_provider("cloud", local, remote) is remote


def test_distance_and_dimension(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert rows.select(cosine_distance(F.col("a"), F.col("b"))).first()[0] == pytest.approx(1 - 0.5**0.5)
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None)], "id int, embedding array<float>")
    assert {r.id for r in em.dimension_rejects(vectors, 2).collect()} == {2, 3}


def test_codes_bound_distances():
    made = np.random.default_rng(11)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    for dim, spread in ((3, 1.0), (64, 1.0), (300, 8.0)):
        vectors, queries = (unit(made.normal(size=(n, dim)) * made.exponential(spread, size=(n, dim))) for n in (200, 30))
        vectors[:30] = queries
        lower, upper = co.bounds(queries, *co.encode(vectors))
        exact = np.round(1 - queries @ vectors.T, 9)
        assert (lower <= exact).all() and (exact <= upper).all() and (upper - lower).max() < 0.1
    lower, upper = co.bounds(np.array([[1.0, 0.0], [np.nan] * 2]), *co.encode(np.array([[np.nan] * 2, [0.0, 1.0]])))
    assert np.isinf(lower).tolist() == np.isinf(upper).tolist() == [[True, False], [True, True]]


@pytest.mark.parametrize("k", [1, 5, 700])
def test_codes_answer_as_the_exact_search(spark, k):
    made = np.random.default_rng(12)
    vectors = np.concatenate([made.normal(size=(300, 16)), made.integers(-1, 2, (200, 16)), np.zeros((9, 16))])
    vectors[300:340] = vectors[300]
    queries = np.concatenate([made.normal(size=(6, 16)), vectors[300:301], np.zeros((1, 16))])
    table = frame(spark, vectors, "id", [f"v{i:03}" for i in range(len(vectors))]).repartition(5)
    table = table.union(spark.createDataFrame([("null", None)], table.schema))
    asked = frame(spark, queries, "query_id")
    codes = co.encoded(table, dim=16)
    got = co.top_k_codes(codes, table, asked, k, dim=16).collect()
    want = se.top_k_batch(table, asked, k, dim=16).collect()
    as_rows = lambda rows: sorted((r.query_id, r["rank"], r.id, str(r.distance)) for r in rows)
    assert as_rows(got) == as_rows(want)
    assert co.top_k_codes(codes.limit(0), table, asked, k, dim=16).count() == 0
    assert co.top_k_codes(codes, table, asked.limit(0), k, dim=16).count() == 0


def test_codes_leave_few_exact_products(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").filter("embedding is not null").select("vec_id", "embedding")
    asked = vectors.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    codes = co.encoded(vectors, "vec_id")
    left = co.candidates(codes, asked, 10, vector_id="vec_id").count()
    size = codes.agg(F.sum(F.octet_length("codes") + F.octet_length("scale") + F.octet_length("error") + F.octet_length("digests"))).first()[0]
    n = vectors.count()
    print("products", left, "of", n * asked.count(), "bytes", size, "of", n * 64 * 4)
    assert left < 0.03 * n * asked.count() and size < 0.35 * n * 64 * 4


def test_copies_do_not_crowd_a_query(spark):
    made = np.random.default_rng(13)
    vectors = made.normal(size=(3000, 8))
    vectors[1000:2000] = vectors[5]  # a third are copies
    table, asked = frame(spark, vectors, "id").repartition(4), frame(spark, vectors[5:6], "query_id")
    codes = co.encoded(table, dim=8)
    assert co.candidates(codes, asked, 10, 8).count() <= 4 * 10
    got = co.top_k_codes(codes, table, asked, 10, 8)
    assert found(got) == {0: [5, *range(1000, 1009)]} == found(se.top_k_batch(table, asked, 10, 8))
