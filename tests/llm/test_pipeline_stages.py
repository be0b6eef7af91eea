"""The near-duplicate stage of the pipeline against a comparison of all fingerprints."""

import random

import corpus_pipeline
from textmill.llm import simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_one_document_of_each_group_stays(spark):
    rng = random.Random(3)
    texts = []
    for n in range(25):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(3, 250))]
        texts += [" ".join(words), " ".join(words).upper() if n % 2 else "  ".join(words)]
        edited = list(words)
        edited[rng.randrange(len(words))] = "new"
        texts.append(" ".join(edited))
    texts += [None, "", " \n", "alone"] + ["the crowd " * 40] * 30
    order = list(range(len(texts)))
    rng.shuffle(order)
    prints = {i: simhash.fingerprint((texts[i] or "").encode()) % (1 << 64) for i in order}
    root = {i: i for i in order}

    def up(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in order:
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= simhash.RADIUS:
                low, high = sorted((up(i), up(j)))
                root[high] = low
    docs = spark.createDataFrame([(i, texts[i], "en", "s", len(texts[i] or "")) for i in order], DOCS)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({up(i) for i in order})
    assert len({up(i) for i in order}) < len(texts) - 50
