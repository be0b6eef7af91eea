"""One query per operator, over its whole table, with the SQL that checks it where SQL can."""

import public_tokenizers
from pyspark.sql import functions as F

from ..session import new_folder
from . import audit, bpe, mixing, nearest, periodic, quality, repeats, secrets, sharding, simhash, templates, toxicity, warc
from .common import stored
from .oracles import ORACLES  # noqa: F401


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    measured = stored(quality.measure(docs.select("doc_id", "lang", "text")).drop("text"), "op1-measures")
    cutoffs = quality.fit(measured, _table(spark, sf_dir, "labels"))
    judged = quality.judge(measured, cutoffs)
    m = "measures."
    return judged.select(
        "doc_id", *(F.col(m + c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        "base_failed", "kept", F.concat_ws(",", "broken_rules").alias("broken_rules"),
    )


def op2_mix_sources(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    rows = stored(mixing.sized(docs), "op2-sizes")
    return mixing.mix(rows).select("doc_id", "source", "size", "source_size", "target", "taken")


def op3_byte_bpe(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_simhash(spark, sf_dir):
    prints = stored(simhash.fingerprints(_table(spark, sf_dir, "documents")), "op4-prints")
    return simhash.classes(prints).select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id",
    )


def op5_exact_top_k(spark, sf_dir):
    return nearest.top_k(_table(spark, sf_dir, "embeddings"))


def op6_repeated_strings(spark, sf_dir):
    return repeats.repeats(_table(spark, sf_dir, "documents")).drop("removed")


def op7_sharding(spark, sf_dir):
    rows = stored(sharding.described(_table(spark, sf_dir, "documents")), "op7-sizes")
    placed = sharding.shard(rows)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "group_size",
    )


def op8_main_text(spark, sf_dir):
    return templates.main_text(_table(spark, sf_dir, "pages"))


def op9_secret_scan(spark, sf_dir):
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))


def op11_warc(spark, sf_dir):
    archives = new_folder(spark, "op11-warc")
    warc.write_archives(_table(spark, sf_dir, "pages"), archives)
    records = stored(warc.read_archives(spark, archives, with_payload=False), "op11-records")
    found = warc.with_originals(records)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_periodic_runs(spark, sf_dir):
    return periodic.digests(periodic.with_runs(periodic.planted(_table(spark, sf_dir, "documents"))))


def op13_filter_audit(spark, sf_dir):
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_mix_sources, op3_byte_bpe, op4_simhash, op5_exact_top_k, op6_repeated_strings,
    op7_sharding, op8_main_text, op9_secret_scan, op10_toxicity, op11_warc, op12_periodic_runs, op13_filter_audit,
)}
