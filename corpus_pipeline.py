"""Documents to token ids in five stages, each a Spark job of its own.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet, and the next stage reads that. All but the last return the
columns of `documents`. Nulls, empty texts and repeated rows are treated as the
operators of textmill.llm say.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm import bpe, mixing, quality, secrets, simhash
from textmill.llm.common import stored

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and all proved cutoffs.

    The cutoffs are fitted on the measures of all labelled documents of the stage.
    The texts stay where they are: they are measured again, not joined.
    """
    packed = docs.select(F.struct(*docs.columns).alias("row"), "lang", "text")
    measured = quality.measure(packed)
    narrow = stored(quality.measure(docs.select("doc_id", "lang", "text")).drop("text"), "measures")
    cutoffs = stored(quality.fit(narrow, spark.read.parquet(f"{sf_dir}/labels.parquet")), "cutoffs")
    return quality.judge(measured, cutoffs).filter("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints are linked, with the shingles and the radius of op4_simhash."""
    return simhash.one_of_each(docs)


def redacted_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark; n_chars follows."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix shows it. The document on a source's cut is whole."""
    return mixing.shown(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and the hash of what the ids decode to."""
    found = bpe.encoded(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return found.select("doc_id", "lang", "source", F.size("ids").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("redacted_secrets", redacted_secrets),
    ("mixed_sources", mixed_sources),
    ("token_ids", token_ids),
]

# Quality statistics could be SQL, but fingerprints, tagged secrets and BPE cannot.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
