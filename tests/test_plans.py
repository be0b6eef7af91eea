"""What the physical plans have to look like."""

import re

import pytest
from pyspark.sql import functions as F

from textmill.operators.chunking import chunk_documents
from textmill.operators.counters import event_counts, fleet_rollup, instance_registry
from textmill.operators.embedding import embed
from textmill.operators.search import find_by_refnums, refnum_statistics, top_k, top_k_batch
from textmill.plans.ingest import ingest, run_messages, stored
from textmill.plans.views import view
from textmill.sources.messages import with_url
from textmill.sources.metrics_log import parse_metrics
from textmill.sources.vector_table import list_stored, read_vectors, write_index

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def run(df):
    """The plan as it ran."""
    df.collect()
    text = plan(df)
    return text[text.index("Final Plan"):text.index("Initial Plan")] if "Initial Plan" in text else text


def test_ordered_logs_are_shuffled_once(spark):
    """One scan does it: the log is shuffled twice, once of it for the sums of blocks."""
    from textmill.operators.control import control_state, gate_messages, state_intervals
    from textmill.operators.counters import counters_since_reset

    commands = view(spark, FOLDER, "control_log")
    events = view(spark, FOLDER, "metric_events")
    messages = events.select(F.col("event_id").alias("msg_id"), "ts", "instance_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for rows in (
            control_state(commands), state_intervals(commands), gate_messages(messages, commands),
            counters_since_reset(events),
        ):
            rows.collect()
            text = plan(rows)
            final = text[text.index("Final Plan"):text.index("Initial Plan")]
            # The rows, what their block sums are made of, and the sums on their way back.
            wide = re.findall(r"Exchange hashpartitioning\(_key[^\n]*_block", final)
            assert len(wide) <= 3, final
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("table"))
    run_messages(with_url(view(spark, FOLDER, "messages")), view(spark, FOLDER, "src_docs"), path,
                 max_words=300)
    return read_vectors(spark, path)


def test_refnum_filter_reaches_the_scan(vectors):
    text = plan(top_k(vectors, "some words", refnum1=100000))
    assert "EqualTo(refnum1,100000)" in text
    assert re.search(r"PartitionFilters: \[[^\]]*outcome", text)
    [read] = [r for r in re.findall(r"ReadSchema: struct<([^\n]*)>", text) if "matrix" not in r]
    assert "content" not in read and "metadata" not in read and "embedding" in read
    assert "EqualTo(refnum2,200000)" in plan(find_by_refnums(vectors, None, 200000, 5))


def test_reports_do_not_read_vectors_or_texts(vectors):
    for report in (refnum_statistics(vectors), list_stored(vectors)):
        assert "embedding" not in re.search(r"ReadSchema: ([^\n]*)", plan(report)).group(1)
    assert "TakeOrderedAndProject" in plan(list_stored(vectors))


def test_search_shuffles_only_what_it_found(spark, vectors):
    queries = embed(view(spark, FOLDER, "benchmark").select(F.col("item_id").alias("query_id"), "text"), text="text")
    found = top_k_batch(vectors, queries, 5)
    text = plan(found)
    assert text.count("Exchange hashpartitioning(query_id") == 1
    assert text.count("WindowGroupLimit") == 2
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    # The queries were packed and written before; each side is read once whatever the number of blocks.
    final = run(found)
    assert "BroadcastHashJoin" in final and final.count("FileScan") == 2 and "SortMergeJoin" not in final


def test_index_is_read_by_bucket(spark, tmp_path):
    from textmill.operators.search import approx_top_k, with_bucket
    made = view(spark, FOLDER, "chunk_vectors").select(F.col("vec_id").alias("id"), "embedding")
    write_index(with_bucket(made), str(tmp_path))
    asked = made.filter("id = 3").withColumnRenamed("id", "query_id")
    index = spark.read.parquet(str(tmp_path))
    found = approx_top_k(index, asked, 5, share=0.1)
    assert "CartesianProduct" not in plan(found)
    assert "PartitionFilters: [bucket" in plan(found) or "PartitionFilters: [isnotnull(bucket" in plan(found)
    assert found.count() == 5 and found.filter("id = 3 and rank = 1").count() == 1


def test_chunks_are_cut_in_place_and_once(spark):
    docs = view(spark, FOLDER, "src_docs")
    text = plan(chunk_documents(docs).filter("n_words > 150"))
    assert "Exchange" not in text and text.count("split(") <= 3


def test_the_model_runs_once(spark):
    rows = ingest(with_url(view(spark, FOLDER, "messages")), view(spark, FOLDER, "src_docs"))
    assert plan(stored(rows)).count("ArrowEvalPython") == 1


def test_json_is_parsed_once(spark):
    bodies = view(spark, FOLDER, "messages")
    assert plan(parse_metrics(bodies)).count("from_json(") == 1


def test_large_sides_are_joined_by_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = ingest(with_url(view(spark, FOLDER, "messages")), view(spark, FOLDER, "src_docs"))
        text = plan(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text and "Broadcast" not in text


def test_reports_aggregate_before_the_shuffle(spark):
    events = view(spark, FOLDER, "metric_events")
    for report in (fleet_rollup(events), event_counts(events), instance_registry(events)):
        bottom = plan(report).rsplit("Exchange", 1)[1]
        assert "partial_" in bottom and "Expand" not in bottom
