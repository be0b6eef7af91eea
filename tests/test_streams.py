"""Streams that work on late rows in order: the gate and running counters."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from textmill.operators.control import gate_messages
from textmill.operators.counters import COUNTERS, running_counters
from textmill.plans.catalog.streams import in_late_batches
from textmill.streaming import gate as sg
from textmill.streaming import inorder as io
from textmill.streaming import metrics as sm
from textmill.streaming.levels import newest_versions
from textmill.streaming.sinks import run_available

COMMANDS = "cmd_id long, sec int, instance_id string, command string"
MESSAGES = "msg_id long, sec int, instance_id string"


def timed(frame):
    return frame.withColumn("ts", F.timestamp_seconds("sec")).drop("sec")


def stream(spark, parts, path):
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def logs(spark, seed=1):
    rng = random.Random(seed)
    names = ["a", "b", None]
    commands = [(i, rng.randrange(1000), rng.choice(names), rng.choice(["start", "stop", "toggle", "reset", None])) for i in range(60)]
    said = [(i, rng.randrange(1000), rng.choice(names)) for i in range(300)]
    said += [(1000 + i, c[1], c[2]) for i, c in enumerate(commands[:20])]  # at the time of a command
    return timed(spark.createDataFrame(commands, COMMANDS)), timed(spark.createDataFrame(said, MESSAGES))


def shown(gated):
    return sorted((str(r.msg_id), str(r.instance_id), r.ts, r.status, str(r.consumed_at)) for r in gated.collect())


def ticks(spark, sec, names=("a", "b", None)):
    return timed(spark.createDataFrame([(sec, n) for n in names], "sec int, instance_id string"))


def test_more_rows_are_more_files_of_a_queue(spark, tmp_path):
    """Files stay as large as they are; every row is in one, at most one after that of its time."""
    rows = spark.range(1000).select((F.col("id") * 1_000_000).alias("_at"), "id").union(spark.sql("select null, 1000L"))
    stream_of, delay = in_late_batches(rows, f"{tmp_path}/q", most=100)
    files = sorted((tmp_path / "q").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    held = [spark.read.parquet(str(f)).toPandas() for f in files]
    held = [h for h in held if len(h)]
    assert stream_of.isStreaming and len(held) == 11 and max(map(len, held)) <= 120 and 199 < delay <= 201
    assert sorted(i for h in held for i in h["id"]) == list(range(1000))
    assert all(n - 1 <= i // 100 <= n for n, h in enumerate(held) for i in h["id"])


@pytest.mark.parametrize("seed", [1, 2])
def test_gate_in_batches(spark, tmp_path, seed):
    commands, messages = logs(spark, seed)
    both = sg.together(messages, commands)
    late = F.col("_at") / 1_000_000 + F.when(F.xxhash64("id", "kind") % 3 == 0, 90).otherwise(0)
    parts = [both.filter((late >= a) & (late < b)) for a, b in ((0, 300), (300, 600), (600, 2000))]
    closing = sg.together(messages.limit(0), commands.limit(0), ticks(spark, 5000))
    handed = []

    def then(rows, batch_id):
        handed.append([(r.msg_id, r.instance_id, r._at, r.consumed_at) for r in rows.orderBy("consumed_at", "_at").collect()])

    out = str(tmp_path)
    found = sg.stream_gate(stream(spark, [*parts, closing], f"{out}/q"), f"{out}/t", f"{out}/c", 100, then)
    want = gate_messages(messages.withColumn("msg_id", F.col("msg_id").cast("string")), commands.withColumn("cmd_id", F.col("cmd_id").cast("string")))
    assert shown(found) == shown(want)
    # Every message that is on is handed on once, none before it came.
    consumed = sorted(x[0] for batch in handed for x in batch)
    assert consumed == sorted(r.msg_id for r in want.filter("consumed_at is not null").collect())
    assert all(at <= done for batch in handed for _, _, at, done in batch) and sum(map(bool, handed)) > 1


def test_gate_goes_on_after_a_restart(spark, tmp_path):
    """Waiting messages are rows of the table; the state only knows the span."""
    out = str(tmp_path)
    say = lambda *rows: timed(spark.createDataFrame(rows, MESSAGES))
    do = lambda *rows: timed(spark.createDataFrame(rows, COMMANDS))
    none_said, none_done = say((0, 0, "a")).limit(0), do((0, 0, "a", "")).limit(0)

    def run(messages, commands, now):
        part = sg.together(messages, commands, ticks(spark, now, ["a"]))
        return shown(sg.stream_gate(stream(spark, [part], f"{out}/q"), f"{out}/t", f"{out}/c", 10))

    rows = run(say(*[(i, 100 + i, "a") for i in range(50)]), none_done, 1000)
    assert len(rows) == 50 and all(r[3:] == ("STOPPED", "None") for r in rows)
    rows = run(say((90, 1005, "a")), do((1, 1003, "a", "start"), (2, 1010, "a", "stop")), 2000)
    assert sum("00:16:43" in r[4] for r in rows) == 50 and [r[3] for r in rows if r[0] == "90"] == ["STARTED"]
    # A message that comes far too late is decided by the state there is, and lost to no span.
    rows = run(say((91, 50, "a")), none_done, 3000)
    assert [r[3:] for r in rows if r[0] == "91"] == [("STOPPED", "None")]
    rows = run(none_said, do((3, 3005, "a", "toggle")), 4000)
    assert [r[4][11:] for r in rows if r[0] == "91"] == ["00:50:05"] and len(rows) == 52
    assert spark.read.parquet(f"{out}/t/consumed").count() == 52


def test_running_counters_in_batches(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.randrange(1000), "s", rng.choice(["a", None]), rng.choice(["CHUNK_COMPLETE", "FILE_COMPLETE", "ERROR", "HEARTBEAT"]),
             rng.choice(["f", None]), rng.choice(["e", None]), *(rng.randrange(3) for _ in COUNTERS)) for i in range(400)]
    schema = ("event_id long, sec int, service string, instance_id string, event string, filename string, error_text string, "
              + ", ".join(f"{d} long" for d in COUNTERS.values()))
    log = timed(spark.createDataFrame(rows, schema))
    both = sm.counted(log)
    late = F.col("_at") / 1_000_000 + F.when(F.xxhash64("event_id") % 3 == 0, 90).otherwise(0)
    parts = [both.filter((late >= a) & (late < b)) for a, b in ((0, 300), (300, 600), (600, 2000))]
    end = both.groupBy("service", "instance_id").agg(F.lit(5_000_000_000).alias("_at"), F.lit(True).alias("_tick"), *[
        F.first(c).alias(c) for c in both.columns if c not in ("service", "instance_id", "_at", "_tick")]).select(*both.columns)
    out = str(tmp_path)
    sm.stream_snapshots(stream(spark, [*parts, end], f"{out}/q"), f"{out}/t", f"{out}/c", 100)
    found = spark.read.parquet(f"{out}/t")
    want = {r.event_id: (r.total_chunks, r.processed_chunks, r.error_count, r.files_processed) for r in running_counters(log).collect()}
    got = {r.event_id: (r.totalChunks, r.processedChunks, r.errorCount, r.filesProcessed) for r in found.collect()}
    assert got == want and found.count() == 400


def test_files_seen_are_counted_over_batches(spark, tmp_path):
    """A name that comes again, in its batch, in a later one or of another instance; null keys, and rows that are there twice."""
    rng, names = random.Random(7), [None, *(f"f{i}" for i in range(60))]
    rows = [(i, rng.randrange(1000), rng.choice(["s", "t"]), rng.choice(["a", None]), "CHUNK_COMPLETE", rng.choice(names), None, 1, 0, 0, 0)
            for i in range(600)]
    rows += [(1000 + i, rng.randrange(1000), "s", "a", "HEARTBEAT", f"only{i}", None, 0, 0, 0, 0) for i in range(200)]
    rows += rows[:30]
    schema = ("event_id long, sec int, service string, instance_id string, event string, filename string, error_text string, "
              + ", ".join(f"{d} long" for d in COUNTERS.values()))
    both = sm.counted(timed(spark.createDataFrame(rows, schema)))
    late = F.col("_at") / 1_000_000 + F.when(F.xxhash64("event_id") % 3 == 0, 90).otherwise(0)
    parts = [both.filter((late >= a) & (late < a + 300)) for a in range(0, 1100, 300)]
    end = both.groupBy("service", "instance_id").agg(F.lit(5_000_000_000).alias("_at"), F.lit(True).alias("_tick"), *[
        F.first(c).alias(c) for c in both.columns if c not in ("service", "instance_id", "_at", "_tick")]).select(*both.columns)
    out = str(tmp_path)
    found = sm.stream_snapshots(stream(spark, [*parts, end], f"{out}/q"), f"{out}/t", f"{out}/c", 100)
    got = sorted((r.event_id, r.filesTotal) for r in found.select("event_id", "filesTotal").collect())
    want, seen = [], {}
    for row in sorted(rows, key=lambda row: (row[1], row[0])):
        files = seen.setdefault(row[2:4], set())
        files |= {row[5]} - {None}
        want.append((row[0], len(files)))
    assert got == sorted(want)


def test_a_repeated_batch_counts_its_files_once(spark, tmp_path):
    blank = {"event": "HEARTBEAT", "error_text": None, "_at": 5, **{d: 0 for d in COUNTERS.values()}}
    brought = [["f", "g", None, "f"], ["g", "h"]]
    path, sink = str(tmp_path / "t"), sm.snapshot_sink(str(tmp_path / "t"))
    for batch_id in (0, 0, 1, 1):
        out, _ = sm._run_on(pd.DataFrame([{**blank, "event_id": i, "filename": f} for i, f in enumerate(brought[batch_id])]), {})
        rows = spark.createDataFrame(out.astype(object).where(out.notna(), None).to_dict("records"), sm._RUNNING)
        sink(rows.withColumns({"service": F.lit("s"), "instance_id": F.lit(None).cast("string")}), batch_id)
    found = spark.read.parquet(path).orderBy("batch_id", "event_id").collect()
    assert [r.filesTotal for r in found] == [1, 2, 2, 2, 2, 3]
    assert sorted(r.filename for r in newest_versions(spark, sm.names_path(path), sm.NAMED).collect()) == ["f", "g", "h"]


def test_rows_in_order_bring_no_rows_twice():
    rows = pd.DataFrame({"event_id": [1, 2], "_at": [5, 5], "event": ["ERROR", "CHUNK_COMPLETE"], "filename": [None, "f"],
                         "error_text": ["bad", None], **{d: [1, 2] for d in COUNTERS.values()}})
    out, carried = sm._run_on(rows, {})
    again, _ = sm._run_on(rows, carried)
    assert out["total_chunks"].tolist() == [1, 3] and again["total_chunks"].tolist() == [4, 6]
    assert out["current_file"].tolist() == [None, "f"] and out["last_error"].tolist() == ["bad", "bad"]
    assert io._unpack(io._pack(rows)).equals(rows)


def test_queue_files_keep_the_limits(spark, tmp_path):
    import json

    from textmill.streaming import admission as ad

    files = spark.createDataFrame([(f"/f/{i}", "x" * (i % 50 * 10)) for i in range(500)] + [("/f/huge", "y" * 90_000)], "url string, content string")
    urls = [f"/f/{i}" for i in range(500)] + ["/f/huge", "/f/none", "/f/7", "/f/7"]
    bodies = [(i, json.dumps({"url": u})) for i, u in enumerate(urls)] + [(900, "not json"), (None, json.dumps({"url": "/f/8"}))]
    messages = spark.createDataFrame(bodies, "msg_id bigint, body string")
    sizes = ad.file_sizes(files)
    rows = ad.with_slot(messages, sizes, 20, 3000).collect()
    assert sorted(r.url for r in rows) == sorted([*urls, "/f/8"])
    slots = {}
    for r in rows:
        slots.setdefault(r.slot, []).append(r.size)
    assert max(map(len, slots.values())) <= 20
    for held in slots.values():
        assert sum(held) - max(held) <= 3000
    for _ in range(2):  # a repeated batch
        ad.deal(messages, sizes, str(tmp_path / "q"), 20, 3000)
    queue, seen = ad.stream_dealt(spark, str(tmp_path / "q")), []
    query = queue.writeStream.foreachBatch(lambda batch, _: seen.append(batch.count())).option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(n for n in seen if n) == sorted(len(held) for held in slots.values())


def test_a_batch_reads_the_files_it_names(spark, tmp_path):
    """Contents are dealt out with the messages; a batch opens those of its own file of the queue."""
    import json

    from textmill.streaming import admission as ad

    files = spark.createDataFrame([(f"/f/{i}", "x" * (i % 7 * 100)) for i in range(90)] + [(None, "n"), ("/f/blank", None)], "url string, content string")
    urls = [f"/f/{i}" for i in range(80)] + ["/f/none", "/f/blank", *["/f/7"] * 60]
    bodies = [(i, json.dumps({"url": u})) for i, u in enumerate(urls)] + [(900, "not json")]
    messages, queue = spark.createDataFrame(bodies, "msg_id bigint, body string"), str(tmp_path / "q")
    for _ in range(2):  # a repeated batch
        ad.deal(messages, ad.file_sizes(files), queue, 20, 3000, files=files)
    of, seen = ad.dealt_files(spark, queue), []

    def run(batch, _):
        named = {json.loads(r.body)["url"] for r in batch.collect()}
        seen.append((named, {r.url: r.content for r in of(batch).collect()}, of(batch).count(), of(batch).inputFiles()))

    stream = ad.stream_dealt(spark, queue, f"msg_id bigint, body string, {ad.DEALT} string")
    run_available(stream.writeStream.foreachBatch(run), str(tmp_path / "c"))
    contents = {r.url: r.content for r in files.collect()}
    for named, found, n, _ in seen:
        assert found == {u: contents[u] for u in named if u in contents} and n == len(found)
    opened = [path for *_, paths in seen for path in paths]
    assert len(seen) > 6 and len(opened) == len(set(opened)) and set().union(*(named for named, *_ in seen)) == set(urls)


def test_segments_that_should_be_there_are_not_listed(spark, tmp_path, monkeypatch):
    from textmill.streaming import levels as lv

    path = str(tmp_path / "v")
    write = lv.versions_sink(path, ["k"])
    for batch in range(10):
        write(spark.createDataFrame([("k", batch), (f"k{batch}", batch)], "k string, n int").coalesce(1), batch)
    assert lv.full_cover(10) == [(0, 7), (8, 8), (9, 9)] and lv.full_cover(0) == [] and lv.full_cover(64) == [(0, 63)]
    rows = lambda below: {tuple(r) for r in lv.newest(lv.open_segments(spark, path, below), ["k"]).select("k", "n").collect()}
    want = {below: {("k", below - 1), *((f"k{i}", i) for i in range(below))} for below in (3, 8, 9, 10)}
    with monkeypatch.context() as m:
        m.setattr(lv, "_committed", lambda *_: pytest.fail("all segments were listed"))
        assert {below: rows(below) for below in want} == want
    # One that was not committed, and a batch that wrote nothing, are found by listing.
    (tmp_path / "v" / "seg-000000000000-000000000007" / "_SUCCESS").unlink()
    assert rows(10) == want[10] and rows(20) == want[10]


@pytest.mark.parametrize("name", ["stream_ingest_chunks", "stream_redelivery"])
def test_one_file_of_documents_is_worked_on_by_all_tasks(spark, tmp_path, monkeypatch, name):
    from textmill.plans.catalog import streams

    rows = [(8 * i, "\n".join(" ".join(f"word{i}x{j}y{k}" for k in range(120)) for j in range(40))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(streams, "new_folder", lambda *_: str(tmp_path / "out"))
    monkeypatch.setattr(streams, "Outage", streams.HashProvider)
    getattr(streams, name)(spark, str(tmp_path)).count()
    written = list((tmp_path / "out" / "table").glob("run=*/batch_id=0/outcome=stored/*.parquet"))
    assert len(written) == spark.sparkContext.defaultParallelism


def test_a_small_batch_takes_few_jobs_and_gives_the_same(spark, tmp_path):
    """Files that come again after they were stored, failed or missing, in batches that may and may not be kept together."""
    import json

    from textmill.plans.catalog.streams import Outage
    from textmill.sources.vector_table import read_rows
    from textmill.streaming import ingest as si
    from textmill.streaming import ledger as lg

    files = spark.createDataFrame([(f"/f/{i}.txt", f"words {'x' * (i % 5)} of\n\nfile {i}") for i in range(40)] + [("/f/none.txt", None)], "url string, content string")
    parts = [[*range(n, n + 8)] for n in (0, 8, 16)] + [[3, 20, "none", "gone", 20], [1, 2, 31, "none", "gone"]]
    queue = [spark.createDataFrame([(i, json.dumps({"url": f"/f/{i}.txt"})) for i in map(str, part)], "msg_id string, body string") for part in parts]
    jobs, given = {}, {}
    for few in (False, True):
        out, began = str(tmp_path / f"{few}"), []

        def named(messages):
            began.append(spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs())
            return files

        si.stream_ingest(stream(spark, queue, f"{out}/q"), named, f"{out}/t", f"{out}/e", f"{out}/c", few=few, provider=Outage(),
                         max_words=3, min_words=1, ingest_ms=F.lit(0), parts=2)
        jobs[few] = began[2] - began[1]
        rows = read_rows(spark, f"{out}/t").select("url", "chunk_no", "id", "outcome", "error", "batch_id")
        ledger = lg.read_ledger(spark, si.ledger_path(f"{out}/t")).select("url", "outcome", "reason", "attempts", F.size("tried"))
        events = spark.read.parquet(f"{out}/e").select("url", "n_chunks", "batch_id")
        given[few] = [sorted(map(str, some.collect())) for some in (rows, ledger, events)]
    assert given[True] == given[False] and all(given[True]) and any("attempts=2" in row for row in given[True][1])
    assert {"stored", "failed", "missing"} <= {row.outcome for row in rows.collect()}
    assert jobs[True] < 16 <= jobs[False], jobs
