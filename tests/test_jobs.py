"""Ingest jobs on files, in batch and as streams."""

import hashlib
import json
import glob
import time

import pytest
from pyspark.sql import functions as F

from textmill.plans import ingest as jobs
from textmill.plans.catalog import QUERIES
from textmill.plans.catalog.ingest import file_rows
from textmill.sources import compaction
from textmill.sources import vector_table as vt
from textmill.sources.files import scan_text_dir, stream_text_dir
from textmill.sources.messages import load_content, missing_content, one_per_url, stream_messages, with_url
from textmill.operators.embedding import HashProvider
from textmill.sources.vector_table import append_rows, read_errors, read_vectors
from textmill.streaming import ingest as si
from textmill.streaming import metrics as sm
from textmill.streaming import ledger as lg
from textmill.streaming import levels as lv
from textmill.streaming.levels import newest_versions
from textmill.streaming.sinks import batch_folder, run_available

LONG = "\n\n".join(f"paragraph {i} has five words" for i in range(6))


@pytest.fixture
def folder(tmp_path):
    files = tmp_path / "in"
    files.mkdir()
    (files / "100001-200001.txt").write_text("﻿" + LONG)
    (files / "notes.txt").write_text("a few words")
    (files / "empty.txt").write_text("")
    (files / "other.md").write_text("not read")
    (files / "sub").mkdir()
    (files / "sub" / "deep.txt").write_text("not read either")
    return str(files)


def test_scan(spark, folder):
    rows = {r.url.rsplit("/", 1)[1]: r.content for r in scan_text_dir(spark, folder).collect()}
    assert rows["100001-200001.txt"] == "﻿" + LONG
    assert set(rows) - {"empty.txt"} == {"100001-200001.txt", "notes.txt"}
    assert scan_text_dir(spark, folder + "-none").count() == 0


def test_folder_job(spark, folder, tmp_path):
    listed, hits = jobs.run_folder(spark, folder, str(tmp_path / "t"), "few words", ingest_ms=F.lit(7))
    rows = {r.preview[:5]: (r.refnum1, r.refnum2, r.timestamp) for r in listed.collect()}
    assert rows == {"﻿para": ("100001", "200001", "7"), "a few": ("100001", "200001", "7")}
    first = hits.orderBy("rank").first()
    best = read_vectors(spark, str(tmp_path / "t")).filter(F.col("id") == first.id).first()
    assert best.content == "a few words"


def files(spark):
    return spark.createDataFrame(
        [("/policies/100001-200001.txt", LONG), ("/reference/a.txt", LONG), ("/policies/bad.txt", LONG),
         ("/data/small.txt", "tiny"), ("http://n/webhdfs/v1/x.txt?op=OPEN", LONG)], "url string, content string")


def messages(spark, *urls):
    bodies = [(i, json.dumps({"url": u})) for i, u in enumerate(urls)]
    return spark.createDataFrame(bodies, "msg_id long, body string")


ALL = ("/policies/100001-200001.txt", "/reference/a.txt", "/policies/bad.txt", "/data/small.txt",
       "/data/none.txt", "http://n/webhdfs/v1/x.txt?user=me", "/reference/a.txt")


def test_message_job(spark):
    rows = jobs.ingest(with_url(messages(spark, *ALL)), files(spark), max_words=12, min_words=6, defaults=(1, 2))
    outcomes = {}
    for row in rows.collect():
        outcomes.setdefault(row.url, set()).add(row.outcome)
    assert outcomes == {
        "/policies/100001-200001.txt": {"stored"}, "/reference/a.txt": {"stored"},
        "/policies/bad.txt": {"rejected"}, "/data/small.txt": {"empty"}, "/data/none.txt": {"missing"},
        "http://n/webhdfs/v1/x.txt?op=OPEN": {"stored"}}
    kept = jobs.stored(rows).collect()
    assert len({r.id for r in kept}) == len(kept) == 9
    assert {r.refnum1 for r in kept if r.url == "/reference/a.txt"} == {None}
    summary = jobs.ingest_summary(rows).first()
    assert (summary.chunks_stored, summary.chunk_errors, summary.files_done, summary.files_missing,
            summary.dropped_words) == (9, 3, 3, 1, 1)
    assert {r.filename for r in jobs.file_complete_events(rows).collect()} == {"100001-200001.txt", "a.txt", "x.txt"}


def test_joins(spark):
    work = with_url(messages(spark, *ALL))
    loaded = load_content(work, files(spark))
    assert loaded.count() == 7 and loaded.filter("content is null").count() == 1
    assert [r.url for r in missing_content(work, files(spark)).collect()] == ["/data/none.txt"]


def test_without_metadata(spark):
    rows = jobs.ingest(with_url(messages(spark, *ALL)), files(spark), with_metadata=False,
                       max_words=12, min_words=6)
    kept = jobs.stored(rows)
    assert kept.count() == 12 and {r.metadata for r in kept.select("metadata").collect()} == {"{}"}


def test_a_batch_written_again_replaces_itself(spark, tmp_path):
    rows = spark.createDataFrame([("a", "stored"), ("b", "rejected")], "id string, outcome string")
    for run, batch in (("x", 0), ("x", 1), ("x", 1), ("y", 0)):
        append_rows(rows, str(tmp_path), run, batch)
    assert [r.id for r in read_vectors(spark, str(tmp_path)).collect()] == ["a"] * 3
    assert read_errors(spark, str(tmp_path)).count() == 3


def test_runs_only_add(spark, folder, tmp_path):
    table = str(tmp_path / "t")
    other = tmp_path / "in2"
    other.mkdir()
    (other / "more.txt").write_text("another file")
    jobs.run_folder(spark, folder, table, events=str(tmp_path / "ev"))
    jobs.run_folder(spark, str(other), table, events=str(tmp_path / "ev"))
    assert sorted(r.content[:5] for r in read_vectors(spark, table).collect()) == ["a few", "anoth", "\ufeffpara"]
    names = {r.filename for r in spark.read.parquet(str(tmp_path / "ev")).collect()}
    assert names == {"100001-200001.txt", "notes.txt", "more.txt"}
    small = {"max_words": 12, "min_words": 6}
    run = jobs.run_messages(with_url(messages(spark, ALL[0])), files(spark), table, **small)
    for again in (None, run):
        jobs.run_messages(with_url(messages(spark, ALL[0])), files(spark), table, again, **small)
    assert read_vectors(spark, table).count() == 3 + 2 * 3


def test_files_of_one_url(spark):
    two = files(spark).union(spark.createDataFrame([("http://n/webhdfs/v1/x.txt?op=LISTSTATUS", "other")], "url string, content string"))
    one = one_per_url(two)
    assert one.count() == 5 and one.filter("content = 'other'").count() == 1
    assert load_content(with_url(messages(spark, *ALL)), one).count() == 7


def test_url_has_to_be_a_scalar(spark):
    bodies = ['{"url":{"a":1}}', '{"url":["/a"]}', '{"url":"/a"}', '{"url":"{x"}', '{"url":7}', '{"url":" "}', '{"url":null}']
    rows = with_url(spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "msg_id long, body string"))
    assert {r.msg_id: r.url for r in rows.collect()} == {2: "/a", 3: "{x", 4: "7"}


def test_stream_ingest_goes_on_where_it_stopped(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    out = str(tmp_path / "out")

    def send(name, *urls):
        (inbox / name).write_text("\n".join(json.dumps({"url": u}) for u in urls) + "\nnot json\n")

    def run():
        source = stream_messages(spark, str(inbox), files_at_once=1)
        si.stream_ingest(source, files(spark), f"{out}/t", f"{out}/ev", f"{out}/c",
                         max_words=12, min_words=6, query_text="five words", answer=f"{out}/answer")
        return read_vectors(spark, f"{out}/t")

    send("1.json", ALL[0], ALL[4])
    assert run().count() == 3
    answer = {tuple(r) for r in spark.read.parquet(f"{out}/answer").collect()}
    send("2.json", ALL[1])
    send("3.json", ALL[2])
    assert run().count() == 9
    assert {tuple(r) for r in spark.read.parquet(f"{out}/answer").collect()} == answer
    assert [r.error for r in read_errors(spark, f"{out}/t").collect()] == ["content not found"]
    assert spark.read.parquet(f"{out}/ev").count() == 3
    assert run().count() == 9
    send("4.json", ALL[0], ALL[2], ALL[5])  # two of them come again
    assert run().count() == 12
    other = tmp_path / "inbox2"
    other.mkdir()
    (other / "1.json").write_text(json.dumps({"url": ALL[1]}) + "\n" + json.dumps({"url": ALL[0].replace("100001", "100009")}))
    more = files(spark).union(spark.createDataFrame([(ALL[0].replace("100001", "100009"), LONG)], "url string, content string"))
    si.stream_ingest(stream_messages(spark, str(other)), more, f"{out}/t", f"{out}/ev", f"{out}/c2", max_words=12, min_words=6)
    rows = read_vectors(spark, f"{out}/t")
    assert rows.count() == 15 and rows.select("id").distinct().count() == 15


def test_stream_of_text_files(spark, folder, tmp_path):
    out = str(tmp_path / "copy")
    stream = stream_text_dir(spark, folder, files_at_once=1)
    run_available(stream.writeStream.foreachBatch(batch_folder(out)), str(tmp_path / "c"))
    contents = {r.content for r in spark.read.parquet(out).collect()}
    assert contents - {""} == {"﻿" + LONG, "a few words"}


def events_file(spark, path, *rows):
    made = spark.createDataFrame([(i, s, e) for i, (s, e) in enumerate(rows)], "event_id long, sec int, event string")
    made.select(
        "event_id", F.timestamp_seconds("sec").alias("ts"), F.lit("s").alias("service"),
        F.concat(F.lit("i"), (F.col("event_id") % 2).cast("string")).alias("instance_id"), "event",
    ).coalesce(1).write.mode("append").parquet(path)


def test_liveness_over_two_runs(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("src", "out", "c"))
    events_file(spark, source, (100, "INIT"), (100, "INIT"))
    stream = lambda: spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    sm.stream_liveness(stream(), out, check, now_us=110_000_000)
    events_file(spark, source, (190, "CHUNK_COMPLETE"))
    found = sm.stream_liveness(stream(), out, check, now_us=200_000_000)
    rows = {r.instance_id: (r.last_activity, r.last_heartbeat, r.liveness, r.heartbeat_stale) for r in found.collect()}
    assert rows["i0"] == (190_000_000, 100_000_000, "alive", True)
    assert rows["i1"] == (100_000_000, 100_000_000, "alive", False)


def test_an_instance_that_falls_silent_is_reported(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("src", "out", "c"))
    events_file(spark, source, (int(time.time()), "INIT"))
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    running = sm.watch_liveness(stream, out, check, every="1 second", alive=8, degraded=12, stale=5)
    try:
        seen, end = None, time.time() + 60
        while seen != "offline" and time.time() < end:
            time.sleep(1)
            if running.exception() is not None:
                raise running.exception()
            if glob.glob(f"{out}/*/_SUCCESS"):
                seen = newest_versions(spark, out, ["service", "instance_id"]).first()
                seen = seen.liveness if seen else None
    finally:
        running.stop()
    assert seen == "offline"


def test_liveness_without_names(spark, tmp_path):
    from textmill.operators import counters as ct

    rows = spark.createDataFrame(
        [(1, 100, None, "a", "INIT"), (2, 150, None, None, "ERROR"), (3, 190, "s", None, "INIT")],
        "event_id long, sec int, service string, instance_id string, event string",
    ).withColumn("ts", F.timestamp_seconds("sec")).drop("sec")
    rows.coalesce(1).write.parquet(str(tmp_path / "src"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "src"))
    found = sm.stream_liveness(stream, str(tmp_path / "out"), str(tmp_path / "c"), now_us=200_000_000)
    batch = ct.liveness(ct.instance_registry(rows), F.timestamp_seconds(F.lit(200)))
    shown = lambda table: {(r.service, r.instance_id, r.liveness) for r in table.collect()}
    assert shown(found) == shown(batch) and len(shown(batch)) == 3


def test_dedup_over_two_runs(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("src", "out", "c"))

    def run(*rows):
        made = spark.createDataFrame(rows, "sec int, url string")
        made.select(F.timestamp_seconds("sec").alias("ts"), "url").write.mode("append").parquet(source)
        stream = spark.readStream.schema("ts timestamp, url string").parquet(source)
        distinct = si.stream_dedup(stream, "1 hour")
        run_available(distinct.writeStream.foreachBatch(batch_folder(out)), check)
        return sorted(r.url for r in spark.read.parquet(out).collect())

    assert run(*[(i, "a") for i in range(50)], (3, "b")) == ["a", "b"]
    assert run((60, "a"), (61, "c")) == ["a", "b", "c"]


def test_versions_fold_into_few_folders(spark, tmp_path):
    """After a hundred batches a read opens few segments, and the table is that of all batches."""
    path, want = str(tmp_path / "v"), {}
    write = lv.versions_sink(path, ["k"], fan=4, grace=0)
    for batch in range(100):
        rows = [(k, batch) for k in {"a" if batch % 2 else None, f"k{batch % 30}", f"once{batch}"}]
        want.update(rows)
        write(spark.createDataFrame(rows, "k string, n int").coalesce(1), batch)
        if batch in (3, 17, 63):  # a batch is repeated, as after a failure
            write(spark.createDataFrame(rows, "k string, n int").coalesce(1), batch)
        if batch in (0, 5, 63, 99):
            assert {tuple(r) for r in newest_versions(spark, path, ["k"]).collect()} == set(want.items())
    there = lv._committed(spark, path)
    assert lv.cover(there) == [(0, 63), (64, 79), (80, 95), (96, 99)]
    assert lv.cover(there, below=99)[-1][1] == 98
    assert len(there) <= 2 * 4 * 4
    assert lv.open_segments(spark, str(tmp_path / "none")) is None


def test_segments_wait_for_their_readers(spark, tmp_path):
    path = str(tmp_path)
    write = lv.versions_sink(path, ["k"], fan=2)
    for batch in range(4):
        write(spark.createDataFrame([("k", batch)], "k string, n int"), batch)
    assert len(lv._committed(spark, path)) == 7
    assert lv.cover({(0, 0), (1, 1), (0, 1), (2, 2)}) == [(0, 1), (2, 2)]
    assert lv.cover({(0, 0), (1, 1), (0, 1), (2, 2)}, below=1) == [(0, 0)]


class Flaky(HashProvider):
    """A model that cannot be reached for some texts."""

    def __init__(self, word, dim=64):
        super().__init__(dim)
        self.word = word

    def __reduce__(self):
        return Flaky, (self.word, self.dim)

    def __call__(self, texts):
        if any(self.word in text for text in texts):
            raise ConnectionError("model is down")
        return super().__call__(texts)


def test_work_lost_in_an_outage_is_done_again(spark, tmp_path):
    inbox, out = tmp_path / "inbox", str(tmp_path / "out")
    inbox.mkdir()
    small = {"max_words": 12, "min_words": 6, "defaults": (1, 2)}

    def run(name, urls, provider=None, **options):
        (inbox / name).write_text("\n".join(json.dumps({"url": u}) for u in urls))
        source = stream_messages(spark, str(inbox), files_at_once=1)
        si.stream_ingest(source, files(spark), f"{out}/t", f"{out}/ev", f"{out}/c", provider=provider, **small, **options)
        rows = read_vectors(spark, f"{out}/t")
        assert rows.count() == rows.select("id").distinct().count()
        return rows.count(), {r.url: (r.outcome, r.attempts) for r in lg.read_ledger(spark, si.ledger_path(f"{out}/t")).collect()}

    n, known = run("1.json", ALL[:5], Flaky("paragraph"))
    assert n == 0 and known == {
        ALL[0]: ("failed", 1), ALL[1]: ("failed", 1), ALL[2]: ("rejected", 1), ALL[3]: ("empty", 1), ALL[4]: ("missing", 1)}
    n, known = run("2.json", ALL[:5], Flaky("paragraph 5"))  # one chunk of each file fails
    assert n == 4 and known[ALL[0]] == ("failed", 2) and known[ALL[2]] == ("rejected", 1) and known[ALL[4]] == ("missing", 2)
    n, known = run("3.json", ALL[:2])
    assert n == 6 and known[ALL[0]] == ("stored", 3)
    n, known = run("4.json", ALL, max_attempts=2)
    assert n == 9 and known[ALL[0]] == ("stored", 3) and known[ALL[4]] == ("missing", 2)
    reasons = {r.url: r.reason for r in lg.read_ledger(spark, si.ledger_path(f"{out}/t")).collect()}
    assert reasons[ALL[0]] is None and reasons[ALL[4]] == "content not found"


def test_runs_of_batch_jobs_enter_the_ledger(spark, tmp_path):
    table, inbox = str(tmp_path / "t"), tmp_path / "inbox"
    inbox.mkdir()
    small = {"max_words": 12, "min_words": 6}
    jobs.run_messages(with_url(messages(spark, ALL[0])), files(spark), table, **small)
    (inbox / "1.json").write_text(json.dumps({"url": ALL[0]}) + "\n" + json.dumps({"url": ALL[1]}))
    si.stream_ingest(stream_messages(spark, str(inbox)), files(spark), table, str(tmp_path / "ev"), str(tmp_path / "c"), **small)
    assert read_vectors(spark, table).count() == 6


def test_a_batch_reads_its_share_of_the_ledger(spark, tmp_path):
    """The ledger is opened in the parts of a batch's URLs, and URLs where a hash was met."""
    path = str(tmp_path)
    rows = spark.range(5000).select(
        F.concat(F.lit("/f/"), "id").alias("url"), F.lit(0).alias("chunk_no"), F.lit("stored").alias("outcome"),
        F.lit(None).cast("string").alias("error"))
    lg.record(spark.createDataFrame([], lg.COLUMNS), rows, path, "s", 0)
    asked = spark.createDataFrame([("/f/77",), ("/new/1",)], "url string")
    known = lg.look_up(asked, path, "s", 1)
    plan = known._jdf.queryExecution().optimizedPlan().toString()
    assert [r.url for r in known.collect()] == ["/f/77"]
    parts = {r.part for r in spark.createDataFrame([("/f/77",)], "url string").withColumns(lg._place(F.col("url"))).collect()}
    assert f"part#" in plan and all(f"= {p})" in plan or f"IN ({p})" in plan for p in parts)
    read = spark.read.parquet(lv.segment(f"{path}/s", (0, 0))).filter(F.col("part").isin(list(parts))).count()
    assert 0 < read < 5000 / 20
    assert lg.look_up(asked, path, "s", 0).count() == 0


def test_embedding_errors_are_kept_apart(spark):
    def provider(texts):
        return [[1.0, 2.0] if "3" not in t else None for t in texts]

    rows = jobs.ingest(with_url(messages(spark, ALL[0])), files(spark), max_words=5, min_words=1,
                       provider=provider, dim=2)
    assert jobs.stored(rows).count() == 5
    [bad] = jobs.rejected(rows).collect()
    assert bad.url == ALL[0] and bad.chunk_no == 3


def table_rows(spark, n, start=0):
    made = spark.range(start, start + n).select(
        F.col("id").cast("string").alias("id"), F.concat(F.lit("/f/"), "id").alias("url"), F.lit(0).alias("chunk_no"),
        (100000 + F.pmod(F.xxhash64("id"), F.lit(300))).cast("int").alias("refnum1"),
        (200000 + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(300))).cast("int").alias("refnum2"),
        F.when(F.col("id") % 10 == 0, "rejected").otherwise("stored").alias("outcome"))
    return made


def test_compaction(spark, tmp_path):
    path = str(tmp_path / "t")
    for batch in range(6):
        append_rows(table_rows(spark, 500, 500 * batch), path, "x", batch)
    ids = lambda: sorted(int(r.id) for r in read_vectors(spark, path).select("id").collect())
    want = [i for i in range(3000) if i % 10]
    assert vt.compact(spark, path) is None  # nothing is settled yet
    assert vt.compact(spark, path, settled=-60, file_bytes=8000) == 0
    assert ids() == want and read_errors(spark, path).count() == 300
    assert compaction.drop_taken(spark, path) == 0 and compaction.drop_taken(spark, path, grace=-60) == 6
    assert ids() == want and vt.read_batch(spark, path, "x", 3).count() == 500
    append_rows(table_rows(spark, 10, 3001), path, "y", 0)
    assert ids() == [*want, *[i for i in range(3001, 3011) if i % 10]]
    assert vt.compact(spark, path, settled=-60) == 1 and vt.compact(spark, path, settled=-60) is None
    # A batch that is written again counts from its folder.
    time.sleep(1.1)
    append_rows(table_rows(spark, 3, 3001), path, "y", 0)
    assert ids() == [*want, 3001, 3002, 3003]
    # Searches by number read a part of the rows: files and row groups are small squares.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        read = []
        for condition in ("refnum1 = 100007", "refnum2 = 200123", "refnum1 = 100007 and refnum2 between 200100 and 200200"):
            rows = read_vectors(spark, path).filter(condition).select("id")
            found = rows.collect()
            leaves = rows._jdf.queryExecution().executedPlan().collectLeaves()
            read.append(sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size())))
            assert len(found) == read_vectors(spark, path).select("id", "refnum1", "refnum2").toPandas().query(
                condition.replace("between 200100 and 200200", ">= 200100 and refnum2 <= 200200").replace(" = ", " == ")).shape[0]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert read[0] < 1200 and read[1] < 1200 and read[2] < read[0]


def test_curve(spark):
    bits = lambda a, b: sum((a >> i & 1) << 2 * i | (b >> i & 1) << 2 * i + 1 for i in range(31))
    cases = [(0, 0), (1, 2), (123456, 654321), (2**31 - 1, 2**31 - 1), (100003, 200007)]
    rows = spark.createDataFrame(cases, "a int, b int").select("a", "b", compaction.curve(F.col("a"), F.col("b")).alias("z"))
    assert {(r.a, r.b): r.z for r in rows.collect()} == {(a, b): bits(a, b) for a, b in cases}
    assert spark.range(1).select(compaction.curve(F.lit(None).cast("int"), F.lit(-5))).first()[0] == 0


def test_streams_know_compacted_runs(spark, tmp_path):
    table, inbox = str(tmp_path / "t"), tmp_path / "inbox"
    inbox.mkdir()
    small = {"max_words": 12, "min_words": 6}
    jobs.run_messages(with_url(messages(spark, ALL[0])), files(spark), table, **small)
    vt.compact(spark, table, settled=-60)
    compaction.drop_taken(spark, table, grace=-60)
    (inbox / "1.json").write_text(json.dumps({"url": ALL[0]}) + "\n" + json.dumps({"url": ALL[1]}))
    si.stream_ingest(stream_messages(spark, str(inbox)), files(spark), table, str(tmp_path / "ev"), str(tmp_path / "c"), **small)
    assert read_vectors(spark, table).count() == 6


def test_a_batch_of_the_file_table_is_chosen_before_it_is_embedded(spark):
    rows = file_rows(spark, "/root/testdata/sf0.001", F.col("doc_id") % 3 == 0)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("ArrowEvalPython") < plan.index("% 3")
    assert [r.m for r in rows.select((F.col("doc_id") % 3).alias("m")).distinct().collect()] == [0]


def test_text_folder_is_written_by_one_shuffle(spark, tmp_path, monkeypatch):
    """Every file has the documents of its eighth in order, whatever partitions they come in; rows without an id are in none."""
    docs = spark.createDataFrame([(i, None if i == 9 else f"text {i}", "en", "web", 5) for i in range(40)] + [(None, "x", "en", "web", 1)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(type(docs), "coalesce", None)  # no task reads the whole table
    texts = [("\n".join("" if i == 9 else f"text {i}" for i in range(n, 40, 8)) + "\n") for n in range(8)]
    found = QUERIES["scan_text_folder"](spark, str(tmp_path)).collect()
    assert sorted(r.content_md5 for r in found) == sorted(hashlib.md5(t.encode()).hexdigest() for t in texts)
