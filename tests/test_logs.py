"""Ordered logs, control history and metrics."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from textmill.operators import control as co
from textmill.operators import counters as ct
from textmill.operators.ordered import BLOCK, OrderedLog
from textmill.sources import metrics_log as ml


@pytest.mark.parametrize("width", [1, 20, 10_000])
def test_scan_equals_a_plain_window(spark, width):
    made = random.Random(3)
    rows = [(made.choice(["hot"] * 5 + ["a", "b", None]), made.randrange(300), i,
             made.randrange(5), made.choice([None, None, f"v{i}"])) for i in range(3000)]
    log = spark.createDataFrame(rows, "k string, ts int, id int, n int, v string")
    log = log.withColumn("ts", F.when(F.col("id") % 50 != 0, F.col("ts")))
    ordered = OrderedLog(log, ["k"], ["ts", "id"], width)
    assert ordered.rows.select(BLOCK).distinct().count() == (301 if width == 1 else 16 if width == 20 else 2)
    found = ordered.scan(
        sums={"total": F.col("n")}, lasts={"newest": F.col("v")},
        previous={"before": F.col("v")}, nexts={"upcoming": F.col("v")}).result()
    w = Window.partitionBy("k").orderBy("ts", "id")
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    expected = log.select(
        "*", F.sum("n").over(up_to).alias("total"), F.last("v", True).over(up_to).alias("newest"),
        F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.first("v", True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("upcoming"))
    assert sorted(found.collect(), key=str) == sorted(expected.collect(), key=str)


def commands(spark, *rows):
    return spark.createDataFrame(
        [(i, i, inst, command, reason) for i, (inst, command, reason) in enumerate(rows)],
        "cmd_id int, ts int, instance_id string, command string, reason string")


def test_control_history(spark):
    log = commands(spark, ("a", "stop", None), ("a", "start", " "), ("a", "start", "again"),
                   ("a", "toggle", None), ("a", "toggle", ""), ("b", "toggle", "why"), ("a", "stop", None))
    changes = co.state_transitions(log).orderBy("cmd_id").collect()
    assert [(r.cmd_id, r.previous_enabled, r.enabled, r.reason) for r in changes] == [
        (1, False, True, "Processing enabled via API"),
        (3, True, False, "Processing toggled off via API"),
        (4, False, True, "Processing toggled on via API"),
        (5, False, True, "why"),
        (6, True, False, "Processing disabled via API")]
    log = log.union(spark.createDataFrame([(90, 90, "c", "stop", None), (91, 91, None, "reset", None)], log.schema))
    final = {r.instance_id: (r.enabled, r.control_status, r.last_changed, r.last_change_reason) for r in co.final_state(log).collect()}
    assert final == {
        "a": (False, "STOPPED", 6, "Processing disabled via API"), "b": (True, "STARTED", 5, "why"),
        "c": (False, "STOPPED", None, None), None: (False, "STOPPED", None, None)}


@pytest.mark.parametrize("width", [1, 30, 3600])
def test_random_control_history(spark, monkeypatch, width):
    monkeypatch.setattr(OrderedLog.__init__, "__defaults__", (width,))
    made = random.Random(4)
    rows = [(made.choice(["a", "a", "b", None]), made.choice(["start", "stop", "toggle", "toggle", "reset"]), None)
            for _ in range(400)]
    state, expected = {}, []
    for inst, command, _ in rows:
        now = state.get(inst, False)
        now = {"start": True, "stop": False, "toggle": not now}.get(command, now)
        state[inst] = now
        expected.append(now)
    found = co.control_state(commands(spark, *rows)).orderBy("cmd_id").collect()
    assert [r.enabled for r in found] == expected


def test_gate(spark):
    log = spark.createDataFrame(
        [(1, 10, "a", "start"), (2, 20, "a", "stop"), (3, 30, "a", "start")],
        "cmd_id int, ts int, instance_id string, command string").withColumn("reason", F.lit(None).cast("string"))
    messages = spark.createDataFrame(
        [(1, 5, "a"), (2, 10, "a"), (3, 25, "a"), (4, 40, "a"), (5, 1, "b")], "msg_id int, ts int, instance_id string")
    found = {r.msg_id: (r.status, r.consumed_at) for r in co.gate_messages(messages, log).collect()}
    assert found == {1: ("STOPPED", 10), 2: ("STARTED", 10), 3: ("STOPPED", 30),
                     4: ("STARTED", 40), 5: ("STOPPED", None)}


def test_counters_after_a_reset(spark):
    events = spark.createDataFrame(
        [(1, 1, "s", "i", "CHUNK_COMPLETE", "f", None, 5, 2, 0, 0),
         (2, 2, "s", "i", "ERROR", None, "oops", 0, 0, 1, 0),
         (3, 3, "s", "i", "RESET", None, None, 0, 0, 0, 0),
         (4, 4, "s", "i", "CHUNK_COMPLETE", "g", None, 1, 1, 0, 0)],
        "event_id int, ts int, service string, instance_id string, event string, filename string, "
        "error_text string, total_delta long, processed_delta long, error_delta long, files_delta long")
    rows = ct.counters_since_reset(events).orderBy("event_id").collect()
    assert [(r.total_chunks, r.error_count, r.current_file, r.last_error) for r in rows] == [
        (5, 0, "f", None), (5, 1, None, "oops"), (0, 0, None, None), (1, 0, "g", None)]


def test_metrics_round_trip(spark):
    bodies = spark.createDataFrame([
        (1, '{"instanceId":"i","timestamp":1,"event":"INIT","status":"IDLE","url":"u","extra":[1],'
            '"meta":{"service":"s","processingStage":"p","tags":{}}}'),
        (2, '{"instanceId":"i","timestamp":"t","event":"INIT","status":"IDLE","url":"u","meta":{"service":"s"}}'),
        (3, "{broken"), (4, None)], "n int, body string")
    good = ml.parse_metrics(bodies).collect()
    assert [(r.n, r.instanceId, r.timestamp, r.filename) for r in good] == [(1, "i", "1", None)]
    bad = {r.n: r.missing for r in ml.invalid_metrics(bodies).collect()}
    assert bad[2] == "meta.processingStage" and bad[3].startswith("instanceId,") and 4 in bad
    again = ml.events_to_json(ml.parse_metrics(bodies)).first().body
    assert '"filename"' not in again and '"service":"s"' in again


def test_metrics_file(spark, tmp_path):
    events = spark.createDataFrame([("i", "INIT", None)], "instanceId string, event string, filename string")
    for _ in range(2):
        ml.write_metrics(events, str(tmp_path / "log"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "log")).collect()]
    assert lines == ['{"instanceId":"i","event":"INIT"}'] * 2


def test_union_fills_missing_fields(spark):
    a = spark.createDataFrame([(1, "x")], "id int, filename string")
    b = spark.createDataFrame([(2,)], "id int")
    assert {tuple(r) for r in ml.union_metrics(a, b).collect()} == {(1, "x"), (2, None)}


def test_registry_and_liveness(spark):
    rows = spark.createDataFrame(
        [(1, 100, "s", "a", "INIT", None, None, "h"), (2, 170, "s", "a", "ERROR", None, "p.org", "h"),
         (3, 50, "s", "b", "ERROR", "http://own", None, None)],
        "event_id int, sec int, service string, instance_id string, event string, url string, "
        "public_hostname string, hostname string").withColumn("ts", F.timestamp_seconds("sec"))
    registry = ct.instance_registry(rows)
    found = {r.instance_id: r for r in ct.liveness(registry, F.timestamp_seconds(F.lit(180))).collect()}
    assert (found["a"].event, found["a"].liveness, found["a"].heartbeat_stale) == ("ERROR", "alive", True)
    assert (found["b"].liveness, found["b"].heartbeat_stale, found["b"].last_heartbeat) == ("offline", True, None)
    urls = [r.url for r in ct.with_address(rows).orderBy("event_id").collect()]
    assert urls == ["http://h:8080", "http://p.org:8080", "http://own"]


def test_heartbeat_gaps(spark):
    rows = spark.createDataFrame(
        [(1, 100, "INIT"), (2, 105, "ERROR"), (3, 121, "HEARTBEAT"), (4, 130, "HEARTBEAT")],
        "event_id int, sec int, event string").select(
        "event_id", F.timestamp_seconds("sec").alias("ts"), F.lit("s").alias("service"),
        F.lit("i").alias("instance_id"), "event")
    found = [(r.event_id, r.gap_seconds, r.stale) for r in ct.heartbeat_gaps(rows).orderBy("event_id").collect()]
    assert found == [(1, None, None), (3, 21.0, True), (4, 9.0, False)]
    unnamed = rows.withColumns({"service": F.lit(None).cast("string"), "instance_id": F.lit(None).cast("string")})
    assert ct.heartbeat_gaps(unnamed).count() == 3


def test_fields_without_a_name_in_the_schema(spark):
    import json

    from textmill.sources.metrics_log import events_to_json, parse_metrics

    event = {"instanceId": "i", "timestamp": "t", "event": "INIT", "status": "IDLE", "url": "u"}
    bodies = [
        {**event, "meta": {"service": "s", "processingStage": "p"}},
        {**event, "n": 1, "text": "1", "flag": False, "list": [1, {"a": None}], "none": None,
         "meta": {"service": "s", "processingStage": "p", "deep": {"x": [1.5, "é\\"]}}},
    ]
    rows = spark.createDataFrame([(json.dumps(b),) for b in bodies], "body string")
    kept = [json.loads(r.body) for r in events_to_json(parse_metrics(rows, extra=True)).collect()]
    bodies[1].pop("none"), [b.pop("none", None) for b in kept]
    assert sorted(kept, key=len) == bodies
    assert "extra" not in parse_metrics(rows).columns

