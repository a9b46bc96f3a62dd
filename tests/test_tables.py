"""Upserts, queues, audits and checks on small examples."""

import datetime as dt
import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from opslake.operators import queues, tables

AS_OF = dt.datetime(2024, 1, 31, 12)


def states(spark, rows):
    return spark.createDataFrame(rows, "agent_id string, status string, version int")


def incoming(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "agent_id string, status string, version int, seq long")


def test_first_save_gives_version_one(spark):
    merged, conflicts = tables.versioned_upsert(states(spark, []), incoming(spark, [("test1", "RUNNING", 0)]))
    assert [tuple(r) for r in merged.collect()] == [("test1", "RUNNING", 1)] and conflicts.count() == 0


def test_upsert_with_several_writes_of_one_key(spark):
    merged, conflicts = tables.versioned_upsert(
        states(spark, [("a", "old", 3), ("b", "keep", 1)]),
        incoming(spark, [("a", "x", 2), ("a", "y", 3), ("a", "z", 3), ("c", "n2", 2), ("c", "n1", 1)]))
    assert {r.agent_id: (r.status, r.version) for r in merged.collect()} == {"a": ("y", 4), "b": ("keep", 1), "c": ("n1", 2)}
    assert {(r.status, r.stored_version) for r in conflicts.collect()} == {("x", 3), ("z", 3), ("n2", None)}


def test_upsert_accepts_one_of_equal_writes(spark):
    new = incoming(spark, [("a", "y", 0), ("a", "x", 0), ("a", "x", 0)]).withColumn("seq", F.lit(1).cast("long"))
    merged, conflicts = tables.versioned_upsert(states(spark, []), new)
    assert [tuple(r) for r in merged.collect()] == [("a", "x", 1)]
    assert sorted(r.status for r in conflicts.collect()) == ["x", "y"]


row = st.tuples(st.sampled_from("abcd"), st.sampled_from(["x", "y"]), st.integers(0, 3))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(row, max_size=12), st.dictionaries(st.sampled_from("abc"), st.integers(0, 3)))
def test_upsert_properties(spark, new, old):
    current = states(spark, [(k, "s", v) for k, v in old.items()])
    merged, conflicts = tables.versioned_upsert(current, incoming(spark, new))
    got = {r.agent_id: r.version for r in merged.collect()}
    accepted = sum(got[k] != old.get(k) for k in got)
    assert set(got) == set(old) | {r[0] for r in new}
    assert all(got[k] >= v for k, v in old.items())
    assert accepted + conflicts.count() == len(new)


def test_dlq_upsert_keeps_payload_of_known_messages(spark):
    shape = "message_id string, payload string, retries int, last_attempt timestamp, permanent_failure boolean, ts timestamp"
    old = spark.createDataFrame([("m1", "p", 0, None, False, AS_OF)], shape)
    new = spark.createDataFrame([("m1", "other", 1, AS_OF, False, AS_OF), ("m2", "first", 0, None, False, AS_OF),
                                 ("m2", "second", 4, AS_OF, True, AS_OF + dt.timedelta(seconds=1))], shape)
    got = {r.message_id: (r.payload, r.retries, r.permanent_failure) for r in queues.dlq_upsert(old, new, "ts").collect()}
    assert got == {"m1": ("p", 1, False), "m2": ("first", 4, True)}


def test_retry_pass(spark):
    shape = ("message_id string, original_topic string, failure_reason string, retries int, last_attempt timestamp, "
             "permanent_failure boolean, ts timestamp")
    letters = spark.createDataFrame([(f"m{i}", "orders", "down", i, None, False, AS_OF) for i in range(6)], shape)
    outcomes = spark.createDataFrame([("m0", True), ("m1", False), ("m2", False), ("m4", False)], "message_id string, delivered boolean")
    left, alerts = queues.dlq_retry_pass(letters, outcomes, AS_OF)
    assert {r.message_id: (r.retries, r.permanent_failure) for r in left.collect()} == {
        "m1": (2, False), "m2": (3, False), "m3": (3, False), "m4": (5, True), "m5": (5, False)}
    got = {r.message_id: (r.is_final, r.text) for r in alerts.collect()}
    assert got == {"m2": (False, "WARNING: Message m2 failed 3 times. Last error: down"),
                   "m4": (True, "PERMANENT FAILURE: Message m4 failed 5 times. Last error: down")}


def test_retriable_waiting_time(spark):
    shape = "message_id string, retries int, last_attempt timestamp, permanent_failure boolean, ts timestamp"
    ago = AS_OF - dt.timedelta(seconds=5)
    df = spark.createDataFrame([("never", 0, None, False, AS_OF), ("recent", 1, ago, False, AS_OF), ("old", 4, ago - dt.timedelta(seconds=1), False, AS_OF),
                                ("spent", 5, None, False, AS_OF), ("dead", 0, None, True, AS_OF)], shape)
    assert {r.message_id for r in queues.retriable(df, AS_OF).collect()} == {"never", "old"}
    assert {r.message_id for r in queues.retriable(df, AS_OF, per_message=True).collect()} == {"never", "recent"}


def test_task_life(spark):
    shape = "task_id string, priority int, status string, retries int, last_attempt timestamp, next_attempt timestamp, updated_at timestamp"
    later = AS_OF + dt.timedelta(seconds=9)
    df = spark.createDataFrame([("a", 100, "pending", 0, None, None, AS_OF), ("b", 10, "pending", 0, None, later, AS_OF),
                                ("c", 10, "processing", 2, None, None, AS_OF), ("d", 10, "processing", 3, None, None, AS_OF)], shape)
    assert [r.task_id for r in queues.next_tasks(df, 5).collect()] == ["b", "a"]
    assert [r.task_id for r in queues.next_tasks(df, 5, AS_OF).collect()] == ["a"]
    failed = {r.task_id: r for r in queues.task_fail_pass(df.filter("status = 'processing'"), AS_OF).collect()}
    assert (failed["c"].status, failed["c"].retries) == ("pending", 3)
    assert failed["c"].next_attempt == AS_OF + dt.timedelta(seconds=1.5 ** 2)
    assert (failed["d"].status, failed["d"].retries) == ("failed", 3)
    started = queues.start_tasks(df, df.filter("task_id = 'a'"), AS_OF)
    assert {r.task_id: r.status for r in queues.complete_tasks(started, df.filter("task_id = 'c'"), AS_OF).collect()} == {
        "a": "processing", "b": "pending", "c": "completed", "d": "processing"}


def test_dynamic_priority_cuts_hours(spark):
    df = spark.createDataFrame([(100, 0, AS_OF - dt.timedelta(hours=5)), (10, 2, AS_OF - dt.timedelta(minutes=119))],
                               "priority int, retries int, created_at timestamp")
    assert [r[0] for r in df.select(queues.dynamic_priority(AS_OF)).collect()] == [102, 14]


def test_audit_diff(spark):
    old = spark.createDataFrame([("1", "a", 1), ("2", "b", None), ("3", "c", 3)], "id string, name string, n int")
    new = spark.createDataFrame([("1", "a", 1), ("2", "x", 5), ("3", None, 3)], "id string, name string, n int")
    got = {r.model_id: [tuple(d) for d in r.diff] for r in tables.audit_diff(old, new, "id", ["name", "n"], "Agent").collect()}
    assert got == {"2": [("name", "b", "x"), ("n", None, "5")], "3": [("name", "c", None)]}


def test_json_patch_keeps_other_fields(spark):
    df = spark.createDataFrame([('{"a": 1, "b": {"c": [1, 2]}, "d": null}', "x")], "body string, who string")
    got = json.loads(tables.json_patch(df, "body", {"a": F.lit(2.5), "who": F.col("who")}).first()["body"])
    assert got == {"a": 2.5, "b": {"c": [1, 2]}, "d": None, "who": "x"}
    assert tables.json_patch(df, "body", {}).first()["body"] == '{"a": 1, "b": {"c": [1, 2]}, "d": null}'


def test_check_constraints_one_row_per_failure(spark):
    df = spark.createDataFrame([("1", None, "idle"), ("2", "x" * 11, "gone"), ("3", "ok", None)], "id string, name string, status string")
    got = tables.check_constraints(df, "id", {"name_required": tables.not_null("name"), "name_length": tables.max_length("name", 10),
                                              "status": tables.one_of("status", ["idle", "busy"])})
    assert {tuple(r) for r in got.collect()} == {("1", "name_required"), ("2", "name_length"), ("2", "status")}


def test_illegal_transitions(spark):
    log = spark.createDataFrame([("a", 1, "INITIALIZED"), ("a", 2, "RUNNING"), ("a", 3, "INITIALIZED"), ("b", 1, "RUNNING"),
                                 ("b", 2, "ERROR"), ("b", 3, "STOPPED"), ("b", 4, "RUNNING")], "agent_id string, seq long, state string")
    got = {(r.agent_id, r.seq, r.previous) for r in tables.illegal_transitions(log).collect()}
    assert got == {("a", 3, "RUNNING"), ("b", 1, "CREATED"), ("b", 4, "STOPPED")}


def test_filters(spark):
    df = spark.createDataFrame([("1", "IDLE", {"task": "ML"}), ("2", "busy", {"task": "ml"}), ("3", "idle", {"task": "etl"})],
                               "id string, status string, caps map<string,string>")
    assert [r.id for r in tables.list_agents(df, "status=IDLE, caps.task=ML").collect()] == ["1"]
    assert [r.id for r in tables.list_agents(df, "", 2, "1").collect()] == ["2", "3"]
    assert df.filter(tables.metadata_filter({})).count() == 3
    assert [r.id for r in df.filter(tables.metadata_filter({"task": ["etl", "x"]}, tables.map_field("caps"))).collect()] == ["3"]
    assert tables.apply_filters(df, {"s": ("status", "eq")}, {"s": "idle", "other": 1}).count() == 1
