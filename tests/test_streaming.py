"""Streaming jobs over file sources: same results as batch, restart, timeouts."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from opslake.operators import ordered, security
from opslake.plans import catalog
from opslake.plans.q_events import by_time, in_turn
from opslake.plans.q_security import POLICIES
from opslake.plans.views import Tables
from opslake.sources import readers
from opslake.sources.keyed import KeyedTable
from opslake.streaming import jobs

FOLDER = "/root/testdata/sf0.001"
DAY = dt.datetime(2024, 1, 1)


def put(spark, path, name, rows, shape):
    spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(f"{path}/{name}")


def stream(spark, path, shape, **options):
    return spark.readStream.schema(shape).options(**options).parquet(f"{path}/*")


def run(df, checkpoint, out, mode="append"):
    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    jobs.start(df, checkpoint, keep, mode=mode, once=True).awaitTermination()


def test_etl_survives_a_restart(spark, tmp_path):
    source, good, bad, offsets = (str(tmp_path / n) for n in ("in", "good", "bad", "offsets"))
    metadata = spark.createDataFrame([("d1", "hall", "m1")], "device_id string, location string, model string")

    def once():
        jobs.stream_etl(stream(spark, source, "value string"), metadata, good, bad, offsets, DAY, once=True).awaitTermination()

    first = [json.dumps({"event_id": "1", "timestamp": 1704067200, "device_id": "d1", "x": [1]}), json.dumps({"event_id": "2"}), "}{", None,
             json.dumps({"event_id": "3", "timestamp": 1e300, "device_id": None})]
    put(spark, source, "a", [(v,) for v in first], "value string")
    once()
    put(spark, source, "b", [(json.dumps({"event_id": "4", "timestamp": "2024-01-02 00:00:00", "device_id": "d2"}),)], "value string")
    once()
    once()
    got = {r.event_id: (r.device_id, r.timestamp, r.location, r.model) for r in jobs.read_written(spark, good).collect()}
    assert got == {"1": ("d1", DAY, "hall", "m1"), "3": (None, None, "unknown", "default"),
                   "4": ("d2", DAY + dt.timedelta(days=1), "unknown", "default")}
    rejects = [json.loads(r.value) for r in jobs.read_written(spark, bad).collect()]
    assert sorted(r.get("original", "") for r in rejects) == ["", '{"event_id": "2"}', "}{"]
    assert {r["error"] for r in rejects} == {"Missing required fields"} and {r["timestamp"] for r in rejects} == {1704067200.0}


def test_history_over_batches_is_bounded(spark, tmp_path):
    shape = "device_id string, ts timestamp, event_id string"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(2):
        put(spark, source, f"p{part}", [("d", DAY + dt.timedelta(seconds=part * 100 + i), f"e{part}{i}") for i in range(4)], shape)
        run(jobs.stream_history(stream(spark, source, shape), last=5), str(tmp_path / "offsets"), out, "update")
    rows = spark.read.parquet(f"{out}/batch=*").collect()
    assert sorted(map(len, (r.history for r in rows))) == [4, 5]
    assert max(rows, key=lambda r: len(r.history)).history == ["e03", "e10", "e11", "e12", "e13"]


def test_stream_blocks_equal_batch_blocks(spark, tmp_path):
    access = Tables(spark, FOLDER)("v_access").orderBy("event_id")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(4):
        access.filter(F.floor(F.col("event_id") / 250) == part).coalesce(1).write.mode("append").parquet(f"{source}/p{part}")
        rows = jobs.watermarked(stream(spark, source, access.schema), "ts")
        run(jobs.stream_blocks(rows, POLICIES), str(tmp_path / "offsets"), out)
    got = {r.event_id: (r.decision, r.reason, r.rule_id) for r in jobs.read_written(spark, out).collect()}
    batch = security.firewall_blocks(access, POLICIES, bucket=ordered.by_time("ts", 3600))
    assert got == {r.event_id: (r.decision, r.reason, r.rule_id) for r in batch.collect()}


def test_silent_clients_expire(spark, tmp_path):
    shape = "agent_id string, ts timestamp"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part, rows in enumerate([[("a", 0), ("b", 0)], [("b", 40)], [("b", 80)]]):
        put(spark, source, f"p{part}", [(k, DAY + dt.timedelta(seconds=s)) for k, s in rows], shape)
        run(jobs.stream_heartbeats(jobs.watermarked(stream(spark, source, shape)), 30), str(tmp_path / "offsets"), out)
    got = {(r.agent_id, r.last_seen) for r in jobs.read_written(spark, out).collect()}
    assert ("a", DAY) in got and all(k == "b" or t == DAY for k, t in got)


def test_sla_in_append_mode(spark, tmp_path):
    shape = "service string, ts timestamp, success boolean, latency double"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("s", DAY + dt.timedelta(seconds=i), i % 10 != 0, i / 100) for i in range(600)]
    put(spark, source, "a", rows, shape)
    put(spark, source, "b", [("s", DAY + dt.timedelta(seconds=1200), True, 1.0)], shape)
    run(jobs.stream_sla(jobs.watermarked(stream(spark, source, shape))), str(tmp_path / "offsets"), out)
    got = {r.slice_start: (r.availability, r.throughput, r.latency_p99) for r in jobs.read_written(spark, out).collect()}
    assert got == {DAY: (90.0, 1.0, 2.96), DAY + dt.timedelta(seconds=300): (90.0, 1.0, 5.96)}


def test_log_anomalies_per_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = ['{"level": "ERROR", "message": "boom 1"}'] * 3 + ["all fine 7"] * 5 + ['{"timestamp": 1e300, "message": "odd"}']
    (tmp_path / "in" / "a.log").write_text("\n".join(lines))
    source = readers.read_logs(spark, str(tmp_path / "in"), streaming=True, max_files=1).withColumn("ts", F.lit(DAY))
    job = jobs.stream_log_anomalies(source, str(tmp_path / "out"), str(tmp_path / "offsets"), lambda: DAY, frequency=4, once=True)
    job.awaitTermination()
    got = {(r.type, r.pattern, round(r.value, 4)) for r in jobs.read_written(spark, str(tmp_path / "out")).collect()}
    assert got == {("error_rate", None, round(3 / 9, 4)), ("frequency", "all fine <NUM>", 5.0)}


def test_log_anomalies_count_across_batches(spark, tmp_path):
    """1200 lines of one pattern over three batches are reported once they are more than a thousand."""
    (tmp_path / "in").mkdir()
    for part in range(3):
        (tmp_path / "in" / f"{part}.log").write_text("\n".join([f"disk {part} full"] * 400 + ['{"level": "ERROR", "message": "e"}']))
    source = readers.read_logs(spark, str(tmp_path / "in"), streaming=True, max_files=1).withColumn("ts", F.lit(DAY))
    jobs.stream_log_anomalies(source, str(tmp_path / "out"), str(tmp_path / "offsets"), lambda: DAY, error_rate=0.002, once=True).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("batch", "type").collect()
    assert [(r.batch, r.type, r.pattern, round(r.value, 6)) for r in rows] == [
        *[(b, "error_rate", None, round(1 / 401, 6)) for b in range(3)], (2, "frequency", "disk <NUM> full", 1200.0)]


def test_delivery_falls_over_and_batches_are_bounded(spark, tmp_path):
    source = str(tmp_path / "in")
    for part in range(3):
        put(spark, source, f"p{part}", [(part,)], "n int")
    sizes = []

    def broken(df, batch_id):
        raise OSError("down")

    events = stream(spark, source, "n int", maxFilesPerTrigger="1")
    jobs.stream_deliver(events, [("a", broken), ("b", lambda d, n: sizes.append(d.count()))], broken, str(tmp_path / "offsets"),
                        once=True).awaitTermination()
    assert sizes == [1, 1, 1]


def test_stream_dedupe(spark, tmp_path):
    shape = "event_id string, event_time timestamp"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(2):
        put(spark, source, f"p{part}", [("a", DAY), (f"b{part}", DAY), ("a", DAY)], shape)
        run(jobs.dedupe_stream(stream(spark, source, shape)), str(tmp_path / "offsets"), out)
    assert sorted(r.event_id for r in jobs.read_written(spark, out).collect()) == ["a", "b0", "b1"]


def test_failed_batch_is_repeated_without_loss(spark, tmp_path):
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), {"fail": True}
    put(spark, source, "a", [(i,) for i in range(10)], "n int")

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        if state["fail"]:
            raise OSError("lost after writing")

    with pytest.raises(Exception):
        jobs.start(stream(spark, source, "n int"), str(tmp_path / "offsets"), write, once=True).awaitTermination()
    state["fail"] = False
    jobs.start(stream(spark, source, "n int"), str(tmp_path / "offsets"), write, once=True).awaitTermination()
    assert sorted(r.n for r in jobs.read_written(spark, out).collect()) == list(range(10))


def test_upsert_over_batches(spark, tmp_path):
    shape = "agent_id string, status string, version int, seq long"
    source, table, offsets = (str(tmp_path / n) for n in ("in", "table", "offsets"))
    table = KeyedTable(spark, table, "agent_id", buckets=4)
    table.create(spark.createDataFrame([("a", "old", 1)], "agent_id string, status string, version int"))
    for part, rows in enumerate([[("a", "x", 1, 1), ("b", "new", 0, 2)], [("a", "y", 1, 3), ("a", "z", 2, 4), ("b", "n2", 1, 5)]]):
        put(spark, source, f"p{part}", rows, shape)
        jobs.stream_upsert(stream(spark, source, shape), table, str(tmp_path / "conflicts"), offsets, once=True).awaitTermination()
    got = {r.agent_id: (r.status, r.version) for r in table.read().collect()}
    assert got == {"a": ("z", 3), "b": ("n2", 2)}
    rejected = jobs.read_written(spark, str(tmp_path / "conflicts")).collect()
    assert [(r.agent_id, r.status, r.stored_version) for r in rejected] == [("a", "y", 2)]


def test_history_reads_and_writes_its_state_once_a_batch():
    calls = []

    class Value:
        held = None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

    class Handle:
        def getValueState(self, name, schema):
            return Value()

    processor = jobs._History("device_id", 3, "event_id", "_at", False)
    processor.init(Handle())
    for first, want in ((0, ["e0", "e1"]), (2, ["e1", "e2", "e3"])):
        rows = [{"_at": n, "event_id": f"e{n}"} for n in (first + 1, first)]
        assert [r.history for r in processor.handleInputRows(("d",), iter(rows), None)] == [want]
    assert calls == ["get", "update"] * 2


def test_parts_in_turn_are_batches_of_many_files(spark, tmp_path):
    rows = spark.range(0, 300, 1, 4).select("id", F.timestamp_seconds("id").alias("ts"))
    seen = []

    def count(batch, batch_id):
        named = batch.select("id", F.input_file_name().alias("file"))
        seen.append(named.agg(F.min("id"), F.max("id"), F.count("id"), F.countDistinct("file")).first()[:])

    in_turn(by_time(rows.repartition(4), "ts"), str(tmp_path / "in"), lambda part: jobs.start(part, str(tmp_path / "offsets"), count, once=True))
    assert [n for _, _, n, _ in seen] == [last - first + 1 for first, last, _, _ in seen] and sum(n for _, _, n, _ in seen) == 300
    assert len(seen) == 3 and [first for first, *_ in seen] == sorted(first for first, *_ in seen)
    assert min(files for *_, files in seen) > 1


def test_history_query_keeps_a_thousand_ids_and_events_without_a_time(spark, tmp_path):
    at = [None if n < 12 else DAY + dt.timedelta(seconds=n // 3) for n in range(1030)]  # three of one time each
    rows = [(n, at[n], 1, "click", 1.0, None) for n in range(1030)] + [(2000 + n, at[n], 2, "click", 1.0, None) for n in range(300)]
    shape = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, shape).repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    got = {r["device_id"]: r["history"] for r in catalog.QUERIES["stream_history"](spark, str(tmp_path)).collect()}
    assert got == {"d1": ",".join(f"e{n}" for n in range(30, 1030)), "d2": ",".join(f"e{2000 + n}" for n in range(300))}
