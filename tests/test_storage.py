"""Readers, writers, jobs and snapshots on real files."""

import datetime as dt
import gzip
import json
import os
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from opslake.operators import features
from opslake.plans import etl_job
from opslake.sources import readers, sinks, snapshots

AS_OF = dt.datetime(2024, 1, 31)


@pytest.fixture
def events(spark, tmp_path):
    rows = [("e1", dt.datetime(2024, 1, 5, 1), "u1", 2000.0, "web"), ("e1", dt.datetime(2024, 1, 5, 2), "u9", 1.0, "web"),
            ("e2", dt.datetime(2024, 1, 6), None, None, "app"), ("e3", dt.datetime(2024, 1, 1), "u3", 5.0, "app"),
            ("e4", None, "u4", -1.0, "app"), ("e5", dt.datetime(2024, 1, 7), "u5", -7.0, "app")]
    path = str(tmp_path / "events")
    spark.createDataFrame(rows, "event_id string, event_time timestamp, user_id string, value double, source_system string"
                          ).write.parquet(path)
    return path


def config(events, tmp_path, day="2024-01-05"):
    return etl_job.EtlConfig(events, str(tmp_path / "out"), day, str(tmp_path / "metrics"), "run-1")


def test_run_etl_writes_partitions_and_metrics(spark, events, tmp_path):
    got = etl_job.run_etl(spark, config(events, tmp_path), AS_OF)
    assert got == {"row_count": 3, "null_user_ids": 1, "negative_values": 1}
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.event_id, r.value_category, r.source_system) for r in out.collect()} == {
        ("e1", "HIGH", "web"), ("e2", "NORMAL", "app"), ("e5", "NORMAL", "app")}
    names = {r.metric_name: r.metric_value for r in spark.read.parquet(str(tmp_path / "metrics")).collect()}
    assert names == {"row_count": "3", "null_user_ids": "1", "negative_values": "1"}
    files = list(Path(tmp_path / "out").rglob("*.parquet"))
    assert files and all(".zstd." in f.name for f in files)


def test_rewrite_of_a_day_leaves_no_stale_partition(spark, events, tmp_path):
    etl_job.run_etl(spark, config(events, tmp_path), AS_OF)
    only_app = str(tmp_path / "only_app")
    spark.read.parquet(events).filter("source_system = 'app'").write.parquet(only_app)
    etl_job.run_etl(spark, config(only_app, tmp_path), AS_OF)
    spark.catalog.clearCache()
    assert {r[0] for r in spark.read.parquet(str(tmp_path / "out")).select("source_system").collect()} == {"app"}


def test_empty_input_is_an_error_with_metrics(spark, events, tmp_path):
    with pytest.raises(etl_job.NothingLeft):
        etl_job.run_etl(spark, config(events, tmp_path, "2030-01-01"), AS_OF)
    assert spark.read.parquet(str(tmp_path / "metrics")).filter("metric_name = 'row_count'").first()["metric_value"] == "0"


def test_daily_run_skips_checks_in_dev(spark, events, tmp_path):
    called = []
    out = etl_job.daily_run(spark, config(events, tmp_path), AS_OF, "dev", lambda s: called.append(1) or False)
    assert out["metrics"]["row_count"] == 3 and not called
    with pytest.raises(ValueError):
        etl_job.daily_run(spark, config(events, tmp_path), AS_OF, "prod", lambda s: False)
    full = etl_job.daily_run(spark, config(events, tmp_path), AS_OF, "prod", lambda s: True, lambda s: s.range(1))
    assert full["compliance"].count() == 1


def test_read_events_globs_and_fixed_schema(spark, events):
    df = readers.read_events(spark, [events + "/*.parquet"])
    assert df.columns == [f.name for f in readers.EVENT_SCHEMA] and df.count() == 6


@pytest.mark.parametrize("suffix", ["csv", "parquet", "feather", "fea"])
def test_read_auto(spark, tmp_path, suffix):
    pdf = pd.DataFrame({"a": [1, 2, 3], "b": ["x", "y", "z"], "c": [0.5, 1.5, 2.5]})
    path = str(tmp_path / f"data.{suffix}")
    {"csv": lambda: pdf.to_csv(path, index=False), "parquet": lambda: pdf.to_parquet(path)}.get(
        suffix, lambda: pdf.to_feather(path))()
    got = readers.read_auto(spark, path, {"a": "string"}).orderBy("a")
    assert got.schema["a"].dataType.simpleString() == "string"
    assert [tuple(r) for r in got.collect()] == [("1", "x", 0.5), ("2", "y", 1.5), ("3", "z", 2.5)]


def test_read_auto_unknown_suffix(spark):
    with pytest.raises(readers.UnreadableSuffix):
        readers.read_auto(spark, "data.xls")


def test_read_logs_batch(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\ntwo\n")
    assert sorted(r.raw for r in readers.read_logs(spark, str(tmp_path / "a.log")).collect()) == ["one", "two"]


def test_connector_options():
    kafka = readers.kafka_options("b:9092", ["x", "y"], "earliest", "me", "pw", max_per_trigger=10)
    assert kafka["subscribe"] == "x,y" and kafka["startingOffsets"] == "earliest" and kafka["maxOffsetsPerTrigger"] == "10"
    assert kafka["kafka.security.protocol"] == "SASL_SSL" and 'username="me"' in kafka["kafka.sasl.jaas.config"]
    plain = readers.jdbc_options("jdbc:x", "SELECT 1")
    assert plain["query"] == "SELECT 1" and "dbtable" not in plain
    split = readers.jdbc_options("jdbc:x", "SELECT id FROM t", partition_column="id", lower=0, upper=100, partitions=4)
    assert split["numPartitions"] == "4" and "query" not in split


def test_bulk_ndjson_pairs(spark, tmp_path):
    sinks.bulk_ndjson(spark.range(25).withColumnRenamed("id", "n"), str(tmp_path / "bulk"), per_file=10)
    seen = []
    for name in sorted(os.listdir(tmp_path / "bulk")):
        if name.endswith(".gz"):
            lines = gzip.open(tmp_path / "bulk" / name, "rt").read().splitlines()
            assert 0 < len(lines) <= 20 and len(lines) % 2 == 0
            assert set(lines[::2]) == {'{"index":{}}'}
            seen += [json.loads(x)["n"] for x in lines[1::2]]
    assert sorted(seen) == list(range(25))


def test_failover_order(spark):
    seen = []

    def broken(df):
        raise OSError("down")

    df = spark.range(3)
    assert sinks.failover_write(df, [("a", broken), ("b", lambda d: seen.append(d.count()))], broken) == "b"
    assert sinks.failover_write(df, [("a", broken)], lambda d: seen.append(-d.count())) == "failed"
    assert seen == [3, -3]


def test_write_splits(spark, tmp_path):
    train, test = features.stratified_split(spark.range(100).withColumn("g", F.col("id") % 3), "g", ["id"])
    sinks.write_splits(train, test, str(tmp_path))
    a = {r.id for r in spark.read.parquet(str(tmp_path / "train.parquet")).collect()}
    b = {r.id for r in spark.read.parquet(str(tmp_path / "test.parquet")).collect()}
    assert not a & b and a | b == set(range(100)) and len(b) == 7 + 7 + 7


def test_snapshot_checks_content_and_schema(spark, tmp_path):
    root = str(tmp_path / "snap")
    df = spark.createDataFrame([("a", 1, [1.0]), ("a", 1, [1.0]), ("b", None, None)], "id string, n int, v array<double>")
    meta = snapshots.snapshot_write(df, root, "1.0.0", AS_OF)
    assert meta["row_count"] == 3 and meta["compressed"]
    assert snapshots.snapshot_read(spark, root, "1.0.0").count() == 3
    df.union(df.limit(2)).write.mode("overwrite").parquet(f"{root}/1.0.0")
    with pytest.raises(snapshots.ChecksumMismatch):
        snapshots.snapshot_read(spark, root, "1.0.0")
    df.withColumn("n", F.col("n").cast("long")).write.mode("overwrite").parquet(f"{root}/1.0.0")
    with pytest.raises(snapshots.SchemaDrift):
        snapshots.snapshot_read(spark, root, "1.0.0")
    with pytest.raises(FileNotFoundError):
        snapshots.snapshot_read(spark, root, "9.9.9")


def test_checksum_ignores_order_but_not_duplicates(spark):
    df = spark.range(1000).withColumn("x", F.col("id") * 2)
    assert snapshots.content_checksum(df) == snapshots.content_checksum(df.orderBy(F.col("id").desc()).repartition(7))
    assert snapshots.content_checksum(df)[1] != snapshots.content_checksum(df.union(df))[1]


def test_checksum_sees_nulls_move_and_reads_maps(spark):
    shape = "a long, b long, m map<string,long>"
    one, two = (spark.createDataFrame([(*ab, {"x": 1, "y": 2})], shape) for ab in ((1, None), (None, 1)))
    assert snapshots.content_checksum(one) != snapshots.content_checksum(two)
    turned = spark.createDataFrame([(1, None, {"y": 2, "x": 1})], shape)
    assert snapshots.content_checksum(one) == snapshots.content_checksum(turned)


def test_snapshot_retention(spark, tmp_path):
    root = str(tmp_path / "snap")
    for i in range(7):
        snapshots.snapshot_write(spark.range(i + 1), root, f"v{i}", AS_OF + dt.timedelta(days=i))
    assert sorted(snapshots.snapshots_to_remove(spark, root)) == ["v0", "v1"]


def test_collection_partitions_backup_and_restore(spark, tmp_path):
    root = str(tmp_path / "vec")
    df = spark.createDataFrame([("1", [1.0], "p"), ("2", [2.0], "q")], "id string, embedding array<float>, part string")
    snapshots.write_collection(df, root, "c", "part")
    assert [r.id for r in snapshots.read_collection(spark, root, "c", "part", ["q"]).collect()] == ["2"]
    snapshots.collection_backup(spark, root, "c", str(tmp_path / "bak"), AS_OF)
    assert snapshots.collection_restore(spark, str(tmp_path / "bak"), "c", root, "d") == "d"
    assert snapshots.read_collection(spark, root, "d").count() == 2


def test_snapshot_diff_reads_only_unequal_folders(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.range(500).withColumns({"v": F.col("id") % 7, "m": F.create_map(F.lit("a"), F.col("id"))})
    one = snapshots.snapshot_write(rows, root, "a", AS_OF, key=["id"])
    same = snapshots.snapshot_write(rows.repartition(5), root, "b", AS_OF, key=["id"])
    assert one["checksum"] == same["checksum"] == snapshots.content_checksum(rows)[1] and one["row_count"] == 500
    assert one["leaf_checksums"] == same["leaf_checksums"] and sum(map(int, one["leaf_checksums"])) == int(one["checksum"])
    assert snapshots.snapshot_diff(spark, root, "a", "b", ["id"]).count() == 0
    other = rows.where("id <> 3").withColumn("v", F.when(F.col("id") == 8, 99).otherwise(F.col("v"))).unionByName(rows.where("id = 5").withColumn("id", F.lit(900)))
    three = snapshots.snapshot_write(other, root, "c", AS_OF, key=["id"])
    found = snapshots.snapshot_diff(spark, root, "a", "c", ["id"])
    assert {(r.id, r.change) for r in found.collect()} == {(3, "removed"), (8, "changed"), (900, "added")}
    unequal = snapshots.unequal_leaves(one["leaf_checksums"], three["leaf_checksums"])
    assert unequal == [i for i, (x, y) in enumerate(zip(one["leaf_checksums"], three["leaf_checksums"])) if x != y] and len(unequal) <= 3
    assert snapshots.snapshot_read(spark, root, "c").count() == 500
    with pytest.raises(FileNotFoundError):
        snapshots.snapshot_diff(spark, root, "a", "z", ["id"])
