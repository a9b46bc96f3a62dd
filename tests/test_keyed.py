"""Tables that change by key: batches, repeated batches, compaction and removal of dead folders."""

import random

import pytest
from pyspark.sql import functions as F

from opslake.sources.keyed import KeyedTable


def rows(spark, data):
    return spark.createDataFrame([(k, v) for k, v in data.items()], "k string, v long")


def held(df):
    out = [(r.k, r.v) for r in df.collect()]
    assert len(out) == len(dict(out))
    return dict(out)


@pytest.mark.parametrize("most", [1, 3])
def test_batches_change_only_their_buckets(spark, tmp_path, most):
    rng = random.Random(most)
    table = KeyedTable(spark, str(tmp_path), "k", buckets=4, most_changes=most)
    want = {f"k{i}": i for i in range(40)}
    table.create(rows(spark, want))
    for batch in range(6):
        before = table.listed(batch - 1)
        some = {f"k{rng.randrange(60)}": 100 * batch + j for j in range(rng.choice([1, 2, 8]))}
        gone = {k for k in some if rng.random() < 0.3}
        for _ in range(2 if batch == 3 else 1):  # a repeated batch changes nothing
            table.write(rows(spark, some), batch, deleted=F.col("k").isin(sorted(gone)))
        want = {k: v for k, v in {**want, **some}.items() if k not in gone}
        assert held(table.read()) == want
        touched = {r[0] for r in rows(spark, some).select(table.bucket()).distinct().collect()}
        after = table.listed(batch)
        assert {k for k in set(before) | set(after) if before.get(k) != after.get(k)} <= touched
        assert all(len(b) <= most for b in after.values())
    old = held(table.read(2))
    assert held(table.read(5)) == want and old != want
    table.remove_dead()
    assert held(table.read()) == want


def test_expired_rows_go_when_a_bucket_is_written_anew(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), "k", buckets=1, most_changes=1, expired=F.col("v") < 10)
    table.create(rows(spark, {"a": 1, "b": 20}))
    assert held(table.read()) == {"b": 20}
    table.write(rows(spark, {"c": 30}), 0)
    removed = table.remove_dead()
    assert held(table.read()) == {"b": 20, "c": 30} and len(removed) == 1
    assert table.listed(0) == {0: [0]}


def test_an_empty_table_and_an_empty_batch(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), "k", buckets=3)
    table.create(spark.createDataFrame([], "k string, v long"))
    assert held(table.read()) == {} and table.last() == -1
    table.write(spark.createDataFrame([], "k string, v long"), 0)
    assert held(table.read()) == {} and table.last() == 0
    table.write(rows(spark, {"a": 1}), 1)
    assert held(table.read()) == {"a": 1} and table.read(buckets=[]).count() == 0


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        table = KeyedTable(spark, str(tmp_path), "k", buckets=1)
        table.create(spark.range(0, 100_000, 1, 8).select(F.col("id").alias("k"), F.lit(0).alias("v")))
        table.write(spark.range(0, 50_000, 1, 8).select(F.col("id").alias("k"), F.lit(1).alias("v")), 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert all(len(list((tmp_path / "data" / f"batch={n}" / "bucket=0").glob("*.parquet"))) > 1 for n in (-1, 0))
    assert table.read().groupBy().agg(F.count("k"), F.sum("v")).first()[:] == (100_000, 50_000)
