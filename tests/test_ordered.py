"""The ordered toolbox on skewed keys, with buckets small enough to cut them."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from opslake.operators import folds, ordered, sla


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one key, ties in time, one null key."""
    rng = np.random.default_rng(7)
    n = 1500
    key = np.where(rng.random(n) < 0.4, "hot", rng.choice(["a", "b", "c", None], n))
    at = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 40_000, n), unit="s")
    value = np.round(rng.normal(0, 50, n), 1)
    value[rng.random(n) < 0.1] = 0.0
    pdf = pd.DataFrame({"k": key, "ts": at, "id": np.arange(n), "v": value})
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp"))
    return df, pdf.assign(k=pdf.k.where(pdf.k.notna(), "~null"))


def rows(df, *columns):
    return {r["id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_ranked_is_row_number(skewed):
    df, pdf = skewed
    got = rows(ordered.ranked(df, ["k"], [F.col("ts"), F.col("id")], ordered.by_time("ts", 600)), "rank")
    want = pdf.sort_values(["ts", "id"]).groupby("k").cumcount() + 1
    assert {i: (int(r),) for i, r in want.items()} == {k: v for k, v in got.items()}


def test_ranked_without_key(skewed):
    df, pdf = skewed
    got = rows(ordered.ranked(df, [], [F.col("ts"), F.col("id")], ordered.by_time("ts", 600)), "rank")
    order = pdf.sort_values(["ts", "id"]).id.tolist()
    assert [got[i][0] for i in order] == list(range(1, len(order) + 1))


def test_running_total(skewed):
    df, pdf = skewed
    out = ordered.running_total(df, ["k"], [F.col("ts"), F.col("id")], ordered.by_time("ts", 600), F.col("id"), "total")
    want = pdf.sort_values(["ts", "id"]).groupby("k").id.cumsum()
    assert rows(out, "total") == {i: (int(x),) for i, x in want.items()}


def test_with_previous_is_lag(skewed):
    df, pdf = skewed
    out = ordered.with_previous(df, ["k"], ["ts", "id"], ordered.by_time("ts", 600), {"id": "before"})
    want = pdf.sort_values(["ts", "id"]).groupby("k").id.shift()
    assert rows(out, "before") == {i: (None if np.isnan(x) else int(x),) for i, x in want.items()}


def test_last_seen(skewed):
    df, pdf = skewed
    out = ordered.last_seen(df, ["k"], ["ts", "id"], ordered.by_time("ts", 600), F.when(F.col("v") > 80, F.col("v")), "high")
    ordered_rows = pdf.sort_values(["ts", "id"])
    want = ordered_rows.v.where(ordered_rows.v > 80).groupby(ordered_rows.k).ffill()
    assert rows(out, "high") == {i: (None if np.isnan(x) else x,) for i, x in zip(ordered_rows.id, want)}


@pytest.mark.parametrize("chunk", [None, 20])
def test_rolling(skewed, chunk):
    df, pdf = skewed
    placed = ordered.ranked(df, ["k"], [F.col("ts"), F.col("id")], ordered.by_time("ts", 600))
    out = ordered.rolling(placed, ["k"], "rank", 15, {"m": lambda f: f["v"].mean()}, chunk)
    want = pdf.sort_values(["ts", "id"]).groupby("k").v.rolling(15, min_periods=1).mean().droplevel(0)
    got = rows(out, "m")
    assert len(got) == len(pdf)
    assert all(abs(got[i][0] - x) < 1e-9 for i, x in want.items())


@pytest.mark.parametrize("fine", [1, 50_000])
def test_exact_quantiles(skewed, fine):
    df, pdf = skewed
    wanted = {"p99": (0.99, "desc"), "p90": (0.9, "desc"), "d": (0.5, "disc"), "q1": (0.25, "cont"), "q3": (0.75, "cont")}
    got = {r["k"] or "~null": r for r in ordered.exact_quantiles(df, ["k"], "v", wanted, per_octave=4, fine=fine).collect()}
    for k, part in pdf.groupby("k"):
        v = np.sort(part.v.to_numpy())
        assert got[k]["p99"] == v[::-1][int(len(v) * (1 - 0.99))]
        assert got[k]["p90"] == v[::-1][int(len(v) * (1 - 0.9))]
        assert got[k]["d"] == v[int(np.ceil(len(v) * 0.5)) - 1]
        assert abs(got[k]["q1"] - np.quantile(v, 0.25)) < 1e-9
        assert abs(got[k]["q3"] - np.quantile(v, 0.75)) < 1e-9


@pytest.mark.parametrize("fine", [1, 50_000])
def test_exact_quantiles_of_one_or_no_value(spark, fine):
    one = spark.createDataFrame([("a", 5.0), ("a", None), ("b", None)], "k string, v double")
    got = ordered.exact_quantiles(one, ["k"], "v", {"x": (0.99, "desc"), "y": (0.5, "cont")}, fine=fine).collect()
    assert [tuple(r) for r in got] == [("a", 5.0, 5.0)]


def test_neighbouring_values_of_one_key_never_meet(spark):
    """All values fall into one band, which is cut until small parts are left."""
    df = spark.range(200_000).select(F.lit("hot").alias("k"), (F.lit(1.7e9) + F.col("id")).alias("v"))
    got = ordered.exact_quantiles(df, ["k"], "v", {"a": (0.25, "cont"), "b": (0.999, "disc")}, fine=500).first()
    assert (got.a, got.b) == (1.7e9 + 49_999.75, 1.7e9 + 199_799)
    same = df.select("k", F.lit(3.5).alias("v")).unionByName(df.limit(3))
    assert ordered.exact_quantiles(same, ["k"], "v", {"a": (0.5, "disc")}, fine=10).first().a == 3.5


def test_value_band_never_decreases(spark):
    rng = np.random.default_rng(3)
    x = np.sort(np.r_[rng.normal(0, 1e6, 2000), rng.normal(0, 1e-6, 2000), 2.0 ** np.arange(-60, 60), 0.0,
                      np.nextafter(2.0 ** np.arange(-50, 50), 0)])
    df = spark.createDataFrame(pd.DataFrame({"v": x}))
    got = df.select("v", ordered.value_band(F.col("v"), 64).alias("b")).toPandas().sort_values("v").b.to_numpy()
    assert (np.diff(got) >= 0).all()


def test_fit_time_narrows_for_a_busy_key(skewed):
    df, _ = skewed
    wide = df.select(ordered.fit_time(df, ["k"], "ts").alias("b")).distinct().count()
    narrow = df.groupBy("k", ordered.fit_time(df, ["k"], "ts", max_rows=20).alias("b")).count()
    assert wide == 1
    assert narrow.agg(F.max("count")).first()[0] <= 20


def brute_cooldown(pdf):
    out = {}
    for _, part in pdf.sort_values(["ts", "id"]).groupby("k"):
        last = None
        for r in part.itertuples():
            acted = bool(r.v > 10) and (last is None or (r.ts - last).total_seconds() >= r.id % 3 * 300)
            out[r.id] = (acted, last.to_pydatetime() if last is not None else None)
            last = r.ts if acted else last
    return out


@pytest.mark.parametrize("seconds", [120, 3600, 10 ** 6])
def test_cooldown_replay(skewed, seconds):
    df, pdf = skewed
    out = folds.cooldown_replay(df, ["k"], "ts", "id", F.col("v") > 10, F.col("id") % 3 * 300, ordered.by_time("ts", seconds))
    assert rows(out, "acted", "last_action") == brute_cooldown(pdf)


@pytest.mark.parametrize("seed_with_first", [True, False])
@pytest.mark.parametrize("seconds", [600, 10 ** 6])
def test_ewma(skewed, seed_with_first, seconds):
    df, pdf = skewed
    df, pdf = df.withColumn("v", F.abs("v")), pdf.assign(v=pdf.v.abs())
    got = rows(folds.ewma(df, ["k"], ["ts", "id"], "v", ordered.by_time("ts", seconds), 0.95, seed_with_first), "ewma")
    for _, part in pdf.sort_values(["ts", "id"]).groupby("k"):
        s = 0.0
        for r in part.itertuples():
            s = r.v if seed_with_first and s == 0 else 0.95 * s + 0.05 * r.v
            assert abs(got[r.id][0] - s) < 1e-9


def test_cooldown_of_one_key_is_composed_in_a_tree(spark, monkeypatch):
    """One key, buckets far shorter than the wait: no task meets more than a few neighbouring summaries."""
    rng = np.random.default_rng(12)
    at = np.sort(rng.integers(0, 40_000, 6000))
    rows = spark.createDataFrame([("hot", i, int(t)) for i, t in enumerate(at)], "k string, id long, s long").withColumn(
        "ts", F.timestamp_seconds("s"))
    met, staged = [], ordered.staged

    def spy(df):
        out = staged(df)
        if {"limits", "_at"} <= set(out.columns):
            met.append([r[0] for r in out.groupBy("k", F.floor(F.col("_at") / 16)).agg(F.sum(F.size("limits"))).select("sum(size(limits))").collect()])
        return out

    monkeypatch.setattr(ordered, "staged", spy)
    out = folds.cooldown_replay(rows, ["k"], "ts", "id", F.lit(True), F.lit(3600), ordered.by_time("ts", 20))
    got = {r.id for r in out.filter("acted").collect()}
    want, last = set(), -10 ** 9
    for i, t in enumerate(at.tolist()):
        if t >= last + 3600:
            want.add(i)
            last = t
    assert got == want
    assert len(met) >= 3 and len(met[0]) > 100 and max(x or 0 for x in met[0]) < 200
    assert max(x or 0 for m in met for x in m) <= 16 * 700  # a group times the rows of one waiting time


def test_buckets_below_a_second_and_of_single_numbers(spark):
    crowd = spark.range(4000).select(F.lit("a").alias("k"), "id", F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id")).alias("ts"))
    for bucket in (ordered.fit_time(crowd, ["k"], "ts", max_rows=1200), ordered.fit_range(crowd, ["k"], "id", max_rows=40)):
        counts = [r["count"] for r in crowd.groupBy(bucket.alias("b")).count().collect()]
        assert max(counts) <= 1200 and len(counts) > 3


def test_timestamps_are_utc(spark):
    got = spark.sql("SELECT TIMESTAMP '2024-01-01 00:00:00' AS t").select(F.unix_seconds("t")).first()[0]
    assert got == int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp())


@pytest.mark.parametrize("fine", [1, 50_000])
def test_quantiles_with_infinite_and_missing_numbers(spark, fine):
    values = [1.0, float("inf"), float("nan"), -2.0, float("-inf"), 0.0, 1e308]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = ordered.exact_quantiles(df, [], "v", {"lo": (0.01, "disc"), "mid": (0.5, "disc"), "hi": (1.0, "disc")}, fine=fine).first()
    assert tuple(got) == (float("-inf"), 0.0, float("inf"))


def test_staged_needs_a_shared_folder_off_local_mode():
    from opslake import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        session.shared_folder(Session())


def test_staged_uses_the_configured_folder(spark):
    from opslake import session

    assert session.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    df = session.staged(spark.range(3).withColumn("x", F.lit(None).cast("string")))
    assert spark.conf.get("spark.checkpoint.dir") in df.inputFiles()[0]
    assert df.count() == 3 and session.staged(spark.range(0)).count() == 0


def test_a_hot_key_is_spread_over_tasks(spark):
    """One key with all rows: no task gets more than a few buckets of it."""
    rows = spark.range(20_000).select(F.lit("hot").alias("k"), "id", F.timestamp_seconds(F.col("id") * 7).alias("ts"),
                                      (F.col("id") % 97).cast("double").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        bucket = ordered.fit_time(rows, ["k"], "ts", max_rows=600)
        for out in (ordered.ranked(rows, ["k"], [F.col("ts")], bucket),
                    folds.cooldown_replay(rows, ["k"], "ts", "id", F.col("v") > 90, F.lit(60), bucket),
                    ordered.rolling(ordered.ranked(rows, ["k"], [F.col("ts")], bucket), ["k"], "rank", 10, {"m": lambda f: f["v"].mean()})):
            tasks = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
            assert sum(r["count"] for r in tasks) == 20_000
            assert len(tasks) > 4 and max(r["count"] for r in tasks) < 8_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("window, every", [(300, 60), (90, 60), (60, 120)])
def test_sliding_windows_from_panes(spark, window, every):
    rng = random.Random(window)
    rows = [("hot" if i % 3 else rng.choice("ab"), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randint(0, 1500)), rng.random() < 0.9,
             rng.choice([None, float("nan"), 0.5, rng.random() * 9])) for i in range(900)]
    df = spark.createDataFrame(rows, "service string, ts timestamp, success boolean, latency double")
    got = {(r.service, r.window_start): (round(r.availability, 9), round(r.throughput, 9), r.latency_p99)
           for r in sla.sla_sliding(df, window, every).collect()}
    want, origin = {}, dt.datetime(1970, 1, 1)
    for name in "hot a b".split():
        mine = [(int((t - origin).total_seconds()), ok, v) for s, t, ok, v in rows if s == name]
        for start in {(t // every - k) * every for t, _, _ in mine for k in range(window // every + 1)}:
            held = [(ok, v) for t, ok, v in mine if start <= t < start + window]
            if held:
                values = sorted((v for _, v in held if v is not None and v == v), reverse=True)
                slow = values[int(len(values) * (1 - 0.99))] if values else 0.0
                want[name, origin + dt.timedelta(seconds=start)] = (
                    round(sum(ok for ok, _ in held) / len(held) * 100, 9), round(len(held) / window, 9), slow)
    assert got == want
