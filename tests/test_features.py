"""Features, vectors, models and planning against pandas and numpy."""

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from opslake.operators import anomaly, features, logs, planning, sla, vectors


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    n = 400
    pdf = pd.DataFrame({
        "n": rng.integers(0, 100, n).astype("float64"), "x": np.round(rng.normal(10, 3, n), 3), "flag": rng.choice(["A", "B", "C", None], n),
        "at": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 10 ** 6, n), unit="s")})
    pdf.loc[rng.random(n) < .1, "n"] = np.nan
    pdf.loc[:5, "x"] = 500.0
    pdf = pd.concat([pdf, pdf.head(20)], ignore_index=True)
    df = spark.createDataFrame(pdf).withColumn("n", F.when(~F.isnan("n"), F.col("n"))).withColumn("at", F.col("at").cast("timestamp"))
    return df, pdf


def test_prepare_matches_pandas(table):
    df, pdf = table
    want = pdf.drop_duplicates().copy()
    want["n"] = want.n.fillna(want.n.median())
    want["flag"] = want.flag.fillna("missing")
    for c in ("n", "x"):
        q1, q3 = want[c].quantile(.25), want[c].quantile(.75)
        want = want[(want[c] >= q1 - 1.5 * (q3 - q1)) & (want[c] <= q3 + 1.5 * (q3 - q1))]
    for c in ("n", "x"):
        want[c] = (want[c] - want[c].mean()) / want[c].std()
    want["flag"] = want.flag.map(want.flag.value_counts(normalize=True))
    want["at_year"], want["at_dayofweek"], want["at_hour"] = want["at"].dt.year, want["at"].dt.dayofweek, want["at"].dt.hour
    out = features.prepare(df, ["frequency"])
    assert dict(out.dtypes) == {"n": "float", "x": "float", "flag": "float", "at_year": "smallint", "at_dayofweek": "tinyint", "at_hour": "tinyint"}
    columns = ["at_year", "at_dayofweek", "at_hour", "n", "x", "flag"]
    got = out.toPandas()[columns].astype(float).sort_values(columns).to_numpy()
    expected = want[columns].astype(float).sort_values(columns).to_numpy()
    assert got.shape == expected.shape
    key = lambda a: a[np.lexsort(np.round(a, 4).T[::-1])]
    assert np.allclose(key(got), key(expected), atol=1e-4)


def test_whole_number_column_keeps_a_fractional_median(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "n int")
    assert sorted(r.n for r in features.impute(df).collect()) == [1.0, 1.5, 2.0]


def test_nulls_after_cleaning_are_an_error(spark):
    with pytest.raises(features.NullsLeft):
        features.require_no_nulls(spark.createDataFrame([(1, None)], "a int, b int"))


def test_onehot_of_many_levels(spark):
    df = spark.range(2500).select(F.format_string("s%05d", "id").alias("s")).union(spark.createDataFrame([(None,)], "s string"))
    assert len(features.onehot(df.limit(20), "s").columns) == 19
    got = {r.s: r.code for r in features.onehot_sparse(df.union(df), "s", "code").collect()}
    assert got == {f"s{i:05}": i for i in range(2500)} | {None: None}


def test_doubles_that_change_stay_doubles(spark):
    df = spark.createDataFrame([(0.5, 104949.5123456, 1e300), (None, 1.0, 0.0)], "a double, b double, c double")
    assert [f.dataType.simpleString() for f in features.narrow_types(df).schema] == ["float", "double", "double"]
    assert features.narrow_types(df).first().b == 104949.5123456


def test_constant_column_is_not_scaled(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    out, stats = features.zscore(df)
    assert set(stats) == {"a"} and stats["a"]["mean"] == 2.0
    assert sorted(tuple(r) for r in out.collect()) == [(-0.7071067811865475, 5.0), (0.7071067811865475, 5.0)]
    assert {r.column: r.constant for r in features.column_profile(df).collect()} == {"a": False, "b": True}


def test_split_is_complete_and_stratified(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("g"))
    train, test = features.stratified_split(df, "g", ["id"])
    again = features.stratified_split(df.repartition(5), "g", ["id"])[1]
    assert train.count() + test.count() == 3000 and train.join(test, "id").count() == 0
    sizes = {r.g: r["count"] for r in df.groupBy("g").count().collect()}
    assert {r.g: r["count"] for r in test.groupBy("g").count().collect()} == {g: round(n * .2) for g, n in sizes.items()}
    assert {r.id for r in test.collect()} == {r.id for r in again.collect()}


@pytest.fixture(scope="module")
def space(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8)) * 4
    points = (centres[rng.integers(0, 12, 1200)] + rng.normal(size=(1200, 8))).astype("float32")
    rows = [(f"v{i:04}", p.tolist()) for i, p in enumerate(points)]
    base = spark.createDataFrame(rows, "id string, embedding array<float>").repartition(6)
    queries = spark.createDataFrame([(f"q{i}", (points[i] + 0.1).tolist()) for i in range(30)], "id string, embedding array<float>")
    return base, queries, points


def pairs(df):
    return {(r.query_id, r.id) for r in df.collect()}


@pytest.mark.parametrize("blocks", [(8192, 1024), (100, 7)])
def test_knn_exact_is_brute_force(space, blocks):
    base, queries, points = space
    got = {}
    for r in vectors.knn_exact(base, queries, 5, None, *blocks).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.id, r.distance)
    x = points.astype("float64")
    for i, q in enumerate(queries.orderBy("id").collect()):
        d = np.sqrt(((x - np.array(q.embedding)) ** 2).sum(1))
        order = np.lexsort((np.arange(len(d)), d))[:5]
        assert [got[q.id][k + 1][0] for k in range(5)] == [f"v{j:04}" for j in order]


def test_ties_go_by_id(spark):
    base = spark.createDataFrame([(f"{i}", [1.0, 0.0]) for i in range(20)], "id string, embedding array<float>").repartition(4)
    query = spark.createDataFrame([("q", [0.0, 0.0])], "id string, embedding array<float>")
    got = vectors.knn_exact(base, query, 3).orderBy("rank").collect()
    assert [r.id for r in got] == ["0", "1", "10"]


def test_approximate_recall(space):
    base, queries, _ = space
    exact = pairs(vectors.knn_exact(base, queries, 10))
    ivf = pairs(vectors.knn_ivf(base, queries, 10, nprobe=8))
    full = pairs(vectors.knn_ivf(base, queries, 10, nprobe=10 ** 6))
    lsh = pairs(vectors.knn_lsh(base, queries, 10, width=8.0))
    assert full == exact
    assert len(ivf & exact) / len(exact) > 0.9
    assert len(lsh & exact) / len(exact) > 0.8


def test_stored_lists_are_read_only_where_probed(spark, space, tmp_path):
    base, queries, _ = space
    centres = vectors.ivf_centres(base, 12)
    assert len(centres) == 12
    vectors.ivf_build(base, str(tmp_path / "index"), centres)
    one = queries.limit(1)
    first = vectors.ivf_search(spark, str(tmp_path / "index"), centres, one, 5, nprobe=2)
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and plan.count("list#") > 0
    read = spark.read.parquet(str(tmp_path / "index")).groupBy("list").count().count()
    assert read == 12 and first.count() == 5
    assert pairs(vectors.ivf_search(spark, str(tmp_path / "index"), centres, queries, 10, 12)) == pairs(vectors.knn_exact(base, queries, 10))


def test_vectors_of_wrong_size_are_marked(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0], None), ("b", [1.0], "{}"), ("c" * 65, [1.0, 2.0], None)], "id string, embedding array<float>, m string")
    got = [(r.valid, r.metadata) for r in vectors.prepare_vectors(df, 2, metadata="m").collect()]
    assert got == [(True, "{}"), (False, "{}"), (False, "{}")]


def test_isolation_forest_finds_outliers_and_repeats(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1000, 3))
    x[:10] += 8
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(id=np.arange(1000)))
    one = anomaly.isolation_forest(df, list("abc"), "id").select("id", "score").toPandas().sort_values("id")
    two = anomaly.isolation_forest(df.repartition(9), list("abc"), "id").select("id", "score").toPandas().sort_values("id")
    assert np.allclose(one.score, two.score)
    assert set(one.nsmallest(10, "score").id) == set(range(10))
    assert one.score.between(-1, 0).all() and one.score[10:].median() > -0.5 > one.score[:10].max()


def test_reconstruction_error_is_the_projection_residual(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2)) @ rng.normal(size=(2, 4)) + rng.normal(size=(300, 4)) * .01
    x[0] += [0, 5, 0, -5]
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcd")).assign(id=np.arange(300)))
    got = anomaly.reconstruction_anomaly(df, list("abcd"), 2, .5).toPandas().sort_values("id")
    c = x - x.mean(0)
    v = np.linalg.svd(c, full_matrices=False)[2][:2]
    assert np.allclose(got.error, ((c - c @ v.T @ v) ** 2).mean(1))
    assert got.id[got.anomaly].tolist() == [0]


@pytest.mark.parametrize("block", [64, 4])
def test_cost_plan_follows_the_greedy_rule(spark, block):
    rng = np.random.default_rng(9)
    kinds = [(f"i{i}", float(np.round(rng.uniform(.5, 30), 2)), float(np.round(rng.uniform(.2, 10), 2)) if i % 3 else None,
              int(rng.integers(1, 64))) for i in range(60)]
    df = spark.createDataFrame(kinds, "instance_type string, price double, spot_price double, vcpus int")
    scenarios = [(f"s{i}", float(b), r, 100) for i, (b, r) in enumerate([(50, .95), (50, .8), (3, .95), (.1, .8), (500, .8), (1e6, .95)])]
    got = {r.scenario: r for r in planning.cost_plan(df, spark.createDataFrame(
        scenarios, "scenario string, max_budget double, reliability double, min_performance int"), block=block).collect()}
    assert len(got) == len(scenarios)
    for name, budget, reliability, need in scenarios:
        spent, cpus, plan = 0.0, 0, []
        for kind, price, spot, v in sorted(kinds, key=lambda k: (k[1] / k[3], k[0])):
            if spent + price > budget:
                break
            pays = spot if spot and reliability < .9 else price
            count = int(np.floor((budget - spent) / pays))
            if count:
                plan.append((kind, count))
                spent, cpus = spent + pays * count, cpus + v * count
        assert [(p.instance_type, p["count"]) for p in got[name].plan] == plan
        assert got[name].spent == spent and got[name].vcpus == cpus and got[name].meets_performance == (cpus >= need)


def test_reward_examples(spark):
    shape = "latency_ms double, throughput_rps double, error_rate double, availability double, usage map<string,double>"
    df = spark.createDataFrame([(80.0, 1200.0, .005, .9995, {"cpu": .5}), (600.0, 400.0, .06, .98, {"cpu": .9, "memory": .1}),
                                (300.0, 750.0, .03, .995, {})], shape)
    got = [(r.reward, r.latency_violation, r.availability_violation) for r in planning.sla_reward(df).collect()]
    assert got[0] == (1.0, False, False)
    assert got[1] == (round(.4 * -2 + .3 * -1.5 + .2 * -3 + .1 * -2.5 - .5 - .1, 4), True, True)
    assert got[2][0] == pytest.approx(.4 * (1 - .5 ** 1.5) + .3 * .5 + .2 * (1 - np.exp(.1)) + .1 * .5, abs=1e-4)
    with pytest.raises(ValueError):
        planning.SlaGoals(latency_ms=(500, 100))
    with pytest.raises(ValueError):
        planning.SlaGoals(throughput_rps=(500, 1000))


def test_sla_of_the_demo_and_of_nothing(spark):
    as_of = dt.datetime(2024, 1, 1, 1)
    df = spark.range(1000).select((F.lit(as_of) - F.expr("make_interval(0,0,0,0,0,0,id % 300)")).alias("ts"), (F.col("id") % 100 != 0).alias("success"),
                                  F.when(F.col("id") % 100 == 0, .65).otherwise(.15).alias("latency"))
    targets = {"availability": 99.95, "latency_p99": .5, "throughput": 1000}
    got = {r.metric: (round(r.actual, 6), r.ok) for r in sla.sla_compliance(df, targets, as_of).collect()}
    assert got == {"availability": (99.0, False), "latency_p99": (.15, True), "throughput": (round(1000 / 300, 6), False)}
    none = {r.metric: r.actual for r in sla.sla_compliance(df.limit(0), {"availability": 1, "latency_p99": 1}, as_of).collect()}
    assert none == {"availability": 100.0, "latency_p99": 0.0}
    assert sla.latency_quantile(df.limit(0)).first()[0] == 0.0


def test_throughput_anomalies_need_thirty_samples(spark):
    rows = [("a", 1.0)] * 40 + [("a", 50.0)] + [("b", 1.0)] * 20 + [("b", 50.0)] + [("c", 2.0)] * 50
    out = sla.throughput_anomalies(spark.createDataFrame(rows, "service string, rps double"), ["service"]).collect()
    assert [(r.service, r.rps, r.status) for r in out] == [("a", 50.0, "high")]


def test_forest_draws_from_the_whole_table(spark):
    """Every tree's rows are those with its smallest hashes, so trees differ and no pool limits them."""
    df = spark.range(20_000).select("id", F.col("id").cast("double").alias("x"))
    forest = anomaly.fit_forest(df, ["x"], "id", trees=40, sample=64)
    assert len(forest) == 40 and {t["size"] for t in forest} == {64}
    cuts = [c for t in forest for f, c in zip(t["feature"], t["cut"]) if f >= 0]
    assert len(set(cuts)) > 0.9 * len(cuts) and min(cuts) < 500 and max(cuts) > 19_500
    assert forest == anomaly.fit_forest(df.repartition(5), ["x"], "id", trees=40, sample=64)
    assert {t["size"] for t in anomaly.fit_forest(df.limit(10), ["x"], "id", trees=3, sample=64)} == {10}
    assert anomaly.isolation_forest(df.limit(0), ["x"], "id").count() == 0


def test_log_age_is_that_of_the_log(spark):
    as_of = dt.datetime(2024, 1, 31)
    rows = [(1, as_of, json.dumps({"message": "m", "timestamp": "2024-01-30T00:00:00"})), (2, as_of, "plain")]
    parsed = logs.log_parse(spark.createDataFrame(rows, "event_id long, ts timestamp, raw string"))
    assert {r.event_id: r.age_s for r in logs.log_features(parsed, as_of).collect()} == {1: 86400.0, 2: 0.0}


def test_search_without_queries_or_vectors(space, spark):
    base, queries, _ = space
    assert vectors.knn_exact(base, queries.limit(0)).count() == 0
    assert vectors.knn_exact(base.limit(0), queries, 3).count() == 0
    holes = base.limit(5).unionByName(spark.createDataFrame([("none", None)], "id string, embedding array<float>"))
    assert vectors.knn_exact(holes, queries.limit(1), 10).count() == 5


def test_batches_served_in_no_time(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, at, "m", 32, 0.0), (2, at + dt.timedelta(seconds=1), "m", 32, 16.0), (3, at + dt.timedelta(seconds=2), "m", 0, 0.0)]
    served = spark.createDataFrame(rows, "no long, ts timestamp, model string, size int, latency_ms double")
    got = {r.no: (r.avg_latency, r.throughput) for r in anomaly.inference_metrics(served, ["model"], ["ts", "no"]).collect()}
    assert got[1] == (0.0, np.inf) and got[2] == (pytest.approx(1.6), 2000.0)
    assert got[3][0] == pytest.approx(1.44) and np.isnan(got[3][1])
