"""Inverted lists that are kept up to date against an exact search."""

import numpy as np
from pyspark.sql import functions as F

from opslake.operators import ivf, vectors


def frame(spark, data):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in data.items()], "id string, embedding array<float>")


def answers(df):
    return {(r.query_id, r["rank"]): (r.id, round(r.distance, 5)) for r in df.collect()}


def test_index_stays_equal_to_a_rebuild(spark, tmp_path):
    rng = np.random.default_rng(2)
    held = {f"v{i}": rng.normal(size=4) for i in range(120)}
    queries = frame(spark, {f"q{i}": rng.normal(size=4) for i in range(5)})
    index = ivf.IvfIndex(spark, str(tmp_path))
    index.create(frame(spark, held), rng.normal(size=(4, 4)))

    def agrees():
        return answers(index.search(queries, k=6)) == answers(vectors.knn_exact(frame(spark, held), queries, k=6))

    assert agrees()
    new = {"v3": rng.normal(size=4), "w1": rng.normal(size=4), "w2": np.full(4, 9.0)}
    for _ in range(2):  # a repeated batch changes nothing
        index.insert(frame(spark, new), 1)
    held |= new
    written = {r[0] for r in spark.read.parquet(f"{tmp_path}/lists/batch=1").select("list").distinct().collect()}
    assert agrees() and len(written) <= 3
    index.delete(frame(spark, {"w2": [0] * 4, "v7": [0] * 4}), 2)
    held = {k: v for k, v in held.items() if k not in ("w2", "v7")}
    assert agrees()
    index.insert(frame(spark, {"v7": [0.0] * 4}), 3)
    held["v7"] = np.zeros(4)
    assert agrees()
    sizes = {r["list"]: r["count"] for r in index.rows().groupBy("list").count().collect()}
    split = index.split(30, 4)
    assert split == sorted(k for k, n in sizes.items() if n > 30)
    kept = {r["list"]: r["count"] for r in index.rows().groupBy("list").count().collect()}
    assert agrees() and sum(kept.values()) == len(held) and not set(split) & set(kept)
    assert {k: n for k, n in kept.items() if k in sizes} == {k: n for k, n in sizes.items() if k not in split}
    assert index.split(10 ** 6, 5) == []


def test_lists_of_equal_vectors_are_not_split(spark, tmp_path):
    index = ivf.IvfIndex(spark, str(tmp_path))
    index.create(frame(spark, {f"v{i}": [1.0, 2.0] for i in range(9)}), np.zeros((1, 2)))
    assert index.split(3, 1) == [] and index.rows().agg(F.count(F.lit(1))).first()[0] == 9
