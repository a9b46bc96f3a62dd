"""Isolation forest, reconstruction error and batch model scoring."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _average_path(n) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n points (Liu et al. 2008)."""
    n = np.asarray(n, dtype=np.float64)
    big = 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, big, np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> dict:
    """One isolation tree as flat lists: feature (-1 for a leaf), cut, left, right, path length at a leaf."""
    tree = {"feature": [], "cut": [], "left": [], "right": [], "path": []}

    def node(rows, depth):
        at = len(tree["feature"])
        for part, empty in (("feature", -1), ("cut", 0.0), ("left", -1), ("right", -1), ("path", 0.0)):
            tree[part].append(empty)
        spread = np.flatnonzero(x[rows].max(0) > x[rows].min(0)) if len(rows) else []
        if depth >= limit or len(rows) <= 1 or not len(spread):
            tree["path"][at] = float(depth + _average_path(len(rows)))
            return at
        f = int(rng.choice(spread))
        low, high = x[rows, f].min(), x[rows, f].max()
        cut = float(rng.uniform(low, high))
        below = x[rows, f] < cut
        tree["feature"][at], tree["cut"][at] = f, cut
        tree["left"][at] = node(rows[below], depth + 1)
        tree["right"][at] = node(rows[~below], depth + 1)
        return at

    node(np.arange(len(x)), 0)
    return tree


def fit_forest(df: DataFrame, features: Sequence[str], row_id: str, trees: int = 100, sample: int = 256,
               seed: int = 1) -> list[dict]:
    """Isolation trees, each grown in a task of its own from ``sample`` rows of the whole table.

    A tree's rows are those with the smallest hashes of (seed, tree, row id). Only rows below a cut at four times
    that share leave the scan, so what is shuffled doesn't grow with the table; the same data gives the same trees.
    """
    features = list(features)
    rows = df.select(F.col(row_id).alias("_id"), *[F.col(c).cast("double").alias(c) for c in features])
    share = 4.0 * sample / max(df.count(), 1)
    drawn = rows.withColumn("_tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn(
        "_h", F.xxhash64(F.lit(seed), "_tree", "_id"))
    if share < 1:
        drawn = drawn.filter(F.col("_h") < int(-(2 ** 63) + share * 2 ** 64))
    by_tree = Window.partitionBy("_tree").orderBy("_h", *features)
    drawn = drawn.withColumn("_n", F.row_number().over(by_tree)).filter(F.col("_n") <= sample)

    def grow(key, pdf):
        part = pdf.sort_values("_n")[features].to_numpy(np.float64)
        tree = _grow(part, np.random.default_rng([seed, int(key[0])]), math.ceil(math.log2(max(len(part), 2))))
        return pd.DataFrame({"tree": [int(key[0])], "size": [len(part)], "body": [json.dumps(tree)]})

    grown = drawn.groupBy("_tree").applyInPandas(grow, "tree long, size int, body string").collect()
    return [json.loads(r["body"]) | {"size": r["size"]} for r in sorted(grown, key=lambda r: r["tree"])]


def score_forest(df: DataFrame, features: Sequence[str], forest: list[dict], threshold: float = -0.5) -> DataFrame:
    """Add ``score`` (minus the isolation score, from -1 to 0) and ``anomaly`` (score below the threshold)."""
    if not forest:  # fitted on no rows
        return df.withColumn("score", F.lit(None).cast("double")).withColumn("anomaly", F.lit(None).cast("boolean"))
    arrays = [{k: np.asarray(t[k]) for k in ("feature", "cut", "left", "right", "path")} for t in forest]
    norm = float(_average_path(max(t["size"] for t in forest))) or 1.0

    @F.pandas_udf("double")
    def score(x: pd.DataFrame) -> pd.Series:
        values = x.to_numpy(float)
        total = np.zeros(len(values))
        for t in arrays:
            at = np.zeros(len(values), dtype=np.int64)
            while True:
                f = t["feature"][at]
                moving = np.flatnonzero(f >= 0)
                if not len(moving):
                    break
                here = at[moving]
                below = values[moving, f[moving]] < t["cut"][here]
                at[moving] = np.where(below, t["left"][here], t["right"][here])
            total += t["path"][at]
        return pd.Series(-(2.0 ** (-total / len(arrays) / norm)))

    packed = F.struct(*[F.col(c).cast("double").alias(c) for c in features])
    return df.withColumn("score", score(packed)).withColumn("anomaly", F.col("score") < threshold)


def isolation_forest(df: DataFrame, features: Sequence[str], row_id: str, trees: int = 100, threshold: float = -0.5,
                     seed: int = 1) -> DataFrame:
    return score_forest(df, features, fit_forest(df, features, row_id, trees, seed=seed), threshold)


def fit_projection(df: DataFrame, features: Sequence[str], components: int) -> dict:
    """Means and leading directions of the features. One aggregation; the matrix has one row per feature."""
    features = list(features)
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)],
                 *[F.covar_pop(features[i], features[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((len(features), len(features)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"]
    _, vectors = np.linalg.eigh(cov)
    return {"features": features, "mean": [row[f"m{i}"] for i in range(len(features))],
            "directions": vectors[:, ::-1][:, :components].T.tolist()}


def reconstruction_anomaly(df: DataFrame, features: Sequence[str], components: int, threshold: float) -> DataFrame:
    """Add the mean squared error of the linear reconstruction, and whether it is above the threshold.

    The linear counterpart of an autoencoder; scoring is plain column arithmetic.
    """
    model = fit_projection(df, features, components)
    centred = [F.col(c) - m for c, m in zip(model["features"], model["mean"])]
    codes = [sum((x * w for x, w in zip(centred, d)), F.lit(0.0)) for d in model["directions"]]
    df = df.withColumns({f"_code{i}": c for i, c in enumerate(codes)})
    error = F.lit(0.0)
    for i, x in enumerate(centred):
        back = sum((F.col(f"_code{n}") * d[i] for n, d in enumerate(model["directions"])), F.lit(0.0))
        error = error + F.pow(x - back, F.lit(2.0))
    out = df.withColumn("error", error / len(centred)).drop(*[f"_code{i}" for i in range(len(codes))])
    return out.withColumn("anomaly", F.col("error") > threshold)


def batch_predict(df: DataFrame, inputs: Sequence[str], load_model: Callable[[], Callable], output: str = "prediction",
                  returns: T.DataType = T.DoubleType(), batch_size: int = 32, shapes=None) -> DataFrame:
    """Add model predictions. ``load_model`` runs once per Python worker and returns the batch function."""
    from pyspark.ml.functions import predict_batch_udf

    predict = predict_batch_udf(load_model, return_type=returns, batch_size=batch_size, input_tensor_shapes=shapes)
    return df.withColumn(output, predict(*[F.col(c) for c in inputs]))


def inference_metrics(batches: DataFrame, keys: Sequence[str], order: Sequence[str], bucket=None) -> DataFrame:
    """Per served batch (size, latency_ms): running mean latency (0.9 / 0.1, from zero) and items per second.

    A batch served in no measured time has an infinite throughput (an empty one has none: NaN).
    """
    from opslake.operators.folds import ewma

    timed = ewma(batches, keys, order, "latency_ms", bucket, decay=0.9, seed_with_first=False, name="avg_latency")
    instant = F.col("size") * F.lit(float("inf"))
    return timed.withColumn("throughput", F.when(F.col("latency_ms") == 0, instant).otherwise(F.col("size") / (F.col("latency_ms") / 1000)))
