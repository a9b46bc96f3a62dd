"""Vector collections and nearest-neighbour search."""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslake.session import shared_folder, staged

RESULT = "query_id string, id string, distance double"


def prepare_vectors(df: DataFrame, dim: int, vec_id: str = "id", embedding: str = "embedding",
                    metadata: str | None = None) -> DataFrame:
    """Rows as (id string, embedding array<float>, metadata JSON, valid); valid checks the dimension and id length."""
    body = F.coalesce(F.col(metadata), F.lit("{}")) if metadata else F.lit("{}")
    name = F.col(vec_id).cast("string")
    ok = (F.size(embedding) == dim) & name.isNotNull() & (F.length(name) <= 64)
    return df.select(name.alias("id"), F.col(embedding).cast("array<float>").alias("embedding"), body.alias("metadata"),
                     F.coalesce(ok, F.lit(False)).alias("valid"))


def _nearest(ids: np.ndarray, dist: np.ndarray, k: int):
    """The k smallest distances, ties by id."""
    near = np.arange(len(dist))
    if len(dist) > k:
        near = np.flatnonzero(dist <= np.partition(dist, k - 1)[k - 1])
    order = np.lexsort((ids[near], dist[near]))[:k]
    return ids[near][order], dist[near][order]


def _squares(vectors: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs by one matrix product; exact up to rounding."""
    return (vectors ** 2).sum(1)[:, None] - 2 * vectors @ points.T + (points ** 2).sum(1)[None, :]


def _best(ids: np.ndarray, vectors: np.ndarray, query_ids, queries: np.ndarray, k: int, step: int = 256):
    """(query_id, id, distance) of the k nearest vectors of each query.

    A matrix product rules out most vectors; the others get their distance from the differences, so that results
    do not depend on how the vectors are dealt out.
    """
    out = []
    for at in range(0, len(queries), step):
        block = queries[at:at + step]
        rough = _squares(block, vectors)
        slack = 1e-9 * (1 + (vectors ** 2).sum(1).max() + (block ** 2).sum(1).max())
        for name, query, far in zip(query_ids[at:at + step], block, rough):
            look = np.arange(len(ids))
            if len(look) > k:
                look = np.flatnonzero(far <= np.partition(far, k - 1)[k - 1] + 2 * slack)
            found = _nearest(ids[look], np.sqrt(((vectors[look] - query) ** 2).sum(axis=1)), k)
            out += [(name, a, float(b)) for a, b in zip(*found)]
    return out


def _search(base: DataFrame, queries: DataFrame, k: int, block: int = 8192, query_block: int = 1024) -> DataFrame:
    """Top k per query among the vectors that share a ``_cell`` with it; both sides are (_cell, id, embedding).

    Cells are cut into parts of about ``block`` vectors and ``query_block`` queries by counts, and every
    pair of parts is a task's group of bounded size: nothing is collected or broadcast, and a cell that
    holds most of the vectors is spread like any other. Only k rows per query leave a group.
    """
    base, queries = (df.filter("embedding IS NOT NULL").select("_cell", "id", F.col("embedding").cast("array<double>").alias("v"))
                     for df in (base, queries))
    parts = staged(
        base.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("_b"))
        .join(queries.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / query_block).alias("_q")), "_cell"))
    zero = F.lit(0).cast("long")
    vectors = base.join(parts, "_cell").select(
        "_cell", "id", "v", F.lit(False).alias("asks"), F.pmod(F.xxhash64("id"), "_b").alias("_b"),
        F.explode(F.sequence(zero, F.col("_q") - 1)).alias("_q"))
    asked = queries.join(parts, "_cell").select(
        "_cell", "id", "v", F.lit(True).alias("asks"), F.explode(F.sequence(zero, F.col("_b") - 1)).alias("_b"),
        F.pmod(F.xxhash64("id"), "_q").alias("_q"))

    def scan(pdf):
        asks = pdf["asks"].to_numpy(bool)
        ids, values = pdf["id"].to_numpy(dtype=object), pdf["v"].to_numpy()
        if asks.all() or not asks.any():
            return pd.DataFrame({"query_id": [], "id": [], "distance": []})
        found = _best(ids[~asks], np.stack(values[~asks]), ids[asks], np.stack(values[asks]), k)
        return pd.DataFrame(found, columns=["query_id", "id", "distance"])

    near = vectors.unionByName(asked).groupBy("_cell", "_b", "_q").applyInPandas(scan, RESULT)
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return near.distinct().withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def knn_exact(base: DataFrame, queries: DataFrame, k: int = 10, keep: Column | None = None, block: int = 8192,
              query_block: int = 1024) -> DataFrame:
    """Exact Euclidean neighbours (query_id, id, distance, rank) of every query.

    Both sides have (id string, embedding). ``keep`` filters the collection first.
    """
    base = base if keep is None else base.filter(keep)
    one = F.lit(0).cast("long").alias("_cell")
    return _search(base.select(one, "id", "embedding"), queries.select(one, "id", "embedding"), k, block, query_block)


def ivf_centres(base: DataFrame, nlist: int | None = None, seed: int = 1, max_iter: int = 10,
                train_share: float = 1.0) -> np.ndarray:
    """``nlist`` cluster centres of the collection, by default the square root of its size.

    ``train_share`` trains them on a part of a very large collection; the search still reads every
    vector of the lists it visits.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = base.count()
    lists = max(1, min(nlist or math.isqrt(n), n))
    rows = base if train_share >= 1 else base.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(train_share * 1_000_000))
    data = rows.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    if lists == 1:
        first = base.select("embedding").first()
        model_centres = [np.array(first[0] if first else [], dtype=np.float64)]
    else:
        model_centres = KMeans(k=lists, seed=seed, maxIter=max_iter).fit(data).clusterCenters()
    return np.array(model_centres)


def ivf_build(base: DataFrame, path: str, centres: np.ndarray) -> None:
    """Write the collection by inverted list: one folder for each centre, holding the vectors nearest to it."""

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                near = _squares(np.stack(pdf["embedding"].to_numpy()).astype(np.float64), centres).argmin(axis=1)
                yield pdf.assign(list=near)

    rows = base.filter("embedding IS NOT NULL").select("id", "embedding").mapInPandas(
        assign, "id string, embedding array<float>, list long")
    rows.repartition("list", F.pmod(F.xxhash64("id"), F.lit(8))).write.partitionBy("list").parquet(path)


def ivf_search(spark, path: str, centres: np.ndarray, queries: DataFrame, k: int = 10, nprobe: int = 128) -> DataFrame:
    """Neighbours from a stored index; of its folders only those of the queries' ``nprobe`` nearest centres are read."""
    nprobe = min(nprobe, len(centres))

    def probe(batches):
        for pdf in batches:
            if len(pdf):
                far = _squares(np.stack(pdf["embedding"].to_numpy()).astype(np.float64), centres)
                lists = np.argsort(far, axis=1, kind="stable")[:, :nprobe]
                yield pdf.loc[pdf.index.repeat(nprobe)].assign(_cell=lists.ravel())

    probes = staged(queries.filter("embedding IS NOT NULL").select("id", F.col("embedding").cast("array<double>").alias("embedding"))
                    .mapInPandas(probe, "id string, embedding array<double>, _cell long"))
    lists = [r[0] for r in probes.select("_cell").distinct().collect()]  # at most one number for each centre
    index = spark.read.schema("id string, embedding array<float>, list long").parquet(path).filter(F.col("list").isin(lists))
    return _search(index.select(F.col("list").alias("_cell"), "id", "embedding"), probes, k)


def knn_ivf(base: DataFrame, queries: DataFrame, k: int = 10, nprobe: int = 128, nlist: int | None = None, seed: int = 1,
            centres: np.ndarray | None = None, keep: Column | None = None) -> DataFrame:
    """Build an index in the shared folder and search it; keep the path of :func:`ivf_build` to search it again."""
    centres = ivf_centres(base, nlist, seed) if centres is None else centres
    path = f"{shared_folder(base.sparkSession)}/ivf-{uuid.uuid4().hex}"
    ivf_build(base if keep is None else base.filter(keep), path, centres)
    return ivf_search(base.sparkSession, path, centres, queries, k, nprobe)


def lsh_directions(dim: int, width: float, tables: int, projections: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(size=(dim, tables * projections)), rng.uniform(0, width, size=tables * projections)


def knn_lsh(base: DataFrame, queries: DataFrame, k: int = 10, width: float = 1.0, tables: int = 8, projections: int = 2,
            seed: int = 1, keep: Column | None = None) -> DataFrame:
    """Approximate neighbours: vectors that share a bucket with the query in at least one random projection table.

    A bucket is a cell of the search, so vectors meet only the queries of their buckets.
    """
    base = base if keep is None else base.filter(keep)

    def hashed(df: DataFrame) -> DataFrame:
        def cells(batches):
            for pdf in batches:
                if len(pdf):
                    vectors = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
                    directions, shifts = lsh_directions(vectors.shape[1], width, tables, projections, seed)
                    codes = np.floor((vectors @ directions + shifts) / width).astype(np.int64)
                    codes = codes.reshape(len(pdf), tables, projections)
                    yield pdf.assign(codes=[[[t, *c] for t, c in enumerate(row)] for row in codes.tolist()])

        coded = df.filter("embedding IS NOT NULL").select("id", F.col("embedding").cast("array<double>").alias("embedding")).mapInPandas(
            cells, "id string, embedding array<double>, codes array<array<bigint>>")
        return coded.select("id", "embedding", F.explode("codes").alias("_code")).select(
            F.xxhash64("_code").alias("_cell"), "id", "embedding")

    return _search(hashed(base), hashed(queries), k)


def doc_search(df: DataFrame, criteria: dict, limit: int = 100, offset: int = 0, order: Sequence[str] = ("id",)) -> DataFrame:
    """Search documents by field: ``*_num`` takes a (low, high) range, ``*_tag`` a value or a list, any
    other field terms that must all occur as words."""
    for name, wanted in criteria.items():
        if name.endswith("_num"):
            low, high = wanted
            df = df.filter(F.col(name).between(low, high))
        elif name.endswith("_tag"):
            df = df.filter(F.col(name).isin(list(wanted)) if isinstance(wanted, (list, tuple)) else F.col(name) == wanted)
        else:
            words = F.split(F.lower(F.col(name)), r"[^\p{L}\p{N}]+")
            for term in str(wanted).lower().split():
                df = df.filter(F.array_contains(words, term))
    return df.orderBy(*order).offset(offset).limit(limit)
