"""Exact top-k search by inner product with multi-resolution segment statistics.

Every vector is cut into 1, then 4, then 16 segments; a segment is known by its mean and its deviation. By the
Cauchy-Schwarz inequality the product of two segments is at most length * (mean * mean + deviation * deviation),
which bounds the inner product from above, and so bounds the distance |q|^2 + |c|^2 - 2 q.c from below. Levels
are tried coarse to fine: a pair that can't reach the k-th best exact score known so far is gone, survivors of
the finest level get exact integer products. No candidate is lost.

Queries and candidates are dealt in blocks of bounded size, one task for each pair of blocks, and only the k best
of a block pair go on to the merge.

Defined results: vectors that are null or hold null or non-finite components, and rows without an id, take no
part; vectors of another length than the query's are no candidates; ties go to the smaller id; repeated rows
are candidates each, but a row with the query's id is never its answer; too few candidates give fewer rows.
Scores must fit 64 bits. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = (1, 4, 16)
EXACT = 2.0 ** 53


def _statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each segment, scaled so that the bound of two rows is their inner product."""
    out = []
    for part in np.array_split(x, min(segments, x.shape[1]), axis=1):
        mean = part.mean(axis=1)
        spread = np.sqrt(np.maximum(((part - mean[:, None]) ** 2).sum(axis=1), 0))
        out += [mean * math.sqrt(part.shape[1]), spread]
    return np.stack(out, axis=1)


def _dot(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    if q.size and c.size and np.abs(q).max() * np.abs(c).max() * q.shape[1] >= EXACT:
        return q.astype(object) @ c.T.astype(object)
    return q @ c.T


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int,
                 step: int = 64) -> list[tuple[int, int, int]]:
    """The k best (query id, id, score) of each query; all vectors of one length, components whole numbers."""
    if not vectors.shape[1]:
        return [(int(q), int(i), 0) for q in query_ids for i in sorted(ids[ids != q].tolist())[:k]]
    found, order = [], np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    levels = [(s, _statistics(vectors, s)) for s in LEVELS]
    for at in range(0, len(query_ids), step):
        names, block = query_ids[at:at + step], queries[at:at + step]
        other = names[:, None] != ids[None, :]
        floor = None
        alive = np.ones(len(ids), dtype=bool)
        for segments, stats in levels:
            bound = np.full((len(names), len(ids)), -1e308)
            bound[:, alive] = _statistics(block, segments) @ stats[alive].T
            bound[~other] = -1e308
            if floor is None:  # exact scores of the most promising give the first threshold
                few = min(4 * k, len(ids))
                best = np.argpartition(-bound, few - 1, axis=1)[:, :few]
                exact = np.stack([_dot(block[i:i + 1], vectors[b])[0] for i, b in enumerate(best)])
                exact = np.where(np.take_along_axis(other, best, axis=1), exact.astype(float), -np.inf)
                floor = np.sort(exact, axis=1)[:, max(few - k, 0)] if few >= k else np.full(len(names), -np.inf)
            slack = 1e-9 * (np.abs(bound) + np.abs(np.where(np.isfinite(floor), floor, 0))[:, None]) + 1e-6
            other &= bound + slack >= floor[:, None]
            alive = other.any(axis=0)
        columns = np.flatnonzero(alive)
        scores = _dot(block, vectors[columns])
        for i, name in enumerate(names):
            mine = np.flatnonzero(other[i, columns])
            values = scores[i, mine]
            top = np.argsort(-values, kind="stable")[:k]  # ids ascend, so ties keep the smaller one
            found += [(int(name), int(ids[columns[mine[j]]]), int(values[j])) for j in top]
    return found


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id",
          vector_col: str = "embedding", query_block: int = 1024, block: int = 8192) -> DataFrame:
    """Rows (query_id, rank, ``id_col``, score): the k highest products of floor(scale * component) per query."""
    whole = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = (
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"),
                       F.coalesce(is_query, F.lit(False)).alias("is_query"))
        .where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(whole)
    )
    n, asked = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("is_query").cast("long")), F.lit(0))).first()
    n_blocks, n_asked = max(1, math.ceil(n / block)), max(1, math.ceil(asked / query_block))
    spread = rows.withColumn("c", F.pmod(F.xxhash64("id", "v"), F.lit(n_blocks)).cast("int")).withColumn(
        "q", F.pmod(F.xxhash64(F.lit(5), "id", "v"), F.lit(n_asked)).cast("int"))
    candidates = spread.select("id", "v", F.lit(False).alias("is_query"), "c",
                               F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))).alias("q"))
    queries = spread.where("is_query").select(
        "id", "v", "is_query", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("c"), "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: dict[tuple[int, bool], list] = {}
        for batch in batches:
            sizes = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            asks = batch.column("is_query").to_numpy(zero_copy_only=False)
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            for size in np.unique(sizes):
                for ask in (False, True):
                    pick = np.flatnonzero((sizes == size) & (asks == ask))
                    values = flat[starts[pick][:, None] + np.arange(size)[None, :]]
                    sides.setdefault((int(size), ask), []).append((ids[pick], np.floor(scale * values)))
        found = []
        for size in {s for s, _ in sides}:
            (query_ids, queries_), (ids, values) = (
                [np.concatenate(x) for x in zip(*sides[size, ask], strict=True)] for ask in (True, False))
            if len(query_ids) and len(ids):
                found += search_block(query_ids, queries_, ids, values, k)
        columns = list(zip(*found, strict=True)) if found else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in columns], ["query_id", "id", "score"])

    near = candidates.unionByName(queries).groupBy("c", "q").applyInArrow(run, "query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias(id_col), "score")
