"""A vector index by inverted lists that is kept up to date: inserts, deletions, splits of overfull lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslake.operators.vectors import _search, _squares
from opslake.session import staged

_ROWS = "id string, embedding array<float>, batch int, list int"


class IvfIndex:
    """Inverted lists under ``path``; every change is a numbered batch and a repeated batch replaces its own files.

    ``lists/batch=<n>/list=<k>`` holds the vectors that batch n put into list k, so an insert writes files of the lists it
    meets and touches no other. ``gone/batch=<n>`` names ids whose rows up to a batch count no longer; inserting an id again
    replaces it. ``centres/batch=<n>`` holds the lists in use (bounded by their number) and is written last: a list that was
    split is in use no longer, and its rows are found in the two that took its place.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def create(self, base: DataFrame, centres: np.ndarray) -> None:
        self._write_centres(list(enumerate(np.asarray(centres, dtype=np.float64).tolist())), 0)
        self._write_gone(base.select("id").where("false"), 0, 0)
        self._put(base, 0)

    def centres(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the lists in use, and their centres."""
        held = self.spark.read.option("basePath", f"{self.path}/centres").parquet(f"{self.path}/centres/batch=*")
        newest = held.agg(F.max("batch")).first()[0]
        rows = sorted((r["list"], r["centre"]) for r in held.where(F.col("batch") == newest).collect())
        return np.array([k for k, _ in rows]), np.array([c for _, c in rows], dtype=np.float64)

    def rows(self, lists: list[int] | None = None) -> DataFrame:
        """Living vectors (id, embedding, list) of the lists in use, or of some of them; other lists are not read."""
        wanted = [int(k) for k in (self.centres()[0] if lists is None else lists)]
        held = self.spark.read.schema(_ROWS).option("basePath", f"{self.path}/lists").parquet(f"{self.path}/lists")
        gone = self.spark.read.schema("id string, upto int").parquet(f"{self.path}/gone/batch=*").groupBy("id").agg(F.max("upto").alias("upto"))
        held = held.where(F.col("list").isin(wanted))
        alive = held.join(gone.withColumnRenamed("id", "_id"), (F.col("id") == F.col("_id")) & (F.col("batch") <= F.col("upto")), "left_anti")
        return alive.select("id", "embedding", "list")

    def insert(self, rows: DataFrame, batch: int) -> None:
        """Add vectors (id, embedding), each id once, as batch ``batch``; known ids take the new vector."""
        self._write_gone(rows.select("id"), batch - 1, batch)
        self._put(rows, batch)

    def delete(self, ids: DataFrame, batch: int) -> None:
        self._write_gone(ids.select("id"), batch, batch)

    def split(self, most: int, batch: int, seed: int = 1) -> list[int]:
        """Split every list of more than ``most`` vectors in two, around centres trained on its own vectors; other lists are not
        written. Returns the numbers of the lists that were split. Lists of equal vectors stay as they are."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        names, points = self.centres()
        full = [r["list"] for r in self.rows().groupBy("list").count().where(F.col("count") > most).collect()]
        used, done, parts = {int(k): c for k, c in zip(names, points.tolist(), strict=True)}, [], []
        for number in sorted(full):
            mine = self.rows([number])
            data = mine.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
            found = KMeans(k=2, seed=seed, maxIter=10).fit(data).clusterCenters()
            if len(found) < 2:
                continue
            first = max([*used, *names.tolist(), -1]) + 1
            used.pop(number)
            pair = {first: found[0].tolist(), first + 1: found[1].tolist()}
            used |= pair
            parts.append((mine.select("id", "embedding"), pair))
            done.append(number)
        for i, (mine, pair) in enumerate(parts):
            self._put(mine, batch, (np.array(list(pair)), np.array(list(pair.values()))), "overwrite" if i == 0 else "append")
        if done:
            self._write_centres(sorted(used.items()), batch)
        return done

    def search(self, queries: DataFrame, k: int = 10, nprobe: int = 128) -> DataFrame:
        """Neighbours (query_id, id, distance, rank) among the vectors of the ``nprobe`` lists nearest to each query."""
        names, points = self.centres()
        nprobe = min(nprobe, len(names))

        def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    far = _squares(np.stack(pdf["embedding"].to_numpy()).astype(np.float64), points)
                    near = np.argsort(far, axis=1, kind="stable")[:, :nprobe]
                    yield pdf.loc[pdf.index.repeat(nprobe)].assign(_cell=names[near].ravel().astype(np.int64))

        probes = staged(queries.filter("embedding IS NOT NULL").select("id", F.col("embedding").cast("array<double>").alias("embedding"))
                        .mapInPandas(probe, "id string, embedding array<double>, _cell long"))
        asked = [r[0] for r in probes.select("_cell").distinct().collect()]  # at most one number for each list
        return _search(self.rows(asked).select(F.col("list").cast("long").alias("_cell"), "id", "embedding"), probes, k)

    def _put(self, rows: DataFrame, batch: int, among: tuple[np.ndarray, np.ndarray] | None = None, mode: str = "overwrite") -> None:
        names, points = among or self.centres()

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    near = _squares(np.stack(pdf["embedding"].to_numpy()).astype(np.float64), points).argmin(axis=1)
                    yield pdf.assign(list=names[near].astype(np.int32))

        placed = rows.filter("embedding IS NOT NULL").select("id", "embedding").mapInPandas(assign, "id string, embedding array<float>, list int")
        placed.repartition("list", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode(mode).partitionBy("list").parquet(f"{self.path}/lists/batch={batch}")

    def _write_gone(self, ids: DataFrame, upto: int, batch: int) -> None:
        ids.select("id", F.lit(upto).alias("upto")).write.mode("overwrite").parquet(f"{self.path}/gone/batch={batch}")

    def _write_centres(self, held: list[tuple[int, list[float]]], batch: int) -> None:
        self.spark.createDataFrame(held, "list int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centres/batch={batch}")
