"""Tables that change by key: buckets of keys, one folder of changes per batch, merged when they are read."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST = -1  # the batch that a table begins with


class KeyedTable:
    """A table of one row per key under ``path``.

    A batch writes rows only of the keys it changes, into the buckets they fall in: ``data/batch=<n>/bucket=<k>``. ``live/batch=<n>``
    lists for each bucket the batches to be read. A bucket that would hold more than ``most_changes`` batches is written out whole
    by the batch that touches it, without rows that are deleted or ``expired``, and its list starts anew; buckets that a batch does not
    touch are neither read nor written. A batch that is repeated starts from the list of the batch before it and replaces
    its own folders, and readers see it when its list is there.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64, most_changes: int = 8, expired: Column | None = None):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.most_changes, self.expired = most_changes, expired

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def create(self, rows: DataFrame) -> None:
        """Begin with these rows."""
        self._write(rows.withColumn("_deleted", F.lit(False)), FIRST, {}, set())

    def last(self) -> int:
        """The newest batch."""
        lists = self.spark.read.option("basePath", f"{self.path}/live").parquet(f"{self.path}/live")
        return lists.agg(F.max("batch")).first()[0]

    def listed(self, batch: int) -> dict[int, list[int]]:
        """The batches to be read of each bucket, oldest first, as of a batch. One row for each bucket."""
        lists = self.spark.read.parquet(f"{self.path}/live/batch={batch}").where("bucket IS NOT NULL")
        return {r["bucket"]: list(r["batches"]) for r in lists.collect()}

    def read(self, batch: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """The newest row of every key, of all or of some buckets. Only buckets with several batches are merged."""
        batch = self.last() if batch is None else batch
        live = self.listed(batch)
        wanted = live if buckets is None else {k: live[k] for k in set(buckets) if k in live}
        one = [self._folder(b[0], k) for k, b in wanted.items() if len(b) == 1]
        more = [self._folder(n, k) for k, b in wanted.items() if len(b) > 1 for n in b]
        newest = self._load(more).groupBy(self.key).agg(F.max_by(F.struct("*"), "batch").alias("_r")).select("_r.*")
        rows = self._load(one).unionByName(newest).where("NOT _deleted").drop("_deleted", "batch", "bucket")
        return rows if self.expired is None else rows.where(~F.coalesce(self.expired, F.lit(False)))

    def write(self, changes: DataFrame, batch: int, before: int | None = None, deleted: Column | None = None) -> None:
        """Store the changed rows, one per key, as batch ``batch`` on top of batch ``before`` (the one before it);
        rows where ``deleted`` holds take their key away."""
        before = batch - 1 if before is None else before
        live = self.listed(before)
        changes = changes.withColumn("_deleted", F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)).persist()
        try:
            self._merge(changes, batch, before, live)
        finally:
            changes.unpersist()

    def _merge(self, changes: DataFrame, batch: int, before: int, live: dict[int, list[int]]) -> None:
        touched = {r[0] for r in changes.select(self.bucket()).distinct().collect()}
        full = {k for k in touched if len(live.get(k, [])) >= self.most_changes}
        if full:
            kept = self.read(before, full).join(changes.select(self.key), self.key, "left_anti").withColumn("_deleted", F.lit(False))
            gone = self.bucket().isin(sorted(full)) & F.col("_deleted")
            changes = changes.where(~gone).unionByName(kept)
        self._write(changes, batch, live, full)

    def remove_dead(self, keep: int = 1) -> list[str]:
        """Delete bucket folders that none of the newest ``keep`` lists names. Returns their paths."""
        last = self.last()
        needed = {(n, k) for b in range(max(FIRST, last - keep + 1), last + 1) for k, batches in self.listed(b).items() for n in batches}
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        files = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(conf)
        removed = []
        for found in files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/batch=*/bucket=*")):
            name = found.getPath().toString()
            at = (int(name.split("/batch=")[-1].split("/")[0]), int(name.split("/bucket=")[-1]))
            if at not in needed and at[0] <= last and files.delete(found.getPath(), True):
                removed.append(name)
        return removed

    def _folder(self, batch: int, bucket: int) -> str:
        return f"{self.path}/data/batch={batch}/bucket={bucket}"

    def _load(self, folders: list[str]) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.path}/schema").schema
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*folders)

    def _write(self, rows: DataFrame, batch: int, live: dict[int, list[int]], anew: set[int]) -> None:
        rows = rows.withColumn("bucket", self.bucket())
        if batch == FIRST:
            shape = rows.where("false").withColumns({"bucket": F.lit(0), "batch": F.lit(0)})
            shape.write.mode("overwrite").parquet(f"{self.path}/schema")
        where = f"{self.path}/data/batch={batch}"
        # One file for a small bucket, several written beside each other for a large one.
        rows.hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(where)
        stored = self.spark.read.schema(rows.schema).option("basePath", where).parquet(where)
        touched = {r[0] for r in stored.select("bucket").distinct().collect()}
        lists = dict(live) | {k: [batch] for k in anew} | {k: [*live.get(k, []), batch] for k in touched - anew}
        lists = {k: v for k, v in lists.items() if k in touched or k not in anew}
        known = [*sorted(lists.items()), (None, [])]  # the last row shows a batch even where there is no bucket
        self.spark.createDataFrame(known, "bucket int, batches array<int>").coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/live/batch={batch}")
