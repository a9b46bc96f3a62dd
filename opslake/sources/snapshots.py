"""Versioned snapshots of a table with checksums."""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


LEAVES = 16
_META = ("version string, created_at timestamp, row_count long, checksum string, schema_hash string, compressed boolean, "
         "leaf_checksums array<string>")


class ChecksumMismatch(ValueError):
    """The stored rows are not those that were written."""


class SchemaDrift(ValueError):
    """The stored schema is not the one that was written."""


def _row_hash(df: DataFrame) -> Column:
    """A row as text that keeps the place of every value and shows nulls, hashed; map entries are sorted first."""
    cells = [F.array_sort(F.map_entries(f.name)).alias(f.name) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`")
             for f in df.schema]
    return F.xxhash64(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}))


def content_checksum(df: DataFrame) -> tuple[int, str]:
    """(row count, checksum) of all rows and columns, whatever their order. The row hashes are summed, so equal rows do not
    cancel each other."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(_row_hash(df).cast("decimal(38,0)")).alias("s")).first()
    return row["n"], str(row["s"] or 0)


def schema_hash(df: DataFrame) -> str:
    parts = [f"{f.name}:{f.dataType.simpleString()}" for f in df.schema]
    return hashlib.sha256("|".join(parts).encode()).hexdigest()


def _meta(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/_snapshots")


def snapshot_write(df: DataFrame, root: str, version: str, as_of: dt.datetime, compression: str = "zstd",
                   partition_by: Sequence[str] = (), key: Sequence[str] = (), leaves: int = LEAVES) -> dict:
    """Write ``root/<version>`` and a metadata row; the data counts as present once that row exists.

    Count and checksum are observed while the rows are written, so nothing is read back. With a ``key`` the rows fall into
    ``leaves`` folders by its hash and each folder has a checksum of its own; sums of neighbours form a tree up to the checksum
    of all, by which :func:`snapshot_diff` finds the folders that differ.
    """
    path, spark = f"{root}/{version}", df.sparkSession
    hashed = _row_hash(df).cast("decimal(38,0)")
    leaf = F.pmod(F.xxhash64(*key), F.lit(leaves)).cast("int") if key else F.lit(0)
    seen = Observation()
    parts = [F.sum(F.when(F.col("_leaf") == i, F.col("_hash"))).alias(f"s{i}") for i in range(leaves)] if key else []
    rows = df.withColumns({"_leaf": leaf, "_hash": hashed}).observe(
        seen, F.count(F.lit(1)).alias("n"), F.sum("_hash").alias("s"), *parts)
    folders = [*partition_by, *(["_leaf"] if key else [])]
    rows.drop(*(["_hash"] if key else ["_hash", "_leaf"])).write.mode("overwrite").option("compression", compression).partitionBy(
        *folders).parquet(path)
    stored = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    found = seen.get
    meta = {"version": version, "created_at": as_of, "row_count": found["n"], "checksum": str(found["s"] or 0), "schema_hash": schema_hash(stored),
            "compressed": compression != "none", "leaf_checksums": [str(found[f"s{i}"] or 0) for i in range(leaves)] if key else []}
    spark.createDataFrame([meta], _META).write.mode("append").parquet(f"{root}/_snapshots")
    return meta


def checksum_tree(leaves: Sequence[str], width: int = 4) -> list[list[int]]:
    """Levels of sums from the leaves to the root; a node sums ``width`` neighbours."""
    levels = [[int(x) for x in leaves]]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sum(last[i:i + width]) for i in range(0, len(last), width)])
    return levels


def unequal_leaves(one: Sequence[str], two: Sequence[str], width: int = 4) -> list[int]:
    """Numbers of the leaves that differ, found by going down from the root where nodes are unequal."""
    a, b = checksum_tree(one, width), checksum_tree(two, width)
    wanted = [0]
    for level in range(len(a) - 1, -1, -1):
        unequal = [i for i in wanted if a[level][i] != b[level][i]]
        if level:
            wanted = [j for i in unequal for j in range(i * width, min((i + 1) * width, len(a[level - 1])))]
    return unequal


def snapshot_diff(spark: SparkSession, root: str, old: str, new: str, key: Sequence[str]) -> DataFrame:
    """(key, change) of the rows that were ``added``, ``removed`` or ``changed`` between two snapshots with the same key; only the
    folders whose checksums differ are read. Keys have to be unique within a snapshot."""
    metas = {r["version"]: r for r in _meta(spark, root).orderBy("created_at").collect() if r["version"] in (old, new)}
    for version in (old, new):
        if version not in metas:
            raise FileNotFoundError(f"no snapshot {version} in {root}")
    one, two = metas[old]["leaf_checksums"], metas[new]["leaf_checksums"]
    if not one or len(one) != len(two):
        raise ValueError("both snapshots need a key and the same number of leaves")
    leaves = unequal_leaves(one, two)
    sides = []
    for version, name in ((old, "_old"), (new, "_new")):
        df = spark.read.parquet(f"{root}/{version}")
        df = df.where(F.col("_leaf").isin(leaves) if leaves else F.lit(False)).drop("_leaf")
        sides.append(df.select(*key, _row_hash(df.select(*sorted(df.columns))).alias(name), F.lit(True).alias(f"{name}_here")))
    joined = sides[0].join(sides[1], list(key), "full_outer")
    change = F.when(F.col("_old_here").isNull(), "added").when(F.col("_new_here").isNull(), "removed").when(
        F.col("_old") != F.col("_new"), "changed")
    return joined.withColumn("change", change).where("change IS NOT NULL").select(*key, "change")


def snapshot_read(spark: SparkSession, root: str, version: str) -> DataFrame:
    """The rows of a snapshot, after comparing schema and checksum with its metadata."""
    meta = _meta(spark, root).filter(F.col("version") == version).orderBy(F.col("created_at").desc()).first()
    if meta is None:
        raise FileNotFoundError(f"no snapshot {version} in {root}")
    df = spark.read.parquet(f"{root}/{version}").drop("_leaf")
    if schema_hash(df) != meta["schema_hash"]:
        raise SchemaDrift(f"schema of {version} changed")
    if content_checksum(df) != (meta["row_count"], meta["checksum"]):
        raise ChecksumMismatch(f"content of {version} changed")
    return df


def snapshots_to_remove(spark: SparkSession, root: str, keep: int = 5) -> list[str]:
    """Versions beyond the newest ``keep``."""
    newest = _meta(spark, root).groupBy("version").agg(F.max("created_at").alias("at")).orderBy(F.col("at").desc(), "version")
    return [r["version"] for r in newest.offset(keep).collect()]


def collection_backup(spark: SparkSession, root: str, name: str, target: str, as_of: dt.datetime) -> dict:
    """Copy a collection folder to a backup with checksum."""
    return snapshot_write(spark.read.parquet(f"{root}/{name}"), target, name, as_of)


def collection_restore(spark: SparkSession, backup: str, name: str, root: str, new_name: str | None = None) -> str:
    """Write a verified backup back, under a new name if given. Returns the name."""
    new_name = new_name or name
    snapshot_read(spark, backup, name).write.mode("overwrite").parquet(f"{root}/{new_name}")
    return new_name


def write_collection(df: DataFrame, root: str, name: str, partition: str | None = None) -> None:
    """Append vectors to a collection, split into named partitions if asked."""
    writer = df.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(f"{root}/{name}")


def read_collection(spark: SparkSession, root: str, name: str, partition: str | None = None, values: Sequence[str] = ()) -> DataFrame:
    """A collection, or only the named partitions of it (the others are not read)."""
    df = spark.read.parquet(f"{root}/{name}")
    return df.filter(F.col(partition).isin(list(values))) if partition and values else df
