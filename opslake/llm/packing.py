"""Sharding as vector bin packing: bytes, tokens and rows are balanced together.

Rows with equal texts form a group, and a group is placed whole on the shard where the dot product of its
(bytes, tokens, rows) with the shard's residual capacity is highest; the largest groups come first.

- Heavy groups hold more than 1 / ``grain`` of a shard in some dimension, so there are at most
  3 * shards * grain of them; they are placed first, on the driver.
- A group larger than a shard can't be placed whole. It is cut by the hash of the row id into pieces of at
  most about half a shard. This is the only case in which equal texts part.
- Light groups fall by hash into lots of about ``lot_groups`` groups. Each lot is packed by a task of its own
  into its share of the capacity that the heavy groups left, so lots don't depend on each other.

Slots are numbered by adding up row counts of (shard, cell), a cell being a hash range of row ids, so no task
orders a whole shard.

Defined results: a null text has the size of an empty one and falls in one group with it; null ids and repeated
rows are rows like others, each with a slot of its own; an empty table gives an empty result; ties go to the
lower shard. Further columns of the input are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opslake.session import staged

DIMENSIONS = ("bytes", "tokens", "rows")
SALTS = 4096


def place(items: np.ndarray, residual: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Shard of each item: the largest first, by dot product with the residual capacity, which is used up.

    ``items`` and ``residual`` have a row per item and shard and a column per dimension; ``unit`` is what one
    shard is meant to hold and makes the dimensions comparable.
    """
    parts, free = items / unit, residual / unit
    shard = np.zeros(len(items), dtype=np.int32)
    for i in np.argsort(-parts.max(axis=1), kind="stable"):
        best = int(np.argmax(free @ parts[i]))
        free[best] -= parts[i]
        shard[i] = best
    residual[:] = free * unit
    return shard


def pack(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16,
         grain: int = 64, lot_groups: int = 10_000, cell_rows: int = 500) -> DataFrame:
    """Rows (id, size, text_crc32, shard, slot), one per input row."""
    spark, text = docs.sparkSession, F.coalesce(F.col(text_col), F.lit(""))
    rows = staged(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("g1"), F.xxhash64(F.lit(1), text).alias("g2"),
    ))
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    groups = staged(rows.groupBy("g1", "g2").agg(*sums))
    total = groups.agg(*[F.sum(d).alias(d) for d in DIMENSIONS], F.count(F.lit(1)).alias("groups")).first()
    if not total["groups"]:
        return rows.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit(0).alias("shard"),
                           F.lit(0).cast("long").alias("slot"))
    unit = np.array([max(total[d], 1) / shards for d in DIMENSIONS])

    largest = F.greatest(*[F.col(d) / F.lit(float(u)) for d, u in zip(DIMENSIONS, unit, strict=True)])
    big = groups.where(largest > F.lit(1.0 / grain)).withColumn("largest", largest).toPandas()
    parted = big[big["largest"] > 1].copy()
    whole = big[big["largest"] <= 1].assign(piece=0)
    rows = rows.withColumn("piece", F.lit(0))
    if len(parted):
        parted["pieces"] = np.ceil(2 * parted["largest"]).astype(int)
        cuts = spark.createDataFrame(parted[["g1", "g2", "pieces"]], "g1 long, g2 long, pieces int")
        salt = F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(SALTS))
        rows = rows.join(F.broadcast(cuts), ["g1", "g2"], "left").withColumn(
            "piece", F.when(F.col("pieces").isNull(), 0).otherwise(F.floor(salt * F.col("pieces") / SALTS)).cast("int"))
        pieces = rows.where(F.col("pieces").isNotNull()).groupBy("g1", "g2", "piece").agg(*sums).toPandas()
        whole = pd.concat([whole, pieces], ignore_index=True)
        rows = rows.drop("pieces")
    whole = whole.sort_values(["g1", "g2", "piece"], ignore_index=True)

    residual = np.tile(unit, (shards, 1))
    heavy = whole[["g1", "g2", "piece"]].assign(
        heavy_shard=place(whole[list(DIMENSIONS)].to_numpy(float).reshape(-1, 3), residual, unit))
    heavy = spark.createDataFrame(heavy, "g1 long, g2 long, piece int, heavy_shard int")

    light_total = np.maximum(unit * shards - whole[list(DIMENSIONS)].to_numpy(float).sum(axis=0), 1e-9)
    lots = math.ceil(total["groups"] / lot_groups)

    def pack_lot(lot: pd.DataFrame) -> pd.DataFrame:
        lot = lot.sort_values(["g1", "g2"], ignore_index=True)
        items = lot[list(DIMENSIONS)].to_numpy(float)
        share = residual * (items.sum(axis=0) / light_total)
        return lot[["g1", "g2"]].assign(light_shard=place(items, share, np.maximum(share.mean(axis=0), 1e-9)))

    light = (
        groups.where(largest <= F.lit(1.0 / grain)).withColumn("lot", F.pmod(F.xxhash64("g1", "g2"), F.lit(lots)))
        .groupBy("lot").applyInPandas(pack_lot, "g1 long, g2 long, light_shard int")
    )
    marked = rows.join(F.broadcast(heavy), ["g1", "g2", "piece"], "left")
    columns = ["id", "size", "text_crc32"]
    placed = staged(
        marked.where(F.col("heavy_shard").isNotNull()).select(*columns, F.col("heavy_shard").alias("shard"))
        .unionByName(marked.where(F.col("heavy_shard").isNull()).join(light, ["g1", "g2"])
                     .select(*columns, F.col("light_shard").alias("shard")))
    )

    cells = math.ceil(total["rows"] / (shards * cell_rows))
    placed = placed.withColumn("cell", F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(cells)))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n")).select(
        "shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("id", "size", "text_crc32")) - 1
    return placed.withColumn("inside", inside).join(offsets, ["shard", "cell"]).select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("offset") + F.col("inside")).alias("slot"))
