"""Batch cleaning and transformation of events, with data-quality counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslake.functions import scalars as S

_TIE_ORDER = ("event_time", "user_id", "value", "source_system")


def dedupe_events(df: DataFrame, key: str = "event_id") -> DataFrame:
    """One row per key: the smallest by event_time, user_id, value, source_system, nulls last.

    Spark cuts every key to one row before the shuffle, so repeated ids do not pile up in a task.
    """
    present = [c for c in _TIE_ORDER if c in df.columns]
    rest = [c for c in df.columns if c not in present and c != key]
    w = Window.partitionBy(key).orderBy(*[F.col(c).asc_nulls_last() for c in [*present, *rest]])
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def fill_defaults(df: DataFrame) -> DataFrame:
    return df.withColumns({"user_id": S.fill_default(F.col("user_id"), S.ANONYMOUS),
                           "value": S.fill_default(F.col("value"), 0.0)})


def etl_clean(df: DataFrame, processing_date: str) -> DataFrame:
    """Dedupe, fill defaults, keep rows from the processing date on, drop rows without id or time."""
    return (
        fill_defaults(dedupe_events(df))
        .filter(F.col("event_time") >= F.lit(processing_date).cast("timestamp"))
        .dropna(subset=["event_id", "event_time"])
    )


def etl_transform(df: DataFrame, processing_date: str, threshold: float = 1000, bucket_s: int = 300) -> DataFrame:
    """Mask the address column if there is one, stamp the date, add category, user hash and time bucket."""
    if "user_ip" in df.columns:
        df = df.withColumn("user_ip", S.mask_ip(F.col("user_ip")))
    return df.withColumn("processing_date", F.lit(processing_date)).select(
        "*",
        S.value_category(F.col("value"), threshold).alias("value_category"),
        S.hash_user(F.col("user_id")).alias("hashed_user_id"),
        S.time_bucket(F.col("event_time"), bucket_s).alias("time_bucket"),
    )


def dq_metrics() -> list[Column]:
    return [F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("user_id") == S.ANONYMOUS).alias("null_user_ids"),
            F.count_if(F.col("value") < 0).alias("negative_values")]


def dq_checks(df: DataFrame) -> DataFrame:
    """Row count, anonymous users and negative values in one pass."""
    return df.agg(*dq_metrics())


def dedupe_exact(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()
