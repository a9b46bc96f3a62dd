"""Counters, histograms and gauges over label columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Default upper bounds of histogram buckets.
DEFAULT_BUCKETS = (0.05, 0.1, 0.5, 1, 5, 10)
HTTP_BUCKETS = (0.01, 0.1, 0.5, 1, 5, 10)


def metric_counters(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    return df.groupBy(*labels).agg(F.count(F.lit(1)).alias("value"))


def metric_histogram(df: DataFrame, labels: Sequence[str], value: str,
                     buckets: Sequence[float] = DEFAULT_BUCKETS) -> DataFrame:
    """Cumulative bucket counts with sum and count, one row per label set and bucket.

    All buckets are counted in one pass over the rows; only the totals are unfolded.
    """
    bounds = [float(b) for b in buckets]
    totals = df.groupBy(*labels).agg(
        F.count(value).alias("count"), F.sum(value).alias("sum"),
        *[F.count_if(F.col(value) <= b).alias(f"_le{i}") for i, b in enumerate(bounds)])
    cells = [F.struct(F.lit(str(b)).alias("le"), F.col(f"_le{i}").alias("bucket")) for i, b in enumerate(bounds)]
    cells.append(F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("bucket")))
    return totals.select(*labels, "count", "sum", F.inline(F.array(*cells)))


def metric_gauge(df: DataFrame, labels: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Last value per label set."""
    return df.groupBy(*labels).agg(F.max_by(value, F.struct(*order)).alias("value"))


def metric_snapshot(df: DataFrame, name: str, kind: str, labels: Sequence[str]) -> DataFrame:
    """Current values as (name, type, labels, value) rows."""
    pairs = [x for c in labels for x in (F.lit(c), F.col(c).cast("string"))]
    return df.select(F.lit(name).alias("name"), F.lit(kind).alias("type"), F.create_map(*pairs).alias("labels"),
                     F.col("value").cast("double").alias("value"))
