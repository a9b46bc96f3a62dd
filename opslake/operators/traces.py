"""Sampling and service maps from spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _one_in(trace_id: Column, n: int, numeric: bool) -> Column:
    number = trace_id if numeric else F.conv(F.substring(F.md5(trace_id), 1, 8), 16, 10).cast("long")
    return F.pmod(number, F.lit(n)) == 0


def tail_sample(spans: DataFrame, one_in: int = 5) -> DataFrame:
    """Keep every error and high-priority span, and one trace in ``one_in`` of the others."""
    numeric = dict(spans.dtypes)["trace_id"] in ("int", "bigint")
    keep = F.col("error") | (F.col("priority") == "high") | _one_in(F.col("trace_id"), one_in, numeric)
    return spans.filter(F.coalesce(keep, F.lit(False)))


def service_topology(spans: DataFrame) -> DataFrame:
    """Calls between services with their counts.

    Children are counted per (parent span, service) before the join, so a span with very many
    children reaches the join as a few rows.
    """
    children = (
        spans.filter(F.col("parent_id").isNotNull())
        .groupBy(F.col("parent_id").alias("span_id"), F.col("service").alias("target"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return (
        spans.select("span_id", F.col("service").alias("source")).join(children, "span_id")
        .groupBy("source", "target").agg(F.sum("_n").alias("calls"))
    )


def topology_nodes(spans: DataFrame) -> DataFrame:
    """Services seen in the spans, with their span counts."""
    return spans.groupBy(F.col("service").alias("id")).agg(F.count(F.lit(1)).alias("spans"))
