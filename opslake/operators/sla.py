"""Service level reporting: availability, latency quantiles, throughput."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslake.operators.ordered import attach, exact_quantiles, histogram_quantiles, value_band
from opslake.session import staged

# Slice lengths in seconds.
GRANULARITY = {"1min": 60, "5min": 300, "1h": 3600}


def availability_expr(success: Column) -> Column:
    """Share of successful requests in percent; 100 when there are none."""
    total = F.count(F.lit(1))
    return F.when(total == 0, 100.0).otherwise(F.count_if(success) / total * 100)


def availability(df: DataFrame, keys: Sequence[str] = (), success: str = "success") -> DataFrame:
    return df.groupBy(*keys).agg(availability_expr(F.col(success)).alias("availability"))


def latency_quantile(df: DataFrame, keys: Sequence[str] = (), q: float = 0.99, latency: str = "latency",
                     name: str = "latency") -> DataFrame:
    """Element at floor(n * (1 - q)) of the descending latencies; 0 when there are none."""
    out = exact_quantiles(df, keys, latency, {name: (q, "desc")})
    if keys:
        return out
    return out.agg(F.coalesce(F.max(name), F.lit(0.0)).alias(name))


def throughput(df: DataFrame, window_s: float, keys: Sequence[str] = ()) -> DataFrame:
    """Requests per second over a window of the given length."""
    return df.groupBy(*keys).agg((F.count(F.lit(1)) / F.lit(window_s)).alias("throughput"))


def sla_metrics(df: DataFrame, keys: Sequence[str], window_s: float) -> DataFrame:
    """Availability, p99 latency and throughput per key."""
    keys = list(keys)
    rates = staged(df.groupBy(*keys).agg(
        availability_expr(F.col("success")).alias("availability"), (F.count(F.lit(1)) / F.lit(window_s)).alias("throughput")))
    slow = staged(exact_quantiles(df, keys, "latency", {"latency_p99": (0.99, "desc")}))
    return attach(rates, slow, keys).withColumn("latency_p99", F.coalesce("latency_p99", F.lit(0.0)))


def in_window(df: DataFrame, as_of: dt.datetime, seconds: float, ts: str = "ts") -> DataFrame:
    start = as_of - dt.timedelta(seconds=seconds)
    return df.filter((F.col(ts) >= F.lit(start)) & (F.col(ts) <= F.lit(as_of)))


def sla_compliance(df: DataFrame, targets: dict[str, float], as_of: dt.datetime, window_s: int = 300,
                   keys: Sequence[str] = ()) -> DataFrame:
    """(metric, actual, target, ok) rows over the window before ``as_of``.

    ``availability`` and ``throughput`` must reach their target, ``latency_p99`` must not exceed it;
    metrics without a target are left out.
    """
    rules = [("availability", ">="), ("latency_p99", "<="), ("throughput", ">=")]
    metrics = sla_metrics(in_window(df, as_of, window_s), keys, window_s)
    entries = []
    for name, op in rules:
        if name in targets:
            actual, target = F.col(name), F.lit(float(targets[name]))
            entries.append(F.struct(F.lit(name).alias("metric"), actual.alias("actual"), target.alias("target"),
                                    (actual >= target if op == ">=" else actual <= target).alias("ok")))
    return metrics.select(*keys, F.inline(F.array(*entries)))


def sla_report(df: DataFrame, as_of: dt.datetime, range_s: int, granularity: str = "5min",
               keys: Sequence[str] = ("service",)) -> DataFrame:
    """Metrics per tumbling slice of event time in [as_of - range_s, as_of)."""
    seconds = GRANULARITY[granularity]
    start = as_of - dt.timedelta(seconds=range_s)
    rows = df.filter((F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(as_of)))
    sliced = rows.withColumn("slice_start", F.window("ts", f"{seconds} seconds")["start"])
    return sla_metrics(sliced, [*keys, "slice_start"], seconds).withColumn(
        "slice_end", F.col("slice_start") + F.expr(f"INTERVAL {seconds} SECONDS"))


def sla_sliding(df: DataFrame, window_s: int = 300, every_s: int = 60, keys: Sequence[str] = ("service",)) -> DataFrame:
    """Metrics of a trailing window, evaluated every ``every_s`` seconds.

    Every row is counted in one pane, by band of its latency; windows are put together from the counts of their panes. Only
    rows of the bands that hold the wanted rank of a window are looked up again to find the exact latency.
    """
    keys, pane_s = list(keys), math.gcd(window_s, every_s)
    start = F.floor(F.unix_seconds("ts") / pane_s).cast("long") * pane_s
    number = F.col("latency").cast("double")
    known = number.isNotNull() & ~F.isnan(number)
    rows = df.select(*keys, start.alias("_pane"), "success", F.when(known, number).alias("_v")).withColumn(
        "_band", F.when(F.col("_v").isNotNull(), value_band(F.col("_v"))))
    panes = staged(rows.groupBy(*keys, "_pane", "_band").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("success").alias("_ok"), F.min("_v").alias("_low"), F.max("_v").alias("_high")))
    first = F.ceil((F.col("_pane") + pane_s - window_s) / every_s).cast("long") * every_s
    last = F.floor(F.col("_pane") / every_s).cast("long") * every_s
    spread = panes.withColumn("_start", F.explode(F.when(first <= last, F.sequence(first, last, F.lit(every_s).cast("long")))))
    windows = [*keys, "_start"]
    rates = staged(spread.groupBy(*windows).agg(
        (F.sum("_ok") / F.sum("_n") * 100).alias("availability"), (F.sum("_n") / F.lit(window_s)).alias("throughput")))
    bands = spread.filter("_band IS NOT NULL").groupBy(*windows, "_band").agg(
        F.sum("_n").alias("_n"), F.min("_low").alias("_low"), F.max("_high").alias("_high"))

    def wanted_rows(found: DataFrame) -> DataFrame:
        its = F.sequence(F.col("_start"), F.col("_start") + window_s - pane_s, F.lit(pane_s).cast("long"))
        asked = found.select(*windows, "_band", F.explode(its).alias("_pane"))
        return attach(rows.select(*keys, "_pane", "_band", "_v"), asked, [*keys, "_pane", "_band"], "inner").select(*windows, "_band", "_v")

    slow = staged(histogram_quantiles(bands, wanted_rows, windows, {"latency_p99": (0.99, "desc")}))
    out = attach(rates, slow, windows).withColumn("latency_p99", F.coalesce("latency_p99", F.lit(0.0)))
    return out.withColumn("window_start", F.timestamp_seconds("_start")).select(*keys, "window_start", "availability", "throughput", "latency_p99")


def throughput_anomalies(samples: DataFrame, keys: Sequence[str], value: str = "rps", sensitivity: float = 3.0,
                         min_samples: int = 30) -> DataFrame:
    """Samples whose z-score (population deviation) per key is beyond the sensitivity.

    Mean and deviation are one small row per key, joined back, so no key has to fit in one task.
    """
    stats = staged(samples.groupBy(*keys).agg(F.count(value).alias("_n"), F.avg(value).alias("_mean"),
                                              F.stddev_pop(value).alias("_std")))
    scored = attach(samples, stats, list(keys)).withColumn(
        "z_score", F.when(F.col("_std") != 0, (F.col(value) - F.col("_mean")) / F.col("_std")).otherwise(0.0))
    return (
        scored.filter((F.col("_n") >= min_samples) & (F.abs("z_score") > sensitivity))
        .withColumn("status", F.when(F.col("z_score") > 0, "high").otherwise("low"))
        .drop("_n", "_mean", "_std")
    )
