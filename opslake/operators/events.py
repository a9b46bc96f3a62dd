"""Device event checks and enrichment, for batch and streaming rows alike."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslake.functions.scalars import json_timestamp

REQUIRED = ("event_id", "timestamp", "device_id")
# Metadata of a device that is not known.
DEFAULT_METADATA = {"location": "unknown", "model": "default"}


def has_fields(body: Column, fields: Sequence[str] = REQUIRED) -> Column:
    """The JSON object has all the keys; a key with a null value counts as present."""
    keys = F.json_object_keys(body)
    return F.coalesce(F.size(F.array_except(F.array(*[F.lit(f) for f in fields]), keys)) == 0, F.lit(False))


def require_fields(df: DataFrame, body: str = "value", fields: Sequence[str] = REQUIRED) -> tuple[DataFrame, DataFrame]:
    """(valid rows, invalid rows); text that is no JSON object is invalid."""
    ok = has_fields(F.col(body), fields)
    return df.filter(ok), df.filter(~ok)


def parse_device_event(df: DataFrame, body: str = "value") -> DataFrame:
    """The required fields as columns, and the whole object as a map of texts."""
    doc = F.col("_doc")
    return df.withColumn("_doc", F.try_parse_json(body)).select(
        *df.columns, F.try_variant_get(doc, "$.event_id", "string").alias("event_id"), json_timestamp(doc).alias("timestamp"),
        F.try_variant_get(doc, "$.device_id", "string").alias("device_id"),
        F.try_variant_get(doc, "$", "map<string,string>").alias("fields"))


def enrich_metadata(events: DataFrame, metadata: DataFrame, key: str = "device_id") -> DataFrame:
    """Add location and model of the device, or the defaults.

    The join kind is left to Catalyst, which broadcasts the metadata only while it is small.
    """
    names = list(DEFAULT_METADATA)
    known = metadata.select(key, *[F.col(n).alias(f"_m_{n}") for n in names])
    return events.join(known, key, "left").withColumns(
        {n: F.coalesce(f"_m_{n}", F.lit(d)) for n, d in DEFAULT_METADATA.items()}).drop(*[f"_m_{n}" for n in names])


def bounded_history(df: DataFrame, key: str, order: Sequence[str], event_id: str, last: int = 1000) -> DataFrame:
    """The last ``last`` event ids per key, oldest first.

    Each task first cuts its part of a key to ``last`` rows, so a busy device shuffles little.
    """
    newest = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    kept = df.select(key, event_id, *order).withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= last)
    return kept.groupBy(key).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("_n", event_id)), asc=False), lambda s: s[event_id]).alias("history"))
