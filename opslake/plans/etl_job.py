"""The batch ETL job and the daily run around it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from opslake.operators.etl import dq_metrics, etl_clean, etl_transform
from opslake.session import staged
from opslake.sources.readers import EVENT_SCHEMA, read_events
from opslake.sources.sinks import append_metrics, write_partitioned


class NothingLeft(ValueError):
    """No rows are left after the transformations."""


@dataclass(frozen=True)
class EtlConfig:
    input_paths: str | list[str]
    output_path: str
    processing_date: str
    metrics_path: str
    execution_id: str = "etl"
    input_format: str = "parquet"
    base_path: str | None = None
    schema: object = field(default=EVENT_SCHEMA)


def batch_etl(events: DataFrame, processing_date: str) -> DataFrame:
    """Cleaned and transformed events."""
    return etl_transform(etl_clean(events, processing_date), processing_date)


def run_etl(spark: SparkSession, config: EtlConfig, as_of: dt.datetime) -> dict[str, int]:
    """Read, clean, transform, check, write. The counts are taken while the result is staged, so the
    input is read and shuffled once."""
    events = read_events(spark, config.input_paths, config.input_format, config.base_path, config.schema)
    counts = Observation("dq")
    ready = staged(batch_etl(events, config.processing_date).observe(counts, *dq_metrics()))
    metrics = {k: int(v) for k, v in counts.get.items()}
    frame = spark.createDataFrame([metrics]).select("row_count", "null_user_ids", "negative_values")
    append_metrics(frame, config.metrics_path, config.execution_id, F.lit(as_of))
    if metrics["row_count"] == 0:
        raise NothingLeft("no row has passed the filters of this day")
    write_partitioned(ready, config.output_path, config.processing_date)
    return metrics


def daily_run(spark: SparkSession, config: EtlConfig, as_of: dt.datetime, environment: str = "prod",
              validate: Callable[[SparkSession], bool] | None = None,
              compliance: Callable[[SparkSession], DataFrame] | None = None) -> dict:
    """Checks (skipped in ``dev``), then the ETL, then the compliance report."""
    if environment != "dev" and validate is not None and not validate(spark):
        raise ValueError("input validation failed")
    result = {"metrics": run_etl(spark, config, as_of)}
    if environment != "dev" and compliance is not None:
        result["compliance"] = compliance(spark)
    return result
