"""Writers and the row shapes they write."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_log = logging.getLogger(__name__)


def write_partitioned(df: DataFrame, root: str, processing_date: str, by: str = "source_system",
                      max_records: int = 1_000_000) -> None:
    """Replace everything under ``root/processing_date=...``, split by ``by``, zstd files.

    The rebalance hint lets AQE cut a large ``by`` value over many tasks and merge small ones.
    """
    (
        df.drop("processing_date").hint("rebalance", by)
        .write.mode("overwrite").option("partitionOverwriteMode", "static").option("compression", "zstd")
        .option("maxRecordsPerFile", max_records).partitionBy(by)
        .parquet(f"{root}/processing_date={processing_date}")
    )


def metric_rows(metrics: DataFrame, execution_id: str, as_of: Column) -> DataFrame:
    """One row per metric column: (execution_id, metric_name, metric_value string, timestamp)."""
    text = metrics.select(*[F.col(c).cast("string").alias(c) for c in metrics.columns])
    return text.unpivot([], text.columns, "metric_name", "metric_value").select(
        F.lit(execution_id).alias("execution_id"), "metric_name", "metric_value", as_of.alias("timestamp"))


def append_metrics(metrics: DataFrame, path: str, execution_id: str, as_of: Column) -> None:
    metric_rows(metrics, execution_id, as_of).write.mode("append").parquet(path)


def dlq_envelope(df: DataFrame, original: str, error: Column, topic: Column, at: Column) -> DataFrame:
    """Failed records as (topic ``<topic>_dlq``, value JSON of original, error and timestamp)."""
    body = F.struct(F.col(original).alias("original"), error.alias("error"), at.alias("timestamp"))
    return df.select(F.concat(topic, F.lit("_dlq")).alias("topic"), F.to_json(body).alias("value"))


def bulk_lines(df: DataFrame) -> DataFrame:
    """Bulk-load text: an action line, then the event line, for every record."""
    event = F.to_json(F.struct(*[F.col(c) for c in df.columns]))
    return df.select(F.explode(F.array(F.lit('{"index":{}}'), event)).alias("value"))


def bulk_ndjson(df: DataFrame, path: str, per_file: int = 1000) -> None:
    """Write :func:`bulk_lines` as gzip text, ``per_file`` events in each file.

    The pairs stay together because a record's two lines are made in one task, in order.
    """
    bulk_lines(df).write.mode("overwrite").option("compression", "gzip").option(
        "maxRecordsPerFile", 2 * per_file).text(path)


def failover_write(df: DataFrame, sinks: Sequence[tuple[str, Callable[[DataFrame], None]]],
                   failed: Callable[[DataFrame], None]) -> str:
    """Try the sinks in order; the first success ends. If all fail, ``failed`` gets the rows.

    Returns the name of the sink that took the rows, or ``"failed"``. Only errors of reading and writing move on to
    the next sink. A sink that fails half-way must not show what it wrote: write to a folder of the batch.
    """
    for name, write in sinks:
        try:
            write(df)
            return name
        except (PySparkException, Py4JError, OSError) as error:
            _log.warning("sink %s failed: %s", name, str(error).split("\n")[0])
    failed(df)
    return "failed"


def write_splits(train: DataFrame, test: DataFrame, folder: str) -> None:
    train.write.mode("overwrite").parquet(f"{folder}/train.parquet")
    test.write.mode("overwrite").parquet(f"{folder}/test.parquet")


def tsdb_rows(df: DataFrame, measurement: Column, tags: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Time series rows: measurement, map of tags, map of numeric fields."""

    def pairs(names, kind):
        return F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast(kind))])

    return df.select(measurement.alias("measurement"), pairs(tags, "string").alias("tags"),
                     pairs(fields, "double").alias("fields"))
