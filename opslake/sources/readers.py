"""Readers for event tables, feature files, logs, message topics and relational sources."""

from __future__ import annotations

import datetime as dt
import io
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType(), False),
    T.StructField("event_time", T.TimestampType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("source_system", T.StringType()),
])


class UnreadableSuffix(ValueError):
    """The file suffix names no known format."""


class NothingToRead(RuntimeError):
    """The input could not be read."""


def read_events(spark: SparkSession, paths: str | Sequence[str], fmt: str = "parquet", base_path: str | None = None,
                schema: T.StructType = EVENT_SCHEMA) -> DataFrame:
    """Event files with a fixed schema; missing columns are null, extra ones are not read.

    ``paths`` may hold globs; ``base_path`` keeps the partition columns of the folders below it.
    """
    reader = spark.read.format(fmt).schema(schema).option("mergeSchema", "true")
    if base_path:
        reader = reader.option("basePath", base_path)
    return reader.load(paths if isinstance(paths, str) else list(paths))


def _read_feather(spark: SparkSession, path: str) -> DataFrame:
    import pandas as pd
    import pyarrow as pa
    import pyarrow.feather as feather
    from pyspark.sql.pandas.types import from_arrow_schema

    files = spark.read.format("binaryFile").load(path)

    def shape(batches):
        for pdf in batches:
            for content in pdf["content"]:
                yield pd.DataFrame({"schema": [feather.read_table(io.BytesIO(content)).schema.serialize().to_pybytes()]})

    first = files.select("content").limit(1).mapInPandas(shape, "schema binary").head()  # a schema comes to the driver, no rows
    if first is None:
        raise NothingToRead(f"no files at {path}")
    schema = from_arrow_schema(pa.ipc.read_schema(pa.BufferReader(bytes(first["schema"]))))

    def rows(batches):
        for pdf in batches:
            for content in pdf["content"]:
                yield from (b.to_pandas() for b in feather.read_table(io.BytesIO(content)).to_batches(65_536))

    return files.select("content").mapInPandas(rows, schema)


def read_auto(spark: SparkSession, path: str, types: dict[str, str] | None = None,
              schema: T.StructType | str | None = None) -> DataFrame:
    """Read by file suffix (.csv, .parquet, .fea, .feather) and cast the columns named in ``types``.

    Give ``schema`` for large CSV files, otherwise Spark reads them once more to infer it.
    """
    suffix = os.path.splitext(path.rstrip("/*"))[1].lower()
    if suffix == ".csv":
        reader = spark.read.option("header", "true")
        df = (reader.schema(schema) if schema else reader.option("inferSchema", "true")).csv(path)
    elif suffix == ".parquet":
        df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    elif suffix in (".fea", ".feather"):
        df = _read_feather(spark, path)
    else:
        raise UnreadableSuffix(f"no reader for files that end in {suffix!r}")
    for name, kind in (types or {}).items():
        df = df.withColumn(name, F.col(name).cast(kind))
    return df


def kafka_options(brokers: str, topics: str | Sequence[str], starting: str = "latest", user: str | None = None,
                  password: str | None = None, protocol: str = "SASL_SSL", mechanism: str = "PLAIN",
                  group: str | None = None, max_per_trigger: int | None = None, fail_on_data_loss: bool = True) -> dict[str, str]:
    """Options of the Kafka source. ``starting`` is ``latest``, ``earliest`` or a JSON of offsets.

    Offsets that are gone stop the query unless ``fail_on_data_loss`` is off.
    """
    options = {
        "kafka.bootstrap.servers": brokers,
        "subscribe": topics if isinstance(topics, str) else ",".join(topics),
        "startingOffsets": starting,
        "failOnDataLoss": str(fail_on_data_loss).lower(),
    }
    if group:
        options["kafka.group.id"] = group
    if max_per_trigger:
        options["maxOffsetsPerTrigger"] = str(max_per_trigger)
    if user is not None:
        options |= {
            "kafka.security.protocol": protocol,
            "kafka.sasl.mechanism": mechanism,
            "kafka.sasl.jaas.config": "org.apache.kafka.common.security.plain.PlainLoginModule required "
                                      f'username="{user}" password="{password}";',
        }
    return options


def kafka_source(spark: SparkSession, streaming: bool = True, **kwargs) -> DataFrame:
    """Topic records as (topic, key, value string, ts). Needs the Kafka connector on the class path."""
    reader = spark.readStream if streaming else spark.read
    raw = reader.format("kafka").options(**kafka_options(**kwargs)).load()
    return raw.select("topic", F.col("key").cast("string").alias("key"),
                      F.col("value").cast("string").alias("value"), F.col("timestamp").alias("ts"))


def jdbc_options(url: str, query: str, user: str | None = None, password: str | None = None, fetch_size: int = 10_000,
                 partition_column: str | None = None, lower: str | int | None = None, upper: str | int | None = None,
                 partitions: int | None = None) -> dict[str, str]:
    """Options to read a query; with a partition column the read runs as parallel range queries."""
    options = {"url": url, "fetchsize": str(fetch_size)}
    if partition_column:
        options |= {"dbtable": f"({query}) AS source", "partitionColumn": partition_column, "lowerBound": str(lower),
                    "upperBound": str(upper), "numPartitions": str(partitions or 8)}
    else:
        options["query"] = query
    if user is not None:
        options |= {"user": user, "password": password or ""}
    return options


def jdbc_source(spark: SparkSession, **kwargs) -> DataFrame:
    """Rows of a relational query. Needs a JDBC driver on the class path."""
    return spark.read.format("jdbc").options(**jdbc_options(**kwargs)).load()


def read_logs(spark: SparkSession, path: str, streaming: bool = False, max_files: int | None = None) -> DataFrame:
    """Raw log lines in one column ``raw``."""
    reader = spark.readStream if streaming else spark.read
    if streaming and max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.format("text").load(path).withColumnRenamed("value", "raw")


def evidence_since(df: DataFrame, as_of: dt.datetime, ts: str = "ts", days: int = 365) -> DataFrame:
    """Audit rows of the last ``days`` days before ``as_of``.

    The bounds are literals of the column's own type, so the filter reaches the scan.
    """
    kind = df.schema[ts].dataType
    return df.filter(F.col(ts).between(F.lit(as_of - dt.timedelta(days=days)).cast(kind), F.lit(as_of).cast(kind)))
