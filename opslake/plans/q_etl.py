"""Event ETL queries."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from opslake.functions import scalars as S
from opslake.operators import etl
from opslake.plans.catalog import query
from opslake.plans.etl_job import batch_etl
from opslake.session import shared_folder
from opslake.sources import readers, sinks

DAY = "2024-01-05"
AS_OF = dt.datetime(2024, 1, 31)

_DEDUPED = """deduped AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY event_time NULLS LAST, user_id NULLS LAST,
                 value NULLS LAST, source_system NULLS LAST, user_ip NULLS LAST) AS n FROM v_raw_events) WHERE n = 1),
clean AS (
  SELECT event_id, event_time, coalesce(user_id, 'ANONYMOUS') AS user_id, coalesce(value, 0.0) AS value, source_system, user_ip
  FROM deduped WHERE event_time >= TIMESTAMP '2024-01-05 00:00:00' AND event_id IS NOT NULL)"""


@query("read_events", "SELECT event_id, event_type, value FROM events")
def _(t):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()),
                           T.StructField("value", T.DoubleType())])
    return readers.read_events(t.spark, [t.path("events")], schema=schema)


@query("evidence_since", """SELECT o_orderkey, epoch_us(o_orderdate) AS at_us FROM orders
WHERE o_orderdate >= TIMESTAMP '2000-08-02 00:00:00' AND o_orderdate <= TIMESTAMP '2001-08-02 00:00:00'""")
def _(t):
    rows = readers.evidence_since(t("orders"), dt.datetime(2001, 8, 2), ts="o_orderdate")
    return rows.select("o_orderkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("at_us"))


@query("etl_fill_defaults", """SELECT event_id, user_ip, source_system, coalesce(user_id, 'ANONYMOUS') AS user_id,
coalesce(value, 0.0) AS value FROM v_raw_events""")
def _(t):
    return etl.fill_defaults(t("v_raw_events")).select("event_id", "user_ip", "source_system", "user_id", "value")


@query("etl_value_category", """SELECT user_ip, event_id, CASE WHEN value > 1000 THEN 'HIGH' ELSE 'NORMAL' END AS value_category
FROM v_raw_events""")
def _(t):
    return t("v_raw_events").select("user_ip", "event_id", S.value_category(F.col("value")).alias("value_category"))


@query("etl_hash_user", "SELECT event_id, sha256(user_id) AS hashed_user_id FROM v_raw_events")
def _(t):
    return t("v_raw_events").select("event_id", S.hash_user(F.col("user_id")).alias("hashed_user_id"))


@query("etl_time_bucket", """SELECT event_id, CAST(floor(epoch(event_time) / 300) AS BIGINT) * 300 AS time_bucket
FROM v_raw_events""")
def _(t):
    return t("v_raw_events").select("event_id", S.time_bucket(F.col("event_time")).alias("time_bucket"))


@query("etl_mask_ip", """SELECT event_id, CASE WHEN length(user_ip) > 0
THEN substr(user_ip, 1, greatest(length(user_ip) - 3, 0)) || '***' END AS user_ip FROM v_raw_events""")
def _(t):
    return t("v_raw_events").select("event_id", S.mask_ip(F.col("user_ip")).alias("user_ip"))


@query("dedupe_events", f"""WITH {_DEDUPED} SELECT event_id, epoch_us(event_time) AS at_us, user_id, value, source_system
FROM deduped""")
def _(t):
    return etl.dedupe_events(t("v_raw_events")).select(
        "event_id", F.unix_micros("event_time").alias("at_us"), "user_id", "value", "source_system")


@query("etl_clean", f"WITH {_DEDUPED} SELECT event_id, epoch_us(event_time) AS at_us, user_id, value, source_system FROM clean")
def _(t):
    return etl.etl_clean(t("v_raw_events"), DAY).select(
        "event_id", F.unix_micros("event_time").alias("at_us"), "user_id", "value", "source_system")


_ETL = f"""WITH {_DEDUPED} SELECT event_id, epoch_us(event_time) AS at_us, user_id, value, source_system,
substr(user_ip, 1, length(user_ip) - 3) || '***' AS user_ip, '2024-01-05' AS processing_date,
CASE WHEN value > 1000 THEN 'HIGH' ELSE 'NORMAL' END AS value_category, sha256(user_id) AS hashed_user_id,
CAST(floor(epoch(event_time) / 300) AS BIGINT) * 300 AS time_bucket FROM clean"""


@query("batch_etl", _ETL)
def batch_etl_query(t):
    out = batch_etl(t("v_raw_events"), DAY)
    return out.withColumn("at_us", F.unix_micros("event_time")).drop("event_time")


@query("dq_checks", f"""WITH {_DEDUPED} SELECT count(*) AS row_count, count(*) FILTER (user_id = 'ANONYMOUS') AS null_user_ids,
count(*) FILTER (value < 0) AS negative_values FROM clean""")
def _(t):
    return etl.dq_checks(batch_etl(t("v_raw_events"), DAY))


@query("append_metrics", f"""WITH {_DEDUPED}, m AS (SELECT count(*) AS row_count,
count(*) FILTER (user_id = 'ANONYMOUS') AS null_user_ids, count(*) FILTER (value < 0) AS negative_values FROM clean)
SELECT 'run-1' AS execution_id, 'row_count' AS metric_name, CAST(row_count AS VARCHAR) AS metric_value, 1706659200 AS at_s FROM m
UNION ALL SELECT 'run-1', 'null_user_ids', CAST(null_user_ids AS VARCHAR), 1706659200 FROM m
UNION ALL SELECT 'run-1', 'negative_values', CAST(negative_values AS VARCHAR), 1706659200 FROM m""")
def _(t):
    rows = sinks.metric_rows(etl.dq_checks(batch_etl(t("v_raw_events"), DAY)), "run-1", F.lit(AS_OF))
    return rows.select("execution_id", "metric_name", "metric_value",
                       F.unix_seconds("timestamp").cast("int").alias("at_s"))


@query("dlq_envelope", """SELECT 'raw_dlq' AS topic, '{"original":"' || event_id ||
'","error":"Missing required fields","timestamp":1706659200}' AS value FROM v_raw_events WHERE event_time IS NULL""")
def _(t):
    bad = t("v_raw_events").filter(F.col("event_time").isNull())
    return sinks.dlq_envelope(bad, "event_id", F.lit("Missing required fields"), F.lit("raw"), F.lit(1706659200))


@query("bulk_ndjson", """SELECT '{"index":{}}' AS value FROM orders
UNION ALL SELECT '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' FROM orders""")
def _(t):
    return sinks.bulk_lines(t("orders").select("o_orderkey", "o_orderstatus"))


@query("bulk_ndjson_files", """SELECT '{"index":{}}' AS value FROM orders
UNION ALL SELECT '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' FROM orders""")
def _(t):
    folder = f"{shared_folder(t.spark)}/ndjson-{uuid.uuid4().hex}"
    sinks.bulk_ndjson(t("orders").select("o_orderkey", "o_orderstatus"), folder)
    return t.spark.read.text(folder)


@query("dedupe_exact", "SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def _(t):
    return etl.dedupe_exact(t("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"))
