"""Device event queries in batch, and the streaming jobs run once over the given files."""

import datetime as dt
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from opslake.operators import events
from opslake.plans.catalog import query
from opslake.session import shared_folder
from opslake.streaming import jobs

AS_OF = dt.datetime(2024, 1, 31)
_EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def _messages(df):
    """Events as JSON messages: view events lack the device, signup events carry it as null."""
    fields = F.struct(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("event_id"),
                      (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("timestamp"))
    text = F.to_json(fields)
    device = F.when(F.col("event_type") == "view", "").when(F.col("event_type") == "signup", ',"device_id":null').otherwise(
        F.concat(F.lit(',"device_id":"d'), F.col("user_id").cast("string"), F.lit('"')))
    body = F.concat(F.regexp_replace(text, r"\}$", ""), device, F.lit("}"))
    return df.select("event_id", F.when(F.col("event_type") == "error", "not json").otherwise(body).alias("value"))


def _metadata(t):
    """One row per customer; those of one segment are of devices that send nothing."""
    name = F.when(F.col("c_mktsegment") == "MACHINERY", "silent").otherwise("d")
    return t("customer").select(F.concat(name, F.col("c_custkey").cast("string")).alias("device_id"),
                                F.col("c_mktsegment").alias("location"), F.col("c_name").alias("model"))


def _stream(t):
    return t.spark.readStream.schema(_EVENTS).parquet(f"{t.folder}/events*.parquet")


def by_time(rows, order, parts=3):
    """The rows in parts of similar size that follow each other in ``order``."""
    at = F.unix_micros(order)
    cuts = rows.agg(F.percentile_approx(at, [i / parts for i in range(1, parts)])).first()[0] or []
    return [rows.filter((F.lit(True) if low is None else at > low) & (F.lit(True) if high is None else at <= high))
            for low, high in zip([None, *cuts], [*cuts, None], strict=True)]


def in_turn(parts, folder, job):
    """The parts as batches of one stream: each is written by as many tasks as it takes, and then read by ``job(stream)``, which
    goes on from its checkpoint."""
    for part in parts:
        part.write.mode("append").parquet(folder)
        job(part.sparkSession.readStream.schema(part.schema).parquet(folder)).awaitTermination()


def _folder(t):
    return f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"


@query("require_fields", "SELECT event_id, event_type IN ('signup', 'click', 'purchase') AS valid FROM events")
def _(t):
    good, bad = events.require_fields(_messages(t("events")))
    return good.select("event_id", F.lit(True).alias("valid")).unionByName(bad.select("event_id", F.lit(False).alias("valid")))


_META = "(SELECT CASE WHEN c_mktsegment = 'MACHINERY' THEN 'silent' ELSE 'd' END || c_custkey AS device_id, c_mktsegment AS location, c_name AS model FROM customer)"


@query("enrich_metadata", f"""SELECT event_id, 'd' || user_id AS device_id, coalesce(location, 'unknown') AS location, coalesce(model, 'default') AS model
FROM events e LEFT JOIN {_META} m ON m.device_id = 'd' || e.user_id""")
def _(t):
    rows = t("events").select("event_id", F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("device_id"))
    return events.enrich_metadata(rows, _metadata(t))


_HISTORY = """SELECT device_id, string_agg(event_id, ',' ORDER BY n DESC) AS history FROM (SELECT 'd' || user_id AS device_id, 'e' || event_id AS event_id,
row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= {} GROUP BY device_id"""


def _device_events(df):
    return df.select(F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("device_id"), F.col("ts").cast("timestamp").alias("ts"),
                     F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("event_id"), F.col("event_id").alias("no"))


@query("bounded_history", _HISTORY.format(100))
def _(t):
    rows = _device_events(t("events")).withColumnRenamed("event_id", "eid")
    return events.bounded_history(rows, "device_id", ["ts", "no"], "eid", 100).withColumn("history", F.array_join("history", ","))


@query("stream_etl", f"""SELECT 'e' || event_id AS event_id, CASE WHEN event_type <> 'signup' THEN 'd' || user_id END AS device_id,
coalesce(location, 'unknown') AS location, coalesce(model, 'default') AS model FROM events e
LEFT JOIN {_META} m ON m.device_id = 'd' || e.user_id AND event_type <> 'signup' WHERE event_type IN ('signup', 'click', 'purchase')""")
def _(t):
    root = _folder(t)
    job = jobs.stream_etl(_messages(_stream(t)).select("value"), _metadata(t), f"{root}/good", f"{root}/bad", f"{root}/offsets",
                          AS_OF, once=True)
    job.awaitTermination()
    return jobs.read_written(t.spark, f"{root}/good").select("event_id", "device_id", "location", "model")


@query("stream_rejects", """SELECT 'raw_dlq' AS topic, 'Missing required fields' AS error, count(*) AS n FROM events
WHERE event_type IN ('view', 'error') GROUP BY ALL""")
def _(t):
    root = _folder(t)
    job = jobs.stream_etl(_messages(_stream(t)).select("value"), _metadata(t), f"{root}/good", f"{root}/bad", f"{root}/offsets",
                          AS_OF, once=True)
    job.awaitTermination()
    rows = jobs.read_written(t.spark, f"{root}/bad")
    return rows.groupBy("topic", F.get_json_object("value", "$.error").alias("error")).agg(F.count(F.lit(1)).alias("n"))


@query("stream_history", _HISTORY.format(1000))
def _(t):
    """Three parts in order of time, one for each batch, events without a time in the first; the newest history of a device counts,
    of as many ids as the job keeps."""
    root, rows = _folder(t), _device_events(t("events"))
    first, *others = by_time(rows.filter("ts IS NOT NULL"), "ts")

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    in_turn([first.unionByName(rows.filter("ts IS NULL")), *others], f"{root}/in", lambda part: jobs.start(
        jobs.stream_history(part, tie="no"), f"{root}/offsets", keep, mode="update", once=True))
    rows = t.spark.read.option("basePath", f"{root}/out").parquet(f"{root}/out/batch=*")
    return rows.groupBy("device_id").agg(F.array_join(F.max_by("history", "batch"), ",").alias("history"))


@query("stream_sla", """SELECT service, epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS start_us,
round(count(*) FILTER (success) / count(*) * 100, 6) AS availability, round(count(*) / 3600.0, 9) AS throughput,
round(list_sort(list(latency))[CAST(ceil(0.99 * count(*)) AS BIGINT)], 6) AS latency_p99
FROM v_requests GROUP BY service, time_bucket(INTERVAL '1 hour', ts)
HAVING time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' <= (SELECT max(ts) FROM v_requests)""")
def _(t):
    """Windows are final and leave the state once the watermark has passed them; the last one is still open."""
    root = _folder(t)
    rows = _stream(t).select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("svc"), (F.col("user_id") % 5).cast("string")).alias("service"),
                             (F.col("event_type") != "error").alias("success"), (F.col("value") / 100).alias("latency"))
    out = jobs.stream_sla(jobs.watermarked(rows), "1 hour")

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    jobs.start(out, f"{root}/offsets", keep, mode="append", once=True).awaitTermination()
    return jobs.read_written(t.spark, f"{root}/out").select(
        "service", F.unix_micros("slice_start").alias("start_us"), F.round("availability", 6).alias("availability"),
        F.round("throughput", 9).alias("throughput"), F.round("latency_p99", 6).alias("latency_p99"))
