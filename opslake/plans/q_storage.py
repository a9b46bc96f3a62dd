"""Readers, writers and jobs run against the shared folder, read back for checking."""

import datetime as dt
import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from opslake.operators import features
from opslake.plans import etl_job
from opslake.plans.catalog import query
from opslake.plans.q_etl import _DEDUPED
from opslake.plans.q_events import by_time, in_turn
from opslake.plans.q_security import _ACTS, _CASE, _DENIED, _RULES, POLICIES
from opslake.plans.q_tables import MERGED
from opslake.session import shared_folder
from opslake.sources import readers, sinks, snapshots
from opslake.sources.keyed import KeyedTable
from opslake.streaming import jobs

AS_OF = dt.datetime(2024, 1, 31)
DAY = "2024-01-05"


def _folder(t):
    return f"{shared_folder(t.spark)}/run-{uuid.uuid4().hex}"


@query("read_auto", "SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_acctbal FROM customer")
def _(t):
    folder = _folder(t)
    t("customer").select("c_custkey", "c_nationkey", "c_acctbal").write.option("header", "true").csv(f"{folder}/customer.csv")
    return readers.read_auto(t.spark, f"{folder}/customer.csv", {"c_nationkey": "string", "c_custkey": "bigint"})


@query("read_logs", "SELECT raw, count(*) AS n FROM v_logs GROUP BY raw")
def _(t):
    folder = _folder(t)
    t("v_logs").select("raw").write.text(folder)
    return readers.read_logs(t.spark, folder).groupBy("raw").agg(F.count(F.lit(1)).alias("n"))


@query("write_partitioned", f"""WITH {_DEDUPED} SELECT event_id, source_system, CASE WHEN value > 1000 THEN 'HIGH' ELSE 'NORMAL' END AS value_category,
strftime(TIMESTAMP '2024-01-05', '%Y-%m-%d') AS processing_date FROM clean""")
def _(t):
    folder = _folder(t)
    t("v_raw_events").write.parquet(f"{folder}/raw")
    config = etl_job.EtlConfig(f"{folder}/raw", f"{folder}/out", DAY, f"{folder}/metrics", "run-1")
    etl_job.run_etl(t.spark, config, AS_OF)
    out = t.spark.read.parquet(f"{folder}/out")
    return out.select("event_id", "source_system", "value_category", F.date_format("processing_date", "yyyy-MM-dd").alias("processing_date"))


@query("daily_run", f"""WITH {_DEDUPED} SELECT count(*) AS row_count, count(*) FILTER (user_id = 'ANONYMOUS') AS null_user_ids,
count(*) FILTER (value < 0) AS negative_values, true AS compliant FROM clean""")
def _(t):
    folder = _folder(t)
    t("v_raw_events").write.parquet(f"{folder}/raw")
    config = etl_job.EtlConfig(f"{folder}/raw", f"{folder}/out", DAY, f"{folder}/metrics", "run-1")
    out = etl_job.daily_run(t.spark, config, AS_OF, validate=lambda s: not s.read.parquet(config.input_paths).isEmpty(),
                            compliance=lambda s: s.read.parquet(config.output_path).agg((F.count_if(
                                F.length("hashed_user_id") != 64) == 0).alias("compliant")))
    return out["compliance"].select("compliant", *[F.lit(v).cast("long").alias(k) for k, v in out["metrics"].items()])


@query("failover_sink", "SELECT event_id, event_type FROM events")
def _(t):
    folder = _folder(t)

    def broken(df):
        df.write.format("no-such-format").save()

    rows = t("events").select("event_id", "event_type")
    sinks.failover_write(rows, [("first", broken), ("second", lambda df: df.write.parquet(f"{folder}/second"))],
                         lambda df: df.write.parquet(f"{folder}/failed"))
    return t.spark.read.parquet(f"{folder}/second")


@query("write_splits", """WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment
  ORDER BY md5(CAST(c_custkey AS VARCHAR)), c_custkey) AS n, count(*) OVER (PARTITION BY c_mktsegment) AS size FROM customer)
SELECT c_custkey, n <= round(size * 0.2) AS in_test FROM r""")
def _(t):
    folder = _folder(t)
    train, test = features.stratified_split(t("customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ["c_custkey"])
    sinks.write_splits(train, test, folder)
    parts = [t.spark.read.parquet(f"{folder}/{n}.parquet").select("c_custkey", F.lit(n == "test").alias("in_test")) for n in ("train", "test")]
    return parts[0].unionByName(parts[1])


@query("snapshot_verify", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def _(t):
    folder = _folder(t)
    snapshots.snapshot_write(t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), folder, "v1.0.0", AS_OF)
    return snapshots.snapshot_read(t.spark, folder, "v1.0.0")


@query("snapshot_diff", """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'removed' ELSE 'changed' END AS change FROM orders WHERE o_orderkey % 7 = 0 OR o_orderstatus = 'P'
UNION ALL SELECT -o_orderkey, 'added' FROM orders WHERE o_orderpriority = '1-URGENT'""")
def _(t):
    folder = _folder(t)
    rows = t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    later = rows.where("o_orderkey % 7 <> 0").withColumn("o_totalprice", F.col("o_totalprice") + (F.col("o_orderstatus") == "P").cast("int")).unionByName(
        rows.where("o_orderpriority = '1-URGENT'").withColumn("o_orderkey", -F.col("o_orderkey")))
    for version, df in (("v1", rows), ("v2", later)):
        snapshots.snapshot_write(df, folder, version, AS_OF, key=["o_orderkey"])
    return snapshots.snapshot_diff(t.spark, folder, "v1", "v2", ["o_orderkey"])


@query("partitioned_collection", "SELECT CAST(vec_id AS VARCHAR) AS id, label FROM embeddings WHERE label IN (2, 4)")
def _(t):
    folder = _folder(t)
    rows = t("embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding", "label")
    snapshots.write_collection(rows, folder, "vectors", "label")
    return snapshots.read_collection(t.spark, folder, "vectors", "label", [2, 4]).select("id", "label")


@query("collection_backup", "SELECT CAST(vec_id AS VARCHAR) AS id, len(embedding) AS dim FROM embeddings")
def _(t):
    folder = _folder(t)
    rows = t("embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding", "label")
    snapshots.write_collection(rows, folder, "vectors", "label")
    snapshots.collection_backup(t.spark, folder, "vectors", f"{folder}/backup", AS_OF)
    name = snapshots.collection_restore(t.spark, f"{folder}/backup", "vectors", folder, "restored")
    return snapshots.read_collection(t.spark, folder, name).select("id", F.size("embedding").cast("long").alias("dim"))


def _job(out, folder, mode="append"):
    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    return jobs.start(out, f"{folder}/offsets", keep, mode=mode, once=True)


def _run(t, out, mode="append"):
    folder = _folder(t)
    _job(out, folder, mode).awaitTermination()
    return jobs.read_written(t.spark, f"{folder}/out")


def _streamed(t, view):
    """A view written to files and read back as a stream."""
    folder, rows = _folder(t), t(view)
    rows.write.parquet(f"{folder}/in")
    return t.spark.readStream.schema(rows.schema).parquet(f"{folder}/in")


@query("stream_upsert", MERGED)
def _(t):
    folder, incoming = _folder(t), t("v_state_incoming")
    table = KeyedTable(t.spark, f"{folder}/table", "agent_id", buckets=8, most_changes=2)
    table.create(t("v_state_current"))
    # All writes of a key lie in one of three parts, so that the batches together decide as one would.
    parts = [incoming.filter(F.pmod(F.hash("agent_id"), F.lit(3)) == k) for k in range(3)]
    in_turn(parts, f"{folder}/in", lambda rows: jobs.stream_upsert(rows, table, f"{folder}/conflicts", f"{folder}/offsets", once=True))
    table.remove_dead()
    return table.read()


@query("stream_blocks", f"""WITH RECURSIVE j AS (SELECT *, epoch_us(ts) AS t_us, {_CASE.format(*_RULES)} AS rule,
    {_CASE.format(*_ACTS)} AS act, row_number() OVER (PARTITION BY source_ip ORDER BY ts, event_id) AS n FROM v_access),
f AS (SELECT source_ip, n, event_id, {_DENIED} AS acted, false AS blocked, CASE WHEN {_DENIED} THEN t_us END AS since FROM j WHERE n = 1
  UNION ALL SELECT j.source_ip, j.n, j.event_id, coalesce({_DENIED}, false) AND coalesce(t_us - since >= 3600000000, true),
    coalesce(t_us - since < 3600000000, false),
    CASE WHEN coalesce({_DENIED}, false) AND coalesce(t_us - since >= 3600000000, true) THEN t_us ELSE since END
  FROM f JOIN j ON j.source_ip = f.source_ip AND j.n = f.n + 1)
SELECT f.event_id, CASE WHEN acted OR blocked THEN 'BLOCK' ELSE act END AS decision,
  CASE WHEN blocked THEN 'Known threat' WHEN acted THEN 'Policy' END AS reason FROM f JOIN j ON j.event_id = f.event_id""")
def _(t):
    folder = _folder(t)
    in_turn(by_time(t("v_access"), "ts"), f"{folder}/in",
            lambda access: _job(jobs.stream_blocks(jobs.watermarked(access, "ts"), POLICIES), folder))
    return jobs.read_written(t.spark, f"{folder}/out").select("event_id", "decision", "reason")


@query("stream_log_anomalies", r"""WITH e AS (SELECT count(*) FILTER (level = 'ERROR' AND ts >= TIMESTAMP '2024-01-24' AND ts <= TIMESTAMP '2024-01-31') / count(*) AS rate FROM v_logs)
SELECT 'error_rate' AS type, NULL AS pattern, round(rate, 9) AS value FROM e WHERE rate > 0.001
UNION ALL SELECT 'frequency', regexp_replace(message, '[0-9]+', '<NUM>', 'g'), count(*) FROM v_logs GROUP BY 2 HAVING count(*) > 50""")
def _(t):
    folder = _folder(t)
    lines = _streamed(t, "v_logs").select("event_id", "ts", "raw")
    jobs.stream_log_anomalies(lines, f"{folder}/out", f"{folder}/offsets", lambda: AS_OF, 7 * 86400, 0.001, 50, once=True).awaitTermination()
    return jobs.read_written(t.spark, f"{folder}/out").select("type", "pattern", F.round("value", 9).alias("value"))


@query("stream_deliver", "SELECT event_id, service FROM v_requests")
def _(t):
    folder = _folder(t)

    def broken(df, batch_id):
        df.write.format("no-such-format").save()

    job = jobs.stream_deliver(_streamed(t, "v_requests").select("event_id", "service"),
                              [("first", broken), ("second", lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/second/batch={n}"))],
                              lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/failed/batch={n}"), f"{folder}/offsets", once=True)
    job.awaitTermination()
    return jobs.read_written(t.spark, f"{folder}/second")


@query("stream_dedupe", "SELECT DISTINCT event_id FROM v_raw_events WHERE event_time IS NOT NULL")
def _(t):
    rows = _streamed(t, "v_raw_events").filter("event_time IS NOT NULL").select("event_id", "event_time")
    return _run(t, jobs.dedupe_stream(rows, delay="2 days")).select("event_id")


@query("stream_heartbeats", """SELECT agent_id, true AS expired FROM v_lifecycle GROUP BY agent_id
HAVING epoch_ms(max(ts)) + 3600000 < (SELECT epoch_ms(max(ts)) FROM v_lifecycle)""")
def _(t):
    out = jobs.stream_heartbeats(jobs.watermarked(_streamed(t, "v_lifecycle"), "ts"), 3600)
    return _run(t, out).select("agent_id", "expired").distinct()


@query("stream_microbatch", "SELECT CAST(count(*) AS BIGINT) AS rows, true AS several_batches FROM events")
def _(t):
    folder = _folder(t)
    t("events").select("event_id", "event_type").repartition(4).write.parquet(f"{folder}/in")
    source = t.spark.readStream.schema("event_id long, event_type string").option("maxFilesPerTrigger", "1").parquet(f"{folder}/in")
    jobs.stream_deliver(source, [("files", lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"))],
                        lambda df, n: None, f"{folder}/offsets", once=True).awaitTermination()
    named = t.spark.read.parquet(f"{folder}/out").select(F.input_file_name().alias("file"))
    written = named.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("file").alias("_n"))
    return written.select("rows", (F.col("_n") > 1).alias("several_batches"))


@query("stream_watermark", """SELECT service, epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS start_us, count(*) AS n FROM v_requests
WHERE time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' <= (SELECT max(ts) FROM v_requests) GROUP BY ALL""")
def _(t):
    rows = jobs.watermarked(_streamed(t, "v_requests"), "ts")
    counts = rows.groupBy(F.window("ts", "1 hour").alias("w"), "service").agg(F.count(F.lit(1)).alias("n"))
    return _run(t, counts).select("service", F.unix_micros("w.start").alias("start_us"), "n")


@query("at_least_once_dlq", "SELECT event_id, event_type FROM events")
def _(t):
    """The first attempt fails after writing; the restart from the same checkpoint repeats the batch."""
    folder, attempts = _folder(t), []
    t("events").select("event_id", "event_type").write.parquet(f"{folder}/in")

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")
        attempts.append(batch_id)
        if len(attempts) == 1:
            raise OSError("lost after writing")

    def attempt():
        source = t.spark.readStream.schema("event_id long, event_type string").parquet(f"{folder}/in")
        jobs.start(source, f"{folder}/offsets", write, once=True).awaitTermination()

    try:
        attempt()
    except StreamingQueryException:
        attempt()
    return jobs.read_written(t.spark, f"{folder}/out")
