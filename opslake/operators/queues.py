"""Dead letters and task queues kept in tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslake.operators.tables import upsert


def _ago(as_of: dt.datetime, seconds: float) -> Column:
    return F.lit(as_of - dt.timedelta(seconds=seconds))


def _plus_seconds(base: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(base) + (seconds * 1_000_000).cast("long"))


def retriable(df: DataFrame, as_of: dt.datetime, max_retries: int = 5, backoff: float = 1.8, alert_threshold: int = 3,
              per_message: bool = False) -> DataFrame:
    """Dead letters that may be tried again.

    The waiting time is ``backoff ** alert_threshold`` seconds for all messages, or with
    ``per_message`` ``backoff ** retries`` of each one.
    """
    if per_message:
        waited = _plus_seconds(F.col("last_attempt"), F.pow(F.lit(backoff), F.col("retries"))) < F.lit(as_of)
    else:
        waited = F.col("last_attempt") < _ago(as_of, backoff ** alert_threshold)
    return df.filter(~F.col("permanent_failure") & (F.col("retries") < max_retries)
                     & (F.col("last_attempt").isNull() | waited))


def retriable_messages(df: DataFrame, as_of: dt.datetime, limit: int = 100, **rules) -> DataFrame:
    """The oldest messages to try again, one batch."""
    return retriable(df, as_of, **rules).orderBy("ts", "message_id").limit(limit)


def dlq_age(df: DataFrame, as_of: dt.datetime, **rules) -> DataFrame:
    """Seconds since the oldest retriable message; null when there is none."""
    return retriable(df, as_of, **rules).agg(F.min("ts").alias("oldest")).select(
        ((F.unix_micros(F.lit(as_of)) - F.unix_micros("oldest")) / 1e6).alias("age_s"))


def dlq_upsert(current: DataFrame, incoming: DataFrame, order: str | None = None) -> DataFrame:
    """A known message only changes its retries, last attempt and permanent failure."""
    return upsert(current, incoming, "message_id", ["retries", "last_attempt", "permanent_failure"], order)


def dlq_retry_pass(messages: DataFrame, outcomes: DataFrame, as_of: dt.datetime, max_retries: int = 5,
                   alert_threshold: int = 3) -> tuple[DataFrame, DataFrame]:
    """Apply delivery outcomes (message_id, delivered). Returns (remaining messages, alerts).

    Delivered messages go, failed ones count one retry more and become permanent at ``max_retries``;
    messages without an outcome stay as they are.
    """
    judged = messages.join(outcomes.select("message_id", "delivered"), "message_id", "left")
    failed = F.coalesce(~F.col("delivered"), F.lit(False))
    remaining = (
        judged.filter(~F.coalesce("delivered", F.lit(False)))
        .withColumn("_failed", failed)
        .withColumn("retries", F.when(failed, F.col("retries") + 1).otherwise(F.col("retries")))
        .withColumn("last_attempt", F.when(failed, F.lit(as_of)).otherwise(F.col("last_attempt")))
        .withColumn("permanent_failure", F.col("permanent_failure") | (failed & (F.col("retries") >= max_retries)))
    )
    alerts = message_alerts(remaining.filter(F.col("_failed") & (F.col("retries") >= alert_threshold)), max_retries)
    return remaining.drop("_failed", "delivered"), alerts


def message_alerts(messages: DataFrame, max_retries: int = 5) -> DataFrame:
    """Alert text and metadata JSON per message."""
    final = F.col("retries") >= max_retries
    text = F.concat(F.when(final, "PERMANENT FAILURE").otherwise("WARNING"), F.lit(": Message "), F.col("message_id"),
                    F.lit(" failed "), F.col("retries").cast("string"), F.lit(" times. Last error: "),
                    F.col("failure_reason"))
    meta = F.struct("message_id", F.col("original_topic").alias("topic"), "retries",
                    F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"))
    return messages.select("message_id", final.alias("is_final"), text.alias("text"), F.to_json(meta).alias("metadata"))


def dlq_cleanup(df: DataFrame, as_of: dt.datetime, days: int = 30) -> DataFrame:
    return df.filter(F.col("ts") >= F.lit(as_of - dt.timedelta(days=days)))


def next_tasks(df: DataFrame, k: int, as_of: dt.datetime | None = None) -> DataFrame:
    """The next ``k`` pending tasks by priority, retries, last attempt and id.

    With ``as_of`` tasks whose next attempt is still ahead are left out.
    """
    pending = df.filter(F.col("status") == "pending")
    if as_of is not None:
        pending = pending.filter(F.col("next_attempt").isNull() | (F.col("next_attempt") <= F.lit(as_of)))
    return pending.orderBy("priority", "retries", F.col("last_attempt").asc_nulls_first(), "task_id").limit(k)


def start_tasks(df: DataFrame, ids: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Mark the given tasks as processing."""
    return _update(df, ids, {"status": F.lit("processing"), "updated_at": F.lit(as_of), "last_attempt": F.lit(as_of)})


def complete_tasks(df: DataFrame, ids: DataFrame, as_of: dt.datetime) -> DataFrame:
    return _update(df, ids, {"status": F.lit("completed"), "updated_at": F.lit(as_of)})


def _update(df: DataFrame, ids: DataFrame, values: dict[str, Column]) -> DataFrame:
    hit = df.join(ids.select("task_id").distinct().withColumn("_hit", F.lit(True)), "task_id", "left")
    return hit.withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in values.items()}).drop("_hit")


def task_fail_pass(failed: DataFrame, as_of: dt.datetime, max_retries: int = 3, backoff: float = 1.5) -> DataFrame:
    """New state of failed tasks: failed for good, or pending again after ``backoff ** retries`` seconds."""
    done = F.col("retries") >= max_retries
    return failed.withColumns({
        "status": F.when(done, "failed").otherwise("pending"),
        "next_attempt": F.when(done, F.col("next_attempt")).otherwise(
            _plus_seconds(F.lit(as_of), F.pow(F.lit(backoff), F.col("retries")))),
        "retries": F.when(done, F.col("retries")).otherwise(F.col("retries") + 1),
        "updated_at": F.lit(as_of),
    })


def task_timeouts(df: DataFrame, as_of: dt.datetime, timeout_s: float = 300) -> DataFrame:
    return df.filter((F.col("status") == "processing") & (F.col("updated_at") < _ago(as_of, timeout_s)))


def dynamic_priority(as_of: dt.datetime, enabled: bool = True) -> Column:
    """Priority plus half a point per hour of age (cut to whole points) and two per retry."""
    if not enabled:
        return F.col("priority")
    hours = (F.unix_micros(F.lit(as_of)) - F.unix_micros("created_at")) / 3.6e9
    return F.col("priority") + (hours * 0.5).cast("int") + F.col("retries") * 2


def deadline_misses(df: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Open tasks past their deadline."""
    return df.filter(F.col("status").isin("pending", "processing")).agg(
        F.count_if(F.col("deadline") < F.lit(as_of)).alias("misses"), F.count(F.lit(1)).alias("open"))


def completion_score(df: DataFrame, as_of: dt.datetime, priority_weight: float = 0.3, late_weight: float = -1.0) -> DataFrame:
    """Sum over completed tasks of the weighted priority, with a penalty for late ones."""
    late = F.lit(as_of) > F.col("deadline")
    return df.filter(F.col("status") == "completed").agg(
        F.sum(F.col("priority") * priority_weight + F.when(late, late_weight).otherwise(0.0)).alias("score"))
