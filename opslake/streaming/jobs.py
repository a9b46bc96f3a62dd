"""Streaming versions of the event, log and SLA operators.

Every job takes a streaming DataFrame and a checkpoint folder. Sinks inside ``foreachBatch`` write
one folder per batch id, so a batch that is repeated after a failure replaces its own output.
"""

from __future__ import annotations

import datetime as dt
import heapq
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from opslake.operators import logs
from opslake.operators.events import DEFAULT_METADATA, enrich_metadata, has_fields, parse_device_event
from opslake.operators.rules import policy_match
from opslake.operators.sla import availability_expr
from opslake.operators.tables import versioned_writes
from opslake.session import staged
from opslake.sources.keyed import KeyedTable
from opslake.sources.sinks import dlq_envelope, failover_write

# State lies in RocksDB, with changes alone written at each commit; without the fixed size of its files, which small states would fill.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def watermarked(df: DataFrame, ts: str = "ts", delay: str = "0 seconds") -> DataFrame:
    """Event time with the given lateness; no delay means timestamps that never go back."""
    return df.withWatermark(ts, delay)


def start(df: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None] | None = None, path: str | None = None,
          mode: str = "append", every: str = "5 seconds", once: bool = False) -> StreamingQuery:
    """Start a query that commits every five seconds, or reads what is there and ends (``once``)."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    writer = writer.foreachBatch(batch) if batch is not None else writer.format("parquet").option("path", path)
    # A query keeps the settings that it was started with.
    conf = df.sparkSession.conf
    old = {k: conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        conf.set(k, v)
    try:
        return writer.start()
    finally:
        for k, v in old.items():
            conf.unset(k) if v is None else conf.set(k, v)


def _batch_folder(path: str, batch_id: int) -> str:
    return f"{path}/batch={batch_id}"


def stream_etl(messages: DataFrame, metadata: DataFrame, good: str, bad: str, checkpoint: str, as_of: dt.datetime | None = None,
               topic: str = "raw", **options) -> StreamingQuery:
    """JSON messages in column ``value``: check, parse, enrich and write; rejects go to ``bad`` as envelopes.

    A record that cannot be handled never stops the stream, and offsets are committed only after both
    writes of a batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        tagged = batch.withColumn("_ok", has_fields(F.col("value")))
        tagged.persist()
        try:
            events = parse_device_event(tagged.filter("_ok").drop("_ok"))
            enrich_metadata(events, metadata).write.mode("overwrite").parquet(_batch_folder(good, batch_id))
            at = F.unix_micros(F.lit(as_of) if as_of else F.current_timestamp()) / 1e6
            rejects = dlq_envelope(tagged.filter("NOT _ok"), "value", F.lit("Missing required fields"), F.lit(topic), at)
            rejects.write.mode("overwrite").parquet(_batch_folder(bad, batch_id))
        finally:
            tagged.unpersist()

    return start(messages, checkpoint, write, **options)


class _History(StatefulProcessor):
    """The last ids of a device and its newest metadata, as one value that is read and written once for a batch. A batch's rows pass
    one by one through a heap of the newest."""

    def __init__(self, key: str, last: int, event_id: str, order: str, named: bool, tie: str | None = None):
        self.key, self.last, self.event_id, self.order, self.named, self.tie = key, last, event_id, order, named, tie or event_id

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("history", "seen array<string>, location string, model string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest: list[tuple] = []  # (time, tie, number, id), the oldest on top; rows without a time come first
        at = None
        for n, r in enumerate(rows):
            tie = r[self.tie]
            entry = (r[self.order] if r[self.order] is not None else -(1 << 63), (tie is not None, tie), n, r[self.event_id])
            if self.named and (at is None or entry[:2] >= at[0]):
                at = (entry[:2], (r["location"], r["model"]))
            if len(newest) < self.last:
                heapq.heappush(newest, entry)
            else:
                heapq.heappushpop(newest, entry)
        before = self._state.get() or ([], DEFAULT_METADATA["location"], DEFAULT_METADATA["model"])
        metadata = at[1] if at else before[1:]
        seen = (list(before[0]) + [e[3] for e in sorted(newest, key=lambda e: e[:3])])[-self.last:]
        self._state.update((seen, *metadata))
        yield Row(**{self.key: key[0]}, history=seen, location=metadata[0], model=metadata[1])

    def close(self) -> None:
        pass


def stream_history(events: DataFrame, last: int = 1000, key: str = "device_id", event_id: str = "event_id",
                   order: str = "ts", tie: str | None = None) -> DataFrame:
    """Per device and batch: the last event ids seen so far and the device's cached metadata. Of one time, the rows come by
    ``tie``, or else by their id."""
    named = "location" in events.columns
    rows = events.select(key, event_id, F.unix_micros(order).alias("_at"), *([tie] if tie else []), *(["location", "model"] if named else []))
    return rows.groupBy(key).transformWithState(
        _History(key, last, event_id, "_at", named, tie), f"{key} string, history array<string>, location string, model string", "Update", "None")


class _Blocks(StatefulProcessor):
    """The start of a source's block, until a timer ends it. Requests of a batch are held as a few numbers each, in time order."""

    def __init__(self, length: int, source: str, tie: str):
        self.length, self.source, self.tie = length, source, tie

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._since = handle.getValueState("since", "since long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        times, ties, kinds, names = array("q"), array("q"), array("l"), {}
        for r in rows:
            times.append(r["_at"])
            ties.append(r[self.tie])
            kinds.append(names.setdefault((r["rule_id"], r["action"]), len(names)))
        known, state = list(names), self._since.get()
        since = state[0] if state else None
        before = since
        for i in np.lexsort((np.frombuffer(ties, dtype=np.int64), np.frombuffer(times, dtype=np.int64))).tolist():
            rule, action = known[kinds[i]]
            if since is not None and times[i] - since < self.length:
                decision = ("BLOCK", "Known threat", None)
            elif action == "DENY" and rule is not None:
                since, decision = times[i], ("BLOCK", "Policy", rule)
            else:
                decision = (action, None, rule)
            yield Row(**{self.source: key[0], self.tie: ties[i]}, decision=decision[0], reason=decision[1], rule_id=decision[2])
        if since is not None and since != before:
            self._since.update((since,))
            self._handle.registerTimer(max((since + self.length) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self._since.get()
        if state and (state[0] + self.length) // 1000 < expiredTimerInfo.getExpiryTimeInMs():
            self._since.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_blocks(access: DataFrame, policies: list[dict], block_s: int = 3600, source: str = "source_ip", ts: str = "ts",
                  tie: str = "event_id") -> DataFrame:
    """Access decisions with blocks kept as state that ends with the block.

    Needs a watermark on ``ts`` with a delay no shorter than the disorder of the requests, since rows
    behind the watermark are dropped.
    """
    judged = policy_match(access, policies, ts).select(source, ts, F.unix_micros(ts).alias("_at"), tie, "rule_id", "action")
    return judged.groupBy(source).transformWithState(
        _Blocks(block_s * 1_000_000, source, tie), f"{source} string, {tie} long, decision string, reason string, rule_id string", "Append", "EventTime")


class _Silence(StatefulProcessor):
    """When a client was last seen; one timer per client, set anew if it fires too soon."""

    def __init__(self, ttl: int, client: str):
        self.ttl, self.client = ttl, client

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", "last long")

    def _wait(self, last: int, timerValues) -> None:
        self._handle.registerTimer(max((last + self.ttl) // 1000, timerValues.getCurrentWatermarkInMs() + 1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest = max((r["_at"] for r in rows if r["_at"] is not None), default=None)
        state = self._last.get()
        if newest is not None and (state is None or newest > state[0]):
            self._last.update((newest,))
        if newest is not None and state is None:
            self._wait(newest, timerValues)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self._last.get()
        if state is None:
            return
        if (state[0] + self.ttl) // 1000 > expiredTimerInfo.getExpiryTimeInMs():
            self._wait(state[0], timerValues)
            return
        self._last.clear()
        yield Row(**{self.client: key[0]}, last=state[0], expired=True)

    def close(self) -> None:
        pass


def stream_heartbeats(beats: DataFrame, ttl_s: int = 30, client: str = "agent_id", ts: str = "ts") -> DataFrame:
    """One row (client, last_seen, expired) when a client has been silent for longer than its time to live.

    Needs a watermark on ``ts``; silence is measured in event time.
    """
    rows = beats.select(client, ts, F.unix_micros(ts).alias("_at"))
    silent = rows.groupBy(client).transformWithState(
        _Silence(ttl_s * 1_000_000, client), f"{client} string, last long, expired boolean", "Append", "EventTime")
    return silent.select(client, F.timestamp_micros("last").alias("last_seen"), "expired")


def stream_sla(requests: DataFrame, window: str = "5 minutes", slide: str | None = None, keys: Sequence[str] = ("service",),
               accuracy: int = 10_000) -> DataFrame:
    """Availability, p99 latency and throughput per window. The quantile is a sketch of bounded size, with
    a rank error of at most 1 / ``accuracy``; the batch report is exact."""
    slot = F.window("ts", window, slide) if slide else F.window("ts", window)
    seconds = F.unix_seconds("slot.end") - F.unix_seconds("slot.start")
    grouped = requests.groupBy(slot.alias("slot"), *keys).agg(
        availability_expr(F.col("success")).alias("availability"), F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("latency", 0.99, accuracy).alias("latency_p99"))
    return grouped.select(*keys, F.col("slot.start").alias("slice_start"), F.col("slot.end").alias("slice_end"),
                          "availability", "latency_p99", (F.col("_n") / seconds).alias("throughput"))


def stream_log_anomalies(lines: DataFrame, out: str, checkpoint: str, as_of: Callable[[], dt.datetime], window_s: int = 300,
                         error_rate: float = 0.05, frequency: int = 1000, buckets: int = 32, **options) -> StreamingQuery:
    """Evaluate error rate and pattern counts of all logs so far after every batch and write the anomalies found.

    The state is two tables of counts that change by key: by pattern, and by time of an error inside the window, with the number of all
    lines under time -1. A batch reads and writes the buckets of its own patterns and times only, starting from the batch
    before, so a repeated batch starts from the same state and results do not depend on how logs fall into batches. Errors
    before the window go when their bucket is written anew. A frequent pattern is reported by the batches that it occurs in.
    """
    spark = lines.sparkSession

    def added(table: KeyedTable, fresh: DataFrame, batch_id: int) -> DataFrame:
        """New counts of the keys of this batch."""
        if not batch_id:
            table.create(fresh.where("false"))
        touched = [r[0] for r in fresh.select(table.bucket()).distinct().collect()]
        old = table.read(batch_id - 1, touched).withColumnRenamed("n", "_old")
        changes = staged(fresh.join(old, table.key, "left").select(table.key, (F.col("n") + F.coalesce("_old", F.lit(0))).alias("n")))
        table.write(changes, batch_id)
        return changes

    def detect(batch: DataFrame, batch_id: int) -> None:
        now = as_of()
        first = int((now - dt.timedelta(seconds=window_s)).replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)
        parsed = staged(logs.log_parse(batch).select("ts", "level", logs.log_signature(F.col("message")).alias("pattern")))
        patterns = KeyedTable(spark, f"{out}-state/patterns", "pattern", buckets)
        times = KeyedTable(spark, f"{out}-state/times", "at", buckets, expired=(F.col("at") >= 0) & (F.col("at") < first))
        counted = added(patterns, parsed.where("pattern IS NOT NULL").groupBy("pattern").agg(F.count(F.lit(1)).alias("n")), batch_id)
        errors = parsed.where("level = 'ERROR' AND ts IS NOT NULL").select(F.unix_micros("ts").alias("at")).where("at >= 0")
        added(times, errors.unionByName(parsed.select(F.lit(-1).cast("long").alias("at"))).groupBy("at").agg(F.count(F.lit(1)).alias("n")), batch_id)
        inside = F.sum(F.when(F.col("at").between(first, first + window_s * 1_000_000) & (F.col("at") >= 0), F.col("n")))
        rate = F.coalesce(inside, F.lit(0)) / F.sum(F.when(F.col("at") == -1, F.col("n")))
        often = counted.filter(F.col("n") > frequency).select(
            F.lit("frequency").alias("type"), "pattern", F.col("n").cast("double").alias("value"))
        high = times.read(batch_id).agg(rate.alias("value")).filter(F.col("value") > error_rate).select(
            F.lit("error_rate").alias("type"), F.lit(None).cast("string").alias("pattern"), "value")
        high.unionByName(often).write.mode("overwrite").parquet(_batch_folder(out, batch_id))

    return start(lines, checkpoint, detect, **options)


def stream_deliver(events: DataFrame, sinks: Sequence[tuple[str, Callable[[DataFrame, int], None]]], failed: Callable[[DataFrame, int], None],
                   checkpoint: str, **options) -> StreamingQuery:
    """Deliver batches through the first sink that works. Batch size is set by the source's
    ``maxFilesPerTrigger`` or ``maxOffsetsPerTrigger`` and the five second trigger. Sinks get the batch and its number,
    so that a repeated batch replaces what it wrote before."""

    def deliver(batch: DataFrame, batch_id: int) -> None:
        numbered = [(name, lambda rows, write=write: write(rows, batch_id)) for name, write in sinks]
        failover_write(batch, numbered, lambda rows: failed(rows, batch_id))

    return start(events, checkpoint, deliver, **options)


def stream_upsert(incoming: DataFrame, table: KeyedTable, conflicts: str, checkpoint: str, version: str = "version",
                  order: str = "seq", **options) -> StreamingQuery:
    """Versioned upsert of every batch. Batch n reads only the buckets of its keys as of batch n - 1 and writes the rows that change,
    so a repeated batch starts from the same state and replaces what it wrote."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            touched = [r[0] for r in batch.select(table.bucket()).distinct().collect()]
            writes, rejected = versioned_writes(table.read(batch_id - 1, touched), batch, table.key, version, order)
            rejected.write.mode("overwrite").parquet(_batch_folder(conflicts, batch_id))
            table.write(writes, batch_id)
        finally:
            batch.unpersist()

    return start(incoming, checkpoint, merge, **options)


def dedupe_stream(events: DataFrame, key: str = "event_id", ts: str = "event_time", delay: str = "1 hour") -> DataFrame:
    """First row of every id; ids are remembered only as long as the watermark allows."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def read_written(spark: SparkSession, path: str) -> DataFrame:
    """All batches a ``foreachBatch`` sink has written."""
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").drop("batch")
