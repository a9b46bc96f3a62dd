"""Filter interaction audit: what five filters remove alone, together and in every order, by incremental retraction.

Documents arrive as files of a stream and are read in available-now micro-batches of a few files.

1. Masks. Filters A to D are column expressions on the whole text; every text has a name, the SHA-256 of its bytes.
2. Combine. Each task sums its rows of equal text to one row for each part and label, once for those with the least id that it
   has met and once for those above, which are copies whatever comes later. So a text that a third of all rows share
   reaches its state as a few rows for each task.
3. State by text. It holds the least id so far and what was counted for it. Rows above it count as failing E. When a smaller
   id arrives, what was counted for the old one is retracted (a negative count for its old mask, a positive one with E added)
   and the new one takes its place. Whatever order or grouping the files come in, the sums end the same.
4. Counters. Each batch adds its signed counts by (part, mask, labels) as a folder of its own, so that a repeated batch
   replaces what it wrote. The audit sums them: at most 32 masks for each part, times 120 orders of 5 steps.

State and offsets are kept in the shared folder; a query that is started again with the same ``run`` folder goes on where it ended.

Defined results: null text and null source count as ''; a row without an id is never smaller nor larger than another, so it
passes E and counts among no labels; rows that repeat an id and its text are each counted, and all pass E if the id is
the least; of several labels of one id a 1 in any counts; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from opslake.session import shared_folder, staged

FILTERS = "ABCDE"
COPY = "E"
HELD_TEXTS = 200_000
_COUNTED = "part string, fails string, good boolean, toxic boolean, n long"
_ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
          "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
          "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else 4 MB for each partition, however small
          "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
          "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256"}


def failing(text: Column) -> Column:
    """The letters of filters A to D that a text fails, joined."""
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    return F.concat(
        F.when(F.size(words) < 50, "A").otherwise(""),
        F.when(100 * F.size(F.array_distinct(words)) < 65 * F.size(words), "B").otherwise(""),
        F.when(100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 5 * F.length(text).cast("long"), "C").otherwise(""),
        F.when(text.rlike("[#$%&*|]"), "D").otherwise(""))


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (mark, fails, group, id, n): see step 2. Rows above the least id fail E, rows without an id keep none."""
    names = ["mark", "fails", "group", "id", "n"]
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    held: dict[str, list] = {}  # text: [its filters, least id, counts at it, counts above it, counts without an id]

    def flush() -> Iterator[pa.RecordBatch]:
        rows = [(mark, which, group, where, n)
                for mark, (fails, least, at, over, none) in held.items()
                for counts, where, which in ((at, least, fails), (over, None, fails + COPY), (none, None, fails))
                for group, n in counts.items()]
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names)

    for batch in batches:
        for mark, fails, group, row in zip(*[batch.column(c).to_pylist() for c in range(4)], strict=True):
            text = held.setdefault(mark, [fails, None, {}, {}, {}])
            if row is None:
                counts = text[4]
            elif text[1] is None or row < text[1]:
                for key, n in text[2].items():
                    text[3][key] = text[3].get(key, 0) + n
                text[1], text[2] = row, {}
                counts = text[2]
            else:
                counts = text[2] if row == text[1] else text[3]
            counts[group] = counts.get(group, 0) + 1
        if len(held) >= HELD_TEXTS:
            yield from flush()
    yield from flush()


class _LeastId(StatefulProcessor):
    """For each text its least id, and signed counts of the rows whose mask has become known or has changed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._least = handle.getValueState("least", "id long, held string")  # held: JSON of counts by group

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self._least.get()
        least, held = (before[0], json.loads(before[1])) if before else (None, {})
        own, kept, changed = "", {}, False  # kept: rows of this batch with the least id, not yet counted
        for _, fails, group, at, n in rows:
            if at is None:
                yield Row(fails=fails, group=group, n=n)
            elif least is not None and at > least:
                yield Row(fails=fails + COPY, group=group, n=n)
            else:
                if least is None or at < least:
                    for old, n_old in held.items():
                        yield Row(fails=fails, group=old, n=-n_old)
                    for counts in (held, kept):
                        for old, n_old in counts.items():
                            yield Row(fails=fails + COPY, group=old, n=n_old)
                    least, held, kept = at, {}, {}
                kept[group] = kept.get(group, 0) + n
                own, changed = fails, True
        for group, n in kept.items():
            yield Row(fails=own, group=group, n=n)
            held[group] = held.get(group, 0) + n
        if changed:
            self._least.update((least, json.dumps(held)))

    def close(self) -> None:
        pass


def count_stream(docs: DataFrame, labels: DataFrame, run: str, id_col: str = "doc_id", text_col: str = "text",
                 part_col: str = "source") -> None:
    """Read the stream ``docs`` to its present end and write signed counts to ``run``/counters."""
    spark = docs.sparkSession
    text, part = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(part_col), F.lit(""))
    known = F.col("id").isNotNull()
    rows = docs.select(F.sha2(text, 256).alias("mark"), failing(text).alias("fails"), part.alias("part"), F.col(id_col).cast("long").alias("id"))
    # Rows without an id take their hash, so that they are dealt out; no label has such a key.
    rows = rows.withColumn("known", known).withColumn("key", F.coalesce("id", F.xxhash64("mark")))
    marked = labels.where(F.col(id_col).isNotNull()).groupBy(F.lit(True).alias("known"), F.col(id_col).cast("long").alias("key")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = rows.join(staged(marked), ["known", "key"], "left").select(
        "mark", "fails", F.concat(*[F.when(F.col(c), "1").otherwise("0") for c in ("good", "toxic")], "part").alias("group"), "id")
    combined = rows.mapInArrow(_combined, "mark string, fails string, group string, id long, n long")
    changes = combined.groupBy("mark").transformWithState(
        statefulProcessor=_LeastId(), outputStructType="fails string, group string, n long", outputMode="append", timeMode="none")

    def add(batch: DataFrame, batch_id: int) -> None:
        summed = batch.groupBy("fails", "group").agg(F.sum("n").alias("n")).where("n <> 0").select(
            F.expr("substring(group, 3)").alias("part"), "fails", F.col("group").startswith("1").alias("good"),
            (F.substring("group", 2, 1) == "1").alias("toxic"), "n")
        summed.write.mode("overwrite").parquet(f"{run}/counters/batch={batch_id}")

    old = {k: spark.conf.get(k, None) for k in _ROCKS}
    for k, v in _ROCKS.items():
        spark.conf.set(k, v)
    try:
        changes.writeStream.outputMode("append").option("checkpointLocation", f"{run}/checkpoint").trigger(
            availableNow=True).foreachBatch(add).start().awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def report(counted: DataFrame) -> DataFrame:
    """The audit of counts by (part, fails, good, toxic): one row for each part, order and step."""
    masks = counted.groupBy("part", "fails").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))
    orders = F.array(*[F.lit("".join(o)) for o in itertools.permutations(FILTERS)])
    steps = masks.select("*", F.explode(orders).alias("filter_order")).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    earlier = F.substring("filter_order", F.lit(1), F.col("step") - 1)
    fails = F.contains(F.col("fails"), letter)
    gone = F.length(F.expr("translate(substring(filter_order, 1, step - 1), fails, '')")) < F.length(earlier)
    count = len(list(itertools.permutations(FILTERS)))

    def total(of: str, where: Column) -> Column:
        return F.sum(F.when(where, F.col(of)).otherwise(0)).cast("long")

    return steps.groupBy("part", "filter_order", "step").agg(
        total("n", ~gone & ~fails).alias("kept"), total("n", ~gone & fails).alias("removed"), total("n", gone & fails).alias("redundant"),
        total("n", F.col("fails") == letter).alias("unique_fails"), total("good", ~gone & fails).alias("good_lost"),
        total("toxic", ~gone & fails).alias("toxic_lost"),
        F.sum(F.when(fails, F.expr(f"n * {count} div greatest(length(fails), 1)")).otherwise(0)).cast("long").alias("shapley"))


def audit(spark: SparkSession, path: str, labels: DataFrame, files_per_batch: int = 8, run: str | None = None, **columns: str) -> DataFrame:
    """Rows (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of the Parquet files at ``path``."""
    run = run or f"{shared_folder(spark)}/audit-{uuid.uuid4().hex}"
    spark.createDataFrame([], _COUNTED).write.mode("overwrite").parquet(f"{run}/counters/batch=none")
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"  # matches the path alone; a stream takes a single file only by a pattern
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)
    count_stream(stream, labels, run, **columns)
    return report(spark.read.schema(_COUNTED).option("basePath", f"{run}/counters").parquet(f"{run}/counters/batch=*"))
