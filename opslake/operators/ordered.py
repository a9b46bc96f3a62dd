"""Ordered computations that stay distributed when one key holds most of the rows.

A plain window function sends each whole key to one task. The helpers here first cut every key into
buckets of neighbouring rows (an hour of events, a range of ids), work per (key, bucket), and carry a
small summary from bucket to bucket. Only the summaries, one row per (key, bucket), are ever ordered
per key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opslake.session import staged

ColumnLike = str | Column


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Widths tried by fit_time (seconds) and fit_range, widest first.
TIME_WIDTHS = (315_360_000, 2_592_000, 86_400, 3_600, 60, 1, 0.001, 0.000001)
RANGE_WIDTHS = (10 ** 12, 10 ** 9, 10 ** 8, 10 ** 7, 10 ** 6, 10 ** 5, 10 ** 4, 10 ** 3, 32, 1)


def by_time(ts: ColumnLike, seconds: float = 3600) -> Column:
    """Bucket of neighbouring rows for data ordered by a timestamp."""
    micros = F.unix_micros(_col(ts))
    return ((micros - F.pmod(micros, F.lit(round(seconds * 1e6)))) / F.lit(round(seconds * 1e6))).cast("long")


def by_range(number: ColumnLike, width: int = 1_000_000) -> Column:
    """Bucket of neighbouring rows for data ordered by a number."""
    return F.floor(_col(number) / F.lit(width)).cast("long")


def _widest(df: DataFrame, keys: Sequence[str], number: Column, widths: Sequence[int], max_rows: int) -> int:
    """The widest bucket that holds at most ``max_rows`` rows of any key; one counting job per step."""
    for tried in (widths[:-3], *[[w] for w in widths[-3:]]):
        cells = df.groupBy(*keys, F.floor(number / F.lit(tried[-1])).cast("long").alias("_cell")).agg(
            F.count(F.lit(1)).alias("_n"))
        wider = F.array(*[F.struct(F.lit(w).cast("long").alias("w"), F.floor(F.col("_cell") * tried[-1] / F.lit(w)).alias("b"))
                          for w in tried])
        fullest = (
            cells.select(*keys, "_n", F.inline(wider)).groupBy(*keys, "w", "b").agg(F.sum("_n").alias("_n"))
            .groupBy("w").agg(F.max("_n").alias("_n"))
        )
        fitting = [r["w"] for r in fullest.collect() if r["_n"] <= max_rows]
        if fitting:
            return max(fitting)
    return widths[-1]


def fit_time(df: DataFrame, keys: Sequence[str], ts: ColumnLike, max_rows: int = 1_000_000) -> Column:
    """Time bucket wide enough to be worth a task and narrow enough for the busiest key."""
    widths = [round(w * 1e6) for w in TIME_WIDTHS]
    return by_time(ts, _widest(df, keys, F.unix_micros(_col(ts)), widths, max_rows) / 1e6)


def fit_range(df: DataFrame, keys: Sequence[str], number: ColumnLike, max_rows: int = 1_000_000) -> Column:
    """Like :func:`fit_time` for data ordered by a number."""
    return by_range(number, _widest(df, keys, _col(number), RANGE_WIDTHS, max_rows))


def attach(df: DataFrame, summary: DataFrame, names: Sequence[str], how: str = "left") -> DataFrame:
    """Join a summary onto ``df`` by null-safe equality on ``names``.

    Pass a staged summary: Catalyst then knows its size and broadcasts it only if it is small. Without
    names the summary is a single row, whose values are added as literals.
    """
    if not names:
        row = summary.first()
        return df.withColumns({f.name: F.lit(row[f.name] if row else None).cast(f.dataType) for f in summary.schema})
    other = summary.withColumnsRenamed({n: f"_r_{n}" for n in names})
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_r_{n}")) for n in names])
    return df.join(other, same, how).drop(*[f"_r_{n}" for n in names])


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, amount: Column,
                  name: str) -> DataFrame:
    """Exact running sum per key, this row included. ``bucket`` must not decrease along ``order``."""
    keys = list(keys)
    tagged = df.withColumn("_bucket", bucket)
    per_key = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = staged(
        tagged.groupBy(*keys, "_bucket").agg(F.sum(amount).alias("_n"))
        .select(*keys, "_bucket", F.coalesce(F.sum("_n").over(per_key), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        attach(tagged, offsets, [*keys, "_bucket"])
        .withColumn(name, F.col("_before") + F.sum(amount).over(inside))
        .drop("_bucket", "_before")
    )


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, name: str = "rank") -> DataFrame:
    """Exact 1-based row number per key. ``bucket`` must not decrease along ``order``."""
    return running_total(df, keys, order, bucket, F.lit(1), name)


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
                  columns: dict[str, str]) -> DataFrame:
    """Add the previous row's values per key; ``columns`` maps source column to new column."""
    keys = list(keys)
    tagged = df.withColumn("_bucket", bucket)
    values = F.struct(*[F.col(src).alias(dst) for src, dst in columns.items()])
    per_key = Window.partitionBy(*keys).orderBy("_bucket")
    carry = staged(
        tagged.groupBy(*keys, "_bucket").agg(F.max_by(values, F.struct(*order)).alias("_last"))
        .select(*keys, "_bucket", F.lag("_last").over(per_key).alias("_carry"))
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    out = attach(tagged, carry, [*keys, "_bucket"]).withColumn(
        "_prev", F.coalesce(F.lag(values).over(inside), F.col("_carry")))
    return out.select("*", *[F.col(f"_prev.{dst}").alias(dst) for dst in columns.values()]).drop(
        "_bucket", "_carry", "_prev")


def last_seen(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, value: Column, name: str) -> DataFrame:
    """The last non-null ``value`` per key up to and including each row."""
    keys = list(keys)
    tagged = df.withColumn("_bucket", bucket).withColumn("_value", value)
    place = F.when(F.col("_value").isNotNull(), F.struct(*order))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = staged(
        tagged.groupBy(*keys, "_bucket").agg(F.max_by("_value", place).alias("_last"))
        .select(*keys, "_bucket", F.last("_last", ignorenulls=True).over(earlier).alias("_carry"))
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        attach(tagged, carry, [*keys, "_bucket"])
        .withColumn(name, F.coalesce(F.last("_value", ignorenulls=True).over(inside), F.col("_carry")))
        .drop("_bucket", "_value", "_carry")
    )


def overlapping(df: DataFrame, rank: str, rows: int, chunk: int | None = None) -> DataFrame:
    """Cut keys into chunks of consecutive ranks (``_chunk``), given an exact ``rank`` per key.

    The last ``rows - 1`` rows of a chunk are also sent to the next one, so a frame of ``rows`` rows is
    complete inside each chunk (50 frames long by default); a copy is recognised by ``_home`` differing from ``_chunk``.
    """
    chunk = max(chunk or 50 * rows, rows)
    position = (F.col(rank) - 1) % F.lit(chunk)
    home = F.floor((F.col(rank) - 1) / F.lit(chunk)).cast("long")
    copies = F.when(position >= chunk - rows + 1, F.array(home, home + 1)).otherwise(F.array(home))
    return df.withColumn("_home", home).withColumn("_chunk", F.explode(copies))


def rolling(df: DataFrame, keys: Sequence[str], rank: str, rows: int, outputs: dict[str, Callable],
            chunk: int | None = None) -> DataFrame:
    """Numbers over the last ``rows`` rows after every row, given an exact ``rank`` per key (see :func:`ranked`).

    ``outputs`` maps a name to a function of the pandas rolling frame. Each chunk is one pandas group,
    updated in one pass; a SQL row frame would visit ``rows`` rows again for every row.
    """
    fields = df.schema
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def run(pdf):
        pdf = pdf.sort_values(rank, ignore_index=True)
        frame = pdf.rolling(rows, min_periods=1)
        for name, fn in outputs.items():
            pdf[name] = fn(frame)
        return pdf.loc[pdf["_chunk"] == pdf["_home"], [*fields.names, *outputs]]

    return overlapping(df, rank, rows, chunk).groupBy(*keys, "_chunk").applyInPandas(
        run, ", ".join([shape, *[f"`{n}` double" for n in outputs]]))


def value_band(value: Column, per_octave: int = 256) -> Column:
    """A number that never decreases as ``value`` grows: linear steps inside powers of two."""
    size = F.least(F.abs(value), F.lit(1.7e308))
    octave = F.floor(F.log2(size))
    step = F.floor((size / F.pow(F.lit(2.0), octave) - 1) * per_octave)
    code = (octave + 1100) * per_octave + step
    return F.when(value == 0, F.lit(0)).when(value < 0, -code).otherwise(code).cast("long")


def _ranks(total: Column, q: float, kind: str) -> list[Column]:
    """1-based ranks that decide the quantile: one, or two neighbours for interpolation."""
    if kind == "disc":
        wanted = [F.greatest(F.ceil(total * F.lit(q)), F.lit(1))]
    elif kind == "desc":
        wanted = [total - F.floor(total * F.lit(1 - q))]
    elif kind == "cont":
        wanted = [F.floor((total - 1) * F.lit(q)) + 1, F.ceil((total - 1) * F.lit(q)) + 1]
    else:
        raise ValueError(f"unknown quantile kind {kind!r}")
    return [r.cast("long") for r in wanted]


def _quantile(total: Column, q: float, values: list[Column]) -> Column:
    if len(values) == 1:
        return values[0]
    position = (total - 1) * F.lit(q)
    return values[0] + (values[1] - values[0]) * (position - F.floor(position))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: ColumnLike, quantiles: dict[str, tuple],
                    per_octave: int = 256, fine: int = 50_000) -> DataFrame:
    """Exact quantiles per key, without bringing a key's values together.

    ``quantiles`` maps an output column to ``(q, kind)``; kind is ``"disc"`` (smallest value whose
    share is at least q), ``"desc"`` (element at floor(n * (1 - q)) of the descending values) or
    ``"cont"`` (linear interpolation). Null and NaN are ignored; a key with no values gets no row.

    A histogram over value bands finds the band that holds each wanted rank. A band of more than ``fine``
    rows with different values is cut again between its smallest and largest value, until none is left;
    only then the rows of the wanted bands are counted by value and ordered, at most ``fine`` values to a band.
    """
    keys = list(keys)
    rows = df.select(*keys, _col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    rows = rows.withColumn("_band", value_band(F.col("_v"), per_octave))
    held = [F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")]
    return histogram_quantiles(rows.groupBy(*keys, "_band").agg(*held), lambda found: rows, keys, quantiles, fine)


def histogram_quantiles(bands: DataFrame, rows_of: Callable[[DataFrame], DataFrame], keys: Sequence[str], quantiles: dict[str, tuple],
                        fine: int = 50_000) -> DataFrame:
    """The quantiles of :func:`exact_quantiles` from counts by value band (keys, _band, _n, _low, _high).

    ``rows_of`` gets the bands that hold a wanted rank (keys, _band) and returns at least their rows (keys, _band, _v).
    """
    keys = list(keys)
    per_key = Window.partitionBy(*keys)
    running = per_key.orderBy("_band").rowsBetween(Window.unboundedPreceding, 0)
    held = [F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")]
    histogram = bands.select(
        "*", F.sum("_n").over(running).alias("_cum"), F.sum("_n").over(per_key).alias("_total"))
    total, before = F.col("_total"), F.col("_cum") - F.col("_n")
    wanted = F.array(*[F.struct(F.lit(f"{name}#{i}").alias("slot"), r.alias("rank"))
                       for name, (q, kind) in quantiles.items() for i, r in enumerate(_ranks(total, q, kind))])

    def targets(bands: DataFrame, path: list[str], slots: Column) -> DataFrame:
        inside = F.filter(slots, lambda s: (s["rank"] > before) & (s["rank"] <= F.col("_cum")))
        return staged(bands.select(*path, "_n", "_low", "_high", "_total", before.alias("_before"), inside.alias("_slots"))
                      .filter(F.size("_slots") > 0))

    path = [*keys, "_band"]
    found = targets(histogram, path, wanted)
    rows = rows_of(found.select(*path))

    def finite(c: str) -> Column:
        return F.greatest(F.least(F.col(c), F.lit(1.7e308)), F.lit(-1.7e308))

    low, high = finite("_low"), finite("_high")
    crowded = (F.col("_n") > fine) & (low < high)
    while not found.filter(crowded).isEmpty():
        cut = f"_cut{len(path)}"
        step = F.when(crowded, F.floor((finite("_v") - low) / (high - low) * 4096)).otherwise(0).cast("long")
        limits = found.select(*path, "_n", "_low", "_high")
        rows = attach(rows, limits, path, "inner").withColumn(cut, step).select(*path, cut, "_v")
        parent, path = path, [*path, cut]
        inner = Window.partitionBy(*parent).orderBy(cut).rowsBetween(Window.unboundedPreceding, 0)
        bands = rows.groupBy(*path).agg(*held).withColumn("_cum", F.sum("_n").over(inner))
        bands = attach(bands, found.select(*parent, "_before", "_total", "_slots"), parent, "inner")
        found = targets(bands.withColumn("_cum", F.col("_cum") + F.col("_before")).drop("_before"), path, F.col("_slots"))
    near = Window.partitionBy(*path).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    counted = (
        attach(rows, found.select(*path), path, "leftsemi").groupBy(*path, "_v").agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_upto", F.sum("_c").over(near))
    )
    at = F.col("_before") + F.col("_upto")
    hits = (
        attach(counted, found, path, "inner")
        .select(*keys, "_v", "_c", at.alias("_at"), "_total", F.explode("_slots").alias("_slot"))
        .filter((F.col("_slot.rank") > F.col("_at") - F.col("_c")) & (F.col("_slot.rank") <= F.col("_at")))
    )
    slots = {name: [f"{name}#{i}" for i in range(len(_ranks(total, q, kind)))] for name, (q, kind) in quantiles.items()}
    wide = hits.groupBy(*keys).agg(
        F.max("_total").alias("_total"),
        *[F.max(F.when(F.col("_slot.slot") == s, F.col("_v"))).alias(s) for names in slots.values() for s in names])
    return wide.filter(total > 0).select(*keys, *[
        _quantile(total, q, [F.col(f"`{s}`") for s in slots[name]]).alias(name)
        for name, (q, _) in quantiles.items()])


def entry_states(tagged: DataFrame, keys: Sequence[str], lean: DataFrame, summarise: Callable, summary_fields: str,
                 carry: Callable, state_fields: str, compose: Callable | None = None, fan: int = 16) -> DataFrame:
    """State in which a sequential fold enters each (key, ``_bucket``), staged.

    ``summarise(pdf) -> dict`` describes how a bucket's rows change any entry state; ``lean`` holds just
    the rows and columns that needs. ``carry(list of dicts, start) -> list of dicts`` walks summaries in order from
    the state ``start`` (None at the beginning of a key), one row per bucket; a bucket without lean rows
    has a missing summary.

    Summaries of fixed size are walked per key. With ``compose(list of dicts) -> dict`` they may be larger:
    ``fan`` neighbouring ones are composed into one, again and again, and the states come down the same
    tree, so no task meets more than ``fan`` summaries.
    """
    names = [*keys, "_bucket"]
    key_fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tagged.select(*names).schema)

    def first_pass(pdf):
        return pd.DataFrame([{**{n: pdf[n].iloc[0] for n in names}, **summarise(pdf)}])

    summaries = lean.groupBy(*names).applyInPandas(first_pass, f"{key_fields}, {summary_fields}")
    buckets = tagged.select(*names).distinct()
    if compose is None:
        def walk(pdf):
            pdf = pdf.sort_values("_bucket", ignore_index=True)
            return pd.concat([pdf[names], pd.DataFrame(carry(pdf.to_dict("records"), None))], axis=1)

        return staged(attach(buckets, summaries, names).groupBy(*keys).applyInPandas(walk, f"{key_fields}, {state_fields}"))

    tree_fields = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in tagged.select(*keys).schema], "_at long"])
    state_names = [x.split()[0] for x in state_fields.split(", ")]
    numbered = buckets.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy("_bucket")).cast("long") - 1)
    level = staged(attach(numbered, summaries, names).drop("_bucket"))
    levels, up = [level], F.floor(F.col("_at") / fan)

    def group(pdf):
        pdf = pdf.sort_values("_at", ignore_index=True)
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "_at": pdf["_at"].iloc[0] // fan,
                              **compose(pdf.to_dict("records"))}])

    while (level.agg(F.max("_at")).first()[0] or 0) >= fan:
        level = staged(level.withColumn("_up", up).groupBy(*keys, "_up").applyInPandas(group, f"{tree_fields}, {summary_fields}"))
        levels.append(level)

    def descend(pdf):
        pdf = pdf.sort_values("_at", ignore_index=True)
        start = {n: pdf[f"_start{n}"].iloc[0] for n in state_names} if f"_start{state_names[0]}" in pdf else None
        return pd.concat([pdf[[*keys, "_at"]], pd.DataFrame(carry(pdf.to_dict("records"), start))], axis=1)

    states = None
    for level in reversed(levels):
        level = level.withColumn("_up", up)
        if states is not None:
            above = states.select(*keys, F.col("_at").alias("_up"), *[F.col(n).alias(f"_start{n}") for n in state_names])
            level = attach(level, above, [*keys, "_up"])
        states = staged(level.groupBy(*keys, "_up").applyInPandas(descend, f"{tree_fields}, {state_fields}"))
    return staged(attach(numbered, states, [*keys, "_at"]).select(*names, *state_names))
