"""Sequential rules per key (cooldowns, moving averages) as distributed folds."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslake.operators.ordered import attach, entry_states, fit_time
from opslake.session import staged

_NEVER = np.iinfo(np.int64).min // 2


def _next_actor(at: np.ndarray, wait: np.ndarray) -> np.ndarray:
    """For each eligible row the next one whose own waiting time has passed; len(at) if none."""
    n = len(at)
    best = np.full(n, n, dtype=np.int64)
    own = np.arange(n)
    for w in np.unique(wait):
        members = np.flatnonzero(wait == w)
        pick = np.maximum(np.searchsorted(at[members], at + w, side="left"),
                          np.searchsorted(members, own, side="right"))
        best = np.minimum(best, np.where(pick < len(members), members[np.minimum(pick, len(members) - 1)], n))
    return best


def _entry_steps(at: np.ndarray, wait: np.ndarray):
    """First actor as a step function of the last action before the bucket.

    Row i may act when the last action is not after ``at[i] - wait[i]``; only rows that raise the
    running maximum of that limit can ever be first.
    """
    limit = at - wait
    peak = np.maximum.accumulate(limit)
    first = np.flatnonzero(np.r_[True, peak[1:] > peak[:-1]])
    return limit[first], first


def cooldown_replay(df: DataFrame, keys: Sequence[str], ts: str, tie: str, eligible: Column, wait_s: Column,
                    bucket: Column | None = None) -> DataFrame:
    """Replay "act, then wait" per key.

    An ``eligible`` row acts when at least ``wait_s`` seconds (of that row) have passed since the
    key's last action. Adds ``acted`` and ``last_action`` (the action before this row, or null).
    (``ts``, ``tie``) identifies a row of a key. Only the eligible rows' times go through Python.

    A bucket's summary says, for any last action before it, which action is the last after it: one step for each row
    that can act first, so only rows within one waiting time of its start count. Summaries are composed in a tree.
    """
    keys = list(keys)
    names = [*keys, "_bucket"]
    bucket = fit_time(df, keys, ts) if bucket is None else bucket
    work = (
        df.withColumn("_bucket", bucket).withColumn("_at", F.unix_micros(ts))
        .withColumn("_ok", F.coalesce(eligible, F.lit(False)))
        .withColumn("_wait", (wait_s.cast("double") * 1_000_000).cast("long"))
    )
    lean = work.filter("_ok").select(*names, "_at", "_wait", tie)

    def ordered(pdf):
        pdf = pdf.sort_values(["_at", tie])
        return pdf, pdf["_at"].to_numpy(np.int64), pdf["_wait"].to_numpy(np.int64)

    def summarise(pdf):
        _, at, wait = ordered(pdf)
        jump = np.append(_next_actor(at, wait), len(at))
        end = np.append(np.arange(len(at)), len(at))
        while (jump[:-1] < len(at)).any():
            end = np.where(jump < len(at), end[jump], end)
            jump = jump[jump]
        limits, first = _entry_steps(at, wait)
        ends = at[end[first]]
        keep = np.r_[ends[:-1] != ends[1:], True]
        return {"limits": limits[keep].tolist(), "ends": ends[keep].tolist()}

    def steps(row):
        empty = row["limits"] is None
        return (np.array([] if empty else row[c], dtype=np.int64) for c in ("limits", "ends"))

    def after(limits, ends, last):
        at = np.searchsorted(limits, last, side="left")
        return np.where(at < len(limits), np.append(ends, 0)[at], last)

    def carry(rows, start):
        states, last = [], _NEVER if start is None else int(start["_entry"])
        for row in rows:
            states.append({"_entry": last})
            last = int(after(*steps(row), last))
        return states

    def compose(rows):
        limits, ends = np.array([], dtype=np.int64), np.array([], dtype=np.int64)
        for row in rows:
            next_limits, next_ends = steps(row)
            later = next_limits > (limits[-1] if len(limits) else _NEVER)
            limits, ends = np.r_[limits, next_limits[later]], np.r_[after(next_limits, next_ends, ends), next_ends[later]]
            keep = np.r_[ends[:-1] != ends[1:], np.ones(min(1, len(ends)), dtype=bool)]
            limits, ends = limits[keep], ends[keep]
        return {"limits": limits.tolist(), "ends": ends.tolist()}

    def act(pdf):
        pdf, at, wait = ordered(pdf)
        limits, first = _entry_steps(at, wait)
        step = np.searchsorted(limits, int(pdf["_entry"].iloc[0]), side="left")
        following, acts = _next_actor(at, wait), []
        i = int(first[step]) if step < len(limits) else len(at)
        while i < len(at):
            acts.append(i)
            i = int(following[i])
        return pdf.iloc[acts][[*keys, "_at", tie]]

    states = entry_states(work, keys, lean, summarise, "limits array<long>, ends array<long>", carry, "_entry long",
                          compose)
    row_fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in work.select(*keys, "_at", tie).schema)
    acts = staged(attach(lean, states, names).groupBy(*names).applyInPandas(act, row_fields))
    marked = attach(attach(work, states, names), acts.withColumn("_acted", F.lit(True)), [*keys, "_at", tie])
    before = Window.partitionBy(*names).orderBy("_at", tie).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.last(F.when(F.col("_acted"), F.col("_at")), ignorenulls=True).over(before)
    entry = F.when(F.col("_entry") != F.lit(_NEVER), F.col("_entry"))
    return marked.select(
        *df.columns, F.coalesce("_acted", F.lit(False)).alias("acted"),
        F.timestamp_micros(F.coalesce(inside, entry)).alias("last_action"))


def _decayed(x: np.ndarray, decay: float, start: float) -> np.ndarray:
    """s[t] = decay * s[t-1] + (1 - decay) * x[t], in blocks short enough for the powers to stay exact."""
    out = np.empty(len(x))
    block = max(1, int(np.log(1e-8) / np.log(decay))) if 0 < decay < 1 else 1
    for at in range(0, len(x), block):
        part = x[at:at + block]
        power = decay ** np.arange(1, len(part) + 1)
        out[at:at + block] = power * (start + np.cumsum((1 - decay) * part / power))
        start = out[min(at + block, len(x)) - 1]
    return out


def ewma(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, bucket: Column | None = None,
         decay: float = 0.95, seed_with_first: bool = True, name: str = "ewma") -> DataFrame:
    """Exponentially weighted average per key after every row; ``order`` starts with a timestamp.

    With ``seed_with_first`` an average of zero takes the next value as it is; otherwise it starts
    from zero. Values are expected not to be negative (latencies).
    """
    keys = list(keys)
    names = [*keys, "_bucket"]
    fields = df.schema
    work = df.withColumn("_bucket", fit_time(df, keys, order[0]) if bucket is None else bucket)

    def run(x, start):
        if seed_with_first and start == 0:
            filled = np.flatnonzero(x != 0)
            if not len(filled):
                return np.zeros(len(x))
            at = int(filled[0])
            return np.r_[np.zeros(at), x[at], _decayed(x[at + 1:], decay, x[at])]
        return _decayed(x, decay, start)

    def summarise(pdf):
        x = pdf.sort_values(list(order))[value].to_numpy(float)
        return {"_shrink": float(decay) ** len(x), "_from_zero": float(run(x, 0.0)[-1]),
                "_added": float(_decayed(x, decay, 0.0)[-1])}

    def carry(rows, start):
        states, s = [], 0.0
        for row in rows:
            states.append({"_entry": s})
            s = row["_from_zero"] if s == 0 else row["_shrink"] * s + row["_added"]
        return states

    def apply(pdf):
        pdf = pdf.sort_values(list(order))
        pdf[name] = run(pdf[value].to_numpy(float), float(pdf["_entry"].iloc[0]))
        return pdf[[*fields.names, name]]

    lean = work.select(*dict.fromkeys([*names, *order, value]))
    states = entry_states(work, keys, lean, summarise, "_shrink double, _from_zero double, _added double", carry, "_entry double")
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return attach(work, states, names).groupBy(*names).applyInPandas(apply, f"{shape}, {name} double")
