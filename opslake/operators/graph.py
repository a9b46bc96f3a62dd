"""Dependency graphs: checks, levels, closure, cycles, versions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opslake.functions.scalars import semver_bounds, semver_bucket, semver_key
from opslake.operators.ordered import last_seen
from opslake.session import staged

# Task type pattern and limits of a workflow.
TASK_TYPE = r"^[a-z0-9_]+$"
MAX_MEMORY = 1024
MAX_TOTAL_TIMEOUT = 86_400
# Groups of at most so many edges are closed in one task, many at a time up to so many steps; others go by rounds of joins.
SMALL = 256
STEPS = 1 << 20


def dag_validate(nodes: DataFrame, edges: DataFrame, strict: bool = True, max_memory: int = MAX_MEMORY,
                 max_total: int = MAX_TOTAL_TIMEOUT) -> DataFrame:
    """(dag_id, node_id, error) rows for many workflows at once; workflow-wide errors have no node.

    Id, task type and timeout must be there; retries and memory may be null. With ``strict`` an undefined dependency is an error, else it is left to :func:`defined_edges`.
    """
    checks = {
        "id": F.length("node_id") >= 1, "task_type": F.col("task_type").rlike(TASK_TYPE), "timeout": F.col("timeout") >= 1,
        "retries": F.col("retries") >= 0, "memory": F.col("memory") <= max_memory,
    }
    wrong = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(name not in ("id", "task_type", "timeout"))), F.lit(name)) for name, ok in checks.items()]))
    errors = nodes.select("dag_id", "node_id", F.explode(wrong).alias("error"))
    total = nodes.groupBy("dag_id").agg(F.sum("timeout").alias("_total")).filter(F.col("_total") > max_total)
    errors = errors.unionByName(total.select("dag_id", F.lit(None).cast("string").alias("node_id"),
                                             F.lit("total_timeout").alias("error")))
    if strict:
        errors = errors.unionByName(undefined_dependencies(nodes, edges).select(
            "dag_id", "node_id", F.concat(F.lit("undefined:"), "depends_on").alias("error")))
    return errors


def undefined_dependencies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    known = nodes.select("dag_id", F.col("node_id").alias("depends_on"))
    return edges.join(known, ["dag_id", "depends_on"], "left_anti").select("dag_id", "node_id", "depends_on")


def defined_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    known = nodes.select("dag_id", F.col("node_id").alias("depends_on"))
    return edges.join(known, ["dag_id", "depends_on"], "left_semi").select("dag_id", "node_id", "depends_on").distinct()


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def dag_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Topological level of every node (0 without dependencies); null for nodes on or behind a cycle.

    All workflows advance together, one round per level. The table of open nodes with their number of
    open dependencies shrinks from round to round and is the only thing written.
    """
    names = ["dag_id", "node_id"]
    needs = staged(defined_edges(nodes, edges))
    counts = needs.groupBy(*names).agg(F.count(F.lit(1)).alias("_open"))
    state = staged(nodes.select(*names).distinct().join(counts, names, "left").withColumn("_open", F.coalesce("_open", F.lit(0))))
    done: list[DataFrame] = []
    for level in count():
        ready = state.filter("_open = 0")
        if ready.isEmpty():
            stuck = state.select(*names, F.lit(None).cast("int").alias("level"))
            return _union([*done, stuck])
        done.append(ready.select(*names, F.lit(level).alias("level")))
        if len(done) > 50:
            done = [staged(_union(done))]
        closed = (
            needs.join(ready.select("dag_id", F.col("node_id").alias("depends_on")), ["dag_id", "depends_on"])
            .groupBy(*names).agg(F.count(F.lit(1)).alias("_closed"))
        )
        state = staged(state.filter("_open > 0").join(closed, names, "left").select(
            *names, (F.col("_open") - F.coalesce("_closed", F.lit(0))).alias("_open")))


def _joined(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join within rounds. Rounds are many, so none of them sends a table through the driver to broadcast it."""
    return left.join(right.hint("merge"), on, how)


def dep_closure(edges: DataFrame, group: Sequence[str] = ("dag_id",)) -> DataFrame:
    """Every direct and indirect dependency (group, node_id, depends_on).

    Groups of few edges are closed whole. In others the closure is formed over strongly connected components, with one answer for
    all nodes of a cycle, and written out for their members at the end.
    """
    group = list(group)
    small, large = _by_size(edges, group)
    if large is None:
        return _closed(small, group)
    answers, members = condensed_closure(large, group)
    needs = members.select(*group, F.col("component").alias("needs"), F.col("node_id").alias("depends_on"))
    written = _joined(_joined(answers, members, [*group, "component"]), needs, [*group, "needs"])
    return _closed(small, group).unionByName(written.select(*group, "node_id", "depends_on"))


def _by_size(edges: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """The edges of groups with at most ``SMALL`` of them, and those of all others (None without any). A null leads nowhere."""
    edges = edges.select(*group, "node_id", "depends_on").dropna()
    if not group:
        return edges.limit(0), edges
    edges = staged(edges)
    above = staged(edges.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > SMALL).select(*group))
    if above.isEmpty():
        return edges, None
    return _joined(edges, above, group, "left_anti"), staged(_joined(edges, above, group, "left_semi"))


def _closed(edges: DataFrame, group: list[str], cycles: bool = False) -> DataFrame:
    """All (group, node_id, depends_on) where edges lead from one node to the other, or with ``cycles`` those from a node to itself.

    For groups of few edges: each is one row on its way to a task, which closes many groups together.
    """
    if not group:
        return edges
    rows = edges.groupBy(*group).agg(F.collect_set(F.struct("node_id", "depends_on")).alias("_edges"))

    def close(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("_edges")
            count = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(count)), count)
            names = pa.concat_arrays(lists.flatten().flatten()).dictionary_encode()
            known = len(names.dictionary)
            nodes, ends = np.unique(np.tile(row, 2) * known + names.indices.to_numpy(), return_inverse=True)
            size = np.bincount(nodes // known, minlength=len(count))
            first = np.cumsum(size) - size  # the nodes of a row are numbered one after the other
            part = np.cumsum(size * np.maximum(size, count)) // STEPS
            for at in np.split(np.arange(len(count)), np.flatnonzero(np.diff(part)) + 1):
                low, high = np.searchsorted(row, [at[0], at[-1] + 1])
                base = first[at[0]]
                start, end = _followed(ends[low:high] - base, ends[len(row):][low:high] - base, size[at])
                if cycles:
                    start, end = start[start == end], end[start == end]
                if len(start):
                    start, end = nodes[start + base], nodes[end + base]
                    of = pa.array(start // known)
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(c).take(of) for c in group), *(names.dictionary.take(pa.array(v % known)) for v in (start, end))],
                        names=[*group, "node_id", "depends_on"])

    return rows.mapInArrow(close, T.StructType([rows.schema[c] for c in group] + [edges.schema[c] for c in ("node_id", "depends_on")]))


def _followed(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (start, end) that edges a -> b lead from and to. Nodes are numbered group by group, ``size`` in each."""
    width = np.repeat(size, size)
    first = np.repeat(np.cumsum(size) - size, size)
    table = np.repeat(np.cumsum(size ** 2) - size ** 2, size) + (np.arange(len(width)) - first) * width - first
    seen = np.zeros(int((size ** 2).sum()), dtype=bool)
    targets, outs = b[np.argsort(a, kind="stable")], np.bincount(a, minlength=len(width))
    begin = np.cumsum(outs) - outs
    seen[table[a] + b] = True
    found = [(a, b)]
    while len(found[-1][0]):
        start, via = found[-1]
        many = outs[via]
        start = np.repeat(start, many)
        end = targets[np.repeat(begin[via] - np.cumsum(many) + many, many) + np.arange(len(start))]
        cell = table[start] + end
        cell, once = np.unique(np.where(seen[cell], -1, cell), return_index=True)
        once = once[cell >= 0]
        seen[cell[cell >= 0]] = True
        found.append((start[once], end[once]))
    return tuple(np.concatenate(v) for v in zip(*found, strict=True))


def condensed_closure(edges: DataFrame, group: Sequence[str] = ("dag_id",)) -> tuple[DataFrame, DataFrame]:
    """(group, component, needs) for all pairs of components where one needs the other, and the members of components.

    A component needs itself if it is a cycle. Path lengths double each round, so a chain of n components takes about
    log2(n) rounds: the pairs found last are extended by all known ones.
    """
    group = list(group)
    pair = [*group, "component", "needs"]
    edges = staged(edges.select(*group, "node_id", "depends_on").distinct())
    members = strong_components(edges, group)
    on = members.select(*group, F.col("node_id").alias("depends_on"), F.col("component").alias("needs"))
    condensed = staged(_joined(_joined(edges, members, [*group, "node_id"]), on, [*group, "depends_on"]).select(*pair).distinct())
    loops = condensed.filter("component = needs")
    fresh = condensed.filter("component <> needs")
    parts = [fresh]
    while True:
        known = _union(parts)
        longer = _joined(fresh.withColumnRenamed("needs", "_via"), known.withColumnRenamed("component", "_via"), [*group, "_via"])
        fresh = staged(_joined(longer.select(*pair).distinct(), known, pair, "left_anti"))
        if fresh.isEmpty():
            return known.unionByName(loops), members
        parts.append(fresh)


def dep_cycles(edges: DataFrame, group: Sequence[str] = ("dag_id",)) -> DataFrame:
    """Nodes that depend on themselves, directly or not: those of components of several nodes, and of loops."""
    group = list(group)
    loops = edges.filter(F.col("node_id") == F.col("depends_on")).select(*group, "node_id")
    small, large = _by_size(edges.filter(F.col("node_id") != F.col("depends_on")), group)
    loops = loops.unionByName(_closed(small, group, cycles=True).select(*group, "node_id"))
    if large is None:
        return loops.distinct()
    members = strong_components(large, group)
    several = members.groupBy(*group, "component").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return _joined(members, several, [*group, "component"]).select(*group, "node_id").unionByName(loops).distinct()


def strong_components(edges: DataFrame, group: Sequence[str] = ("dag_id",)) -> DataFrame:
    """(group, node_id, component) of every node of the edges; a component is named by its smallest node.

    Rounds of trimming, chain contraction and colouring, each with rows in proportion to the edges still open:

    - edges that lead out of every cycle are dropped;
    - nodes with one edge in and one out are passed over by pointers whose reach doubles, so a ring or a chain of n nodes
      takes log2(n) rounds; they belong to the component of both ends of their chain, if that is the same;
    - every node takes the smallest node that reaches it as its colour; what reaches that node within the colour is its
      component; edges within what is left of a colour go on to the next round.
    """
    group = list(group)
    key = {c: F.struct(*group, F.col(c).alias("node_id")) for c in ("node_id", "depends_on")}
    whole = edges.select(key["node_id"].alias("a"), key["depends_on"].alias("b"))
    names = whole.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    open_edges = _trimmed(staged(whole.filter("a <> b").distinct()))
    found: list[DataFrame] = []  # (v, component), components of several nodes
    chains: list[DataFrame] = []  # (v, start, end), oldest first
    while not open_edges.isEmpty():
        passed, rings, open_edges = _contracted(open_edges)
        chains.append(passed)
        found.append(rings)
        done, open_edges = _coloured(open_edges)
        found.append(done)
        open_edges = _trimmed(open_edges)
    known = staged(_union(found)) if found else None
    for passed in reversed(chains):
        ends = known.select(F.col("v").alias("end"), F.col("component").alias("_end"))
        starts = known.withColumnRenamed("v", "start")
        inside = _joined(_joined(passed, starts, "start"), ends, "end").filter(F.col("component") == F.col("_end"))
        # A chain from a node back to itself is a cycle, though the node may be in no other.
        alone = _joined(passed.filter("start = end"), starts, "start", "left_anti")
        loops = alone.select("v", F.col("start").alias("component")).unionByName(
            alone.select(F.col("start").alias("v"), F.col("start").alias("component")).distinct())
        known = staged(known.unionByName(inside.select("v", "component")).unionByName(loops))
    if known is None:
        return names.select("v.*", F.col("v.node_id").alias("component"))
    least = known.groupBy("component").agg(F.min("v").alias("_least"))
    named = _joined(known, least, "component").select("v", "_least")
    return _joined(names, named, "v", "left").select("v.*", F.coalesce("_least", "v")["node_id"].alias("component"))


def _trimmed(edges: DataFrame) -> DataFrame:
    """Drop edges that cannot lie on a cycle, as long as a tenth of them goes: nothing leads to their start, or from their end."""
    size = edges.count()
    while size:
        starts, ends = edges.select(F.col("a").alias("b")).distinct(), edges.select(F.col("b").alias("a")).distinct()
        edges = staged(_joined(_joined(edges, starts, "b", "left_semi"), ends, "a", "left_semi").select("a", "b"))
        left = edges.count()
        if 10 * (size - left) < size:
            break
        size = left
    return edges


def _contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pass over nodes with one edge in and one out: (v, start, end) of chains, (v, component) of whole rings, and the edges
    between all other nodes, with one for each chain."""
    degrees = edges.select(F.explode(F.array(
        F.struct(F.col("a").alias("v"), F.col("b").alias("end"), F.lit(None).cast(edges.schema["a"].dataType).alias("start")),
        F.struct(F.col("b").alias("v"), F.lit(None).cast(edges.schema["a"].dataType).alias("end"), F.col("a").alias("start")))).alias("e"))
    single = degrees.groupBy("e.v").agg(F.count("e.end").alias("outs"), F.count("e.start").alias("ins"),
                                        F.min("e.end").alias("end"), F.min("e.start").alias("start")).filter("outs = 1 AND ins = 1")
    links = staged(single.select("v", "start", "end", F.col("v").alias("low")))
    size, reach = links.count(), 1
    between = links.select("v")
    while True:
        # Both pointers of a node jump to those of the chain nodes that they point to.
        ahead = links.select(F.col("v").alias("end"), F.col("end").alias("_end"), F.col("low").alias("_low"))
        behind = links.select(F.col("v").alias("start"), F.col("start").alias("_start"))
        going = _joined(links, ahead.select("end").distinct(), "end", "left_semi")
        if reach >= size or going.isEmpty():
            break
        links = staged(_joined(_joined(links, ahead, "end", "left"), behind, "start", "left").select(
            "v", F.coalesce("_start", "start").alias("start"), F.coalesce("_end", "end").alias("end"),
            F.coalesce(F.least("low", "_low"), "low").alias("low")))
        reach *= 2
    in_ring = _joined(links, between.withColumnRenamed("v", "end"), "end", "left_semi")
    rings = staged(in_ring.select("v", F.col("low").alias("component")))
    passed = staged(_joined(links, between.withColumnRenamed("v", "end"), "end", "left_anti").select("v", "start", "end"))
    kept = _joined(_joined(edges, between.withColumnRenamed("v", "a"), "a", "left_anti"), between.withColumnRenamed("v", "b"), "b", "left_anti")
    across = passed.select(F.col("start").alias("a"), F.col("end").alias("b")).filter("a <> b")
    return passed, rings, staged(kept.select("a", "b").unionByName(across).distinct())


def _coloured(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(v, component) of the components of all colours, and the edges within what is left of the colours."""
    colours = staged(edges.select(F.explode(F.array("a", "b")).alias("v")).distinct().withColumn("colour", F.col("v")))
    while True:
        taken = _joined(edges, colours.withColumnRenamed("v", "a"), "a").groupBy(F.col("b").alias("v")).agg(F.min("colour").alias("_by"))
        # What reaches my colour reaches me as well.
        above = colours.select(F.col("v").alias("colour"), F.col("colour").alias("_above"))
        after = staged(_joined(_joined(colours, taken, "v", "left"), above, "colour", "left").select(
            "v", F.least("colour", F.coalesce("_by", "colour"), "_above").alias("colour"), F.col("colour").alias("_old")))
        colours = after.drop("_old")
        if after.filter("colour <> _old").isEmpty():
            break
    other = colours.select(F.col("v").alias("b"), F.col("colour").alias("_other"))
    same = staged(_joined(_joined(edges, colours.withColumnRenamed("v", "a"), "a"), other, "b").filter("colour = _other").select("a", "b", "colour"))
    front = staged(colours.filter("v = colour"))
    reached = [front]
    while not front.isEmpty():
        held = _union(reached)
        behind = _joined(same, front.select(F.col("v").alias("b")), "b", "left_semi").select(F.col("a").alias("v"), "colour").distinct()
        front = staged(_joined(behind, held.select("v"), "v", "left_anti"))
        reached.append(front)
    held = staged(_union(reached))
    several = held.groupBy("colour").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("colour")
    rest = _joined(_joined(same, held.select(F.col("v").alias("a")), "a", "left_anti"), held.select(F.col("v").alias("b")), "b", "left_anti")
    return staged(_joined(held, several, "colour").select("v", F.col("colour").alias("component"))), staged(rest.select("a", "b"))


def dependency_check(needs: DataFrame, available: DataFrame) -> DataFrame:
    """Unsatisfied requirements with their ``problem``: ``missing`` when the needed name has no valid
    version, ``range`` when the range cannot be read, ``version`` when no version fits.

    A range fits when the highest version below its upper bound is not below its lower bound. That
    version is the last one seen in version order, so requirements never meet all versions.
    """
    valid = available.select(F.col("name").alias("needs"), semver_key(F.col("version")).alias("_key")).filter(
        F.col("_key").isNotNull()).distinct()
    versions = valid.select("needs", F.lit(None).cast("string").alias("version_range"),
                            F.concat("_key", F.array(F.lit(0).cast("long"))).alias("_at"), F.lit(1).alias("_kind"),
                            F.lit(None).cast("array<bigint>").alias("_low"))
    limits = semver_bounds(F.col("version_range"))
    wanted = needs.select("needs", "version_range").distinct().withColumn("_limits", limits)
    asked = wanted.filter(F.col("_limits").isNotNull()).select(
        "needs", "version_range", F.col("_limits.high").alias("_at"), F.lit(0).alias("_kind"), F.col("_limits.low").alias("_low"))
    # At equal places the requirement comes first: its upper bound is exclusive.
    placed = last_seen(versions.unionByName(asked), ["needs"], ["_at", "_kind", "version_range"], semver_bucket(F.col("_at")),
                       F.when(F.col("_kind") == 1, F.col("_at")), "_best")
    fits = placed.filter((F.col("_kind") == 0) & (F.col("_best") >= F.col("_low"))).select("needs", "version_range")
    bad = wanted.join(fits, ["needs", "version_range"], "left_anti").join(
        valid.select("needs").distinct().withColumn("_known", F.lit(True)), "needs", "left")
    problem = F.when(F.col("_known").isNull(), "missing").when(F.col("_limits").isNull(), "range").otherwise("version")
    return needs.join(bad.select("needs", "version_range", problem.alias("problem")), ["needs", "version_range"])


def dependency_drift(required: DataFrame, environment: DataFrame) -> DataFrame:
    """Libraries whose installed version differs; a library that is not installed counts as 0.0.0."""
    installed = environment.select("lib", F.col("version").alias("_have"))
    found = required.join(installed, "lib", "left").withColumn("installed", F.coalesce("_have", F.lit("0.0.0")))
    return found.filter(F.col("installed") != F.col("version")).drop("_have")


def removable(items: DataFrame, edges: DataFrame, key: str = "node_id", group: Sequence[str] = ("dag_id",)) -> DataFrame:
    """Items that nothing depends on."""
    needed = edges.select(*group, F.col("depends_on").alias(key)).distinct()
    return items.join(needed, [*group, key], "left_anti")


def reject_dependents(items: DataFrame, edges: DataFrame, key: str = "node_id",
                      group: Sequence[str] = ("dag_id",)) -> DataFrame:
    """Items that may not be removed because others depend on them, with the number of those."""
    needed = edges.groupBy(*group, F.col("depends_on").alias(key)).agg(F.count(F.lit(1)).alias("dependents"))
    return items.join(needed, [*group, key])
