"""Service registry and request routing over node tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslake.operators.ordered import fit_range, running_total
from opslake.operators.tables import map_field, metadata_filter
from opslake.session import staged


def service_registry_view(leases: DataFrame, as_of: dt.datetime, service: str | None = None,
                          filters: dict | None = None) -> DataFrame:
    """Newest unexpired lease per (name, service_id), optionally of one service and with metadata values."""
    rows = leases if service is None else leases.filter(F.col("name") == service)
    rest = [c for c in rows.columns if c not in ("name", "service_id")]
    newest = (
        rows.filter(F.col("ts") <= F.lit(as_of)).groupBy("name", "service_id")
        .agg(F.max_by(F.struct(*rest), F.struct("ts", "endpoint")).alias("_r"))
        .select("name", "service_id", "_r.*")
    )
    alive = F.unix_micros("ts") + F.col("ttl").cast("long") * 1_000_000 > F.unix_micros(F.lit(as_of))
    return newest.filter(alive & metadata_filter(filters, map_field("metadata")))


def best_endpoint(nodes: DataFrame, keys: Sequence[str] = ("service",)) -> DataFrame:
    """Lowest latency, then highest weight, then id, per key."""
    return nodes.groupBy(*keys).agg(F.min_by("node_id", F.struct("latency", -F.col("weight"), "node_id")).alias("node_id"))


def _candidates(nodes: DataFrame, keys: Sequence[str], panic: float) -> DataFrame:
    """Healthy nodes; all nodes where the healthy share is below ``panic``; none where no node is healthy."""
    share = nodes.groupBy(*keys).agg((F.count_if("healthy") / F.count(F.lit(1))).alias("_share"))
    return nodes.join(share, list(keys)).filter(
        (F.col("_share") > 0) & (F.col("healthy") | (F.col("_share") < panic))).drop("_share")


def least_loaded(nodes: DataFrame, keys: Sequence[str] = ("service",), panic: float = 0.2) -> DataFrame:
    """Node with the fewest connections per weight; a weight of zero comes last."""
    load = F.when(F.col("weight") > 0, F.col("connections") / F.col("weight")).otherwise(F.lit(float("inf")))
    return _candidates(nodes, keys, panic).groupBy(*keys).agg(
        F.min_by("node_id", F.struct(load.alias("load"), "node_no")).alias("node_id"), F.min(load).alias("load"))


def wrr_slots(nodes: DataFrame, keys: Sequence[str] = ("service",), panic: float = 0.2) -> DataFrame:
    """(key, slot, node_id, total): a node takes as many consecutive slots as its weight."""
    keys = list(keys)
    nodes = staged(_candidates(nodes, keys, panic).filter("weight > 0").select(*keys, "node_no", "node_id", "weight"))
    ranges = running_total(nodes, keys, [F.col("node_no")], fit_range(nodes, keys, "node_no"), F.col("weight"), "_end")
    totals = nodes.groupBy(*keys).agg(F.sum("weight").alias("total"))
    return ranges.join(totals, keys).select(
        *keys, "node_id", "total", F.explode(F.sequence(F.col("_end") - F.col("weight"), F.col("_end") - 1)).alias("slot"))


def wrr_assign(requests: DataFrame, nodes: DataFrame, number: str, keys: Sequence[str] = ("service",),
               panic: float = 0.2) -> DataFrame:
    """Weighted round robin: request number k (from 1) goes to the node that holds slot k mod total.

    The range lookup becomes an equality join on the slot.
    """
    keys = list(keys)
    slots = staged(wrr_slots(nodes, keys, panic))
    totals = slots.select(*keys, "total").distinct()
    numbered = requests.join(totals, keys).withColumn("slot", F.col(number) % F.col("total")).drop("total")
    return numbered.join(slots.drop("total"), [*keys, "slot"])


def over_allocated(nodes: DataFrame) -> DataFrame:
    """Nodes (maps ``capacity`` and ``allocated``) where an allocation exceeds its capacity."""
    over = F.map_filter("allocated", lambda k, v: v > F.coalesce(F.col("capacity")[k], F.lit(0)))
    return nodes.withColumn("_over", F.cardinality(over)).filter("_over > 0").drop("_over")


def _mean_share(allocated: Column, capacity: Column) -> Column:
    used = F.transform(F.map_entries(capacity), lambda e: F.coalesce(allocated[e["key"]], F.lit(0)) / e["value"])
    return F.aggregate(used, F.lit(0.0), lambda a, x: a + x) / F.size(used)


def node_utilization(nodes: DataFrame) -> DataFrame:
    """Mean share of allocated capacity over a node's resources; a missing allocation is zero."""
    return nodes.withColumn("utilization", _mean_share(F.col("allocated"), F.col("capacity")))


def utilization(nodes: DataFrame) -> DataFrame:
    """Mean over nodes of their mean share."""
    return node_utilization(nodes).agg(F.avg("utilization").alias("utilization"))


def utilization_vector(nodes: DataFrame, resources: Sequence[str]) -> DataFrame:
    """One share per resource, in the given order."""
    return nodes.withColumn("utilization", F.array(*[
        F.coalesce(F.col("allocated")[r], F.lit(0)) / F.col("capacity")[r] for r in resources]))


def feasible_placement(proposals: DataFrame, nodes: DataFrame, node: str = "node_id", demand: str = "demand") -> DataFrame:
    """Whether each proposed (task, node) pair fits: every demanded resource plus what is allocated
    stays within the node's capacity. Pairs with an unknown node do not fit."""
    joined = proposals.join(nodes.select(node, "capacity", "allocated"), node, "left")
    fits = F.forall(F.map_entries(demand), lambda e: F.coalesce(
        F.coalesce(F.col("allocated")[e["key"]], F.lit(0)) + e["value"] <= F.col("capacity")[e["key"]], F.lit(False)))
    return joined.withColumn("feasible", fits).drop("capacity", "allocated")


def task_features(tasks: DataFrame, as_of: dt.datetime, demand: str = "demand") -> DataFrame:
    """Priority / 10, hours to the deadline and total demand of a task."""
    return tasks.select(
        "*", (F.col("priority") / 10.0).alias("priority_norm"),
        ((F.unix_micros("deadline") - F.unix_micros(F.lit(as_of))) / 3.6e9).alias("hours_left"),
        F.aggregate(F.map_values(demand), F.lit(0.0), lambda a, x: a + x).alias("total_demand"))
