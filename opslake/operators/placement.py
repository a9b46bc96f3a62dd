"""Search for the nodes that can hold a task: a dominance join over a grid of free amounts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslake.session import staged

CELLS = 512


def _amounts(column: str, other: str | None, resources: Sequence[str], prefix: str) -> list[Column]:
    """One double per resource; what is not named is below every amount."""
    out = []
    for i, r in enumerate(resources):
        value = F.col(column)[r].cast("double")
        if other:
            value = value - F.coalesce(F.col(other)[r].cast("double"), F.lit(0.0))
        out.append(F.coalesce(value, F.lit(float("-inf"))).alias(f"{prefix}{i}"))
    return out


def placement_search(tasks: DataFrame, nodes: DataFrame, resources: Sequence[str], k: int = 3, task: Sequence[str] = ("task_id",),
                     node: str = "node_id", demand: str = "demand", cells: int = CELLS) -> DataFrame:
    """The ``k`` tightest nodes that can hold each task: rows (task columns, rank, node, slack); none for a task that fits nowhere.

    A node holds a task if every demanded resource has that amount free; the tightest has the least free in sum, ties go by node.
    Nodes fall into cells of a grid with quantiles of the free amounts as borders. A demand falls into the same grid: cells below
    it in any resource cannot hold it, cells above it in all resources hold it for certain, so their k best are known for each cell of
    demands, and only nodes in cells beside it that are tighter than these have to be compared. Equal demands are one. All joins
    are on cells; of the nodes, k for each cell and the tighter ones beside it meet demands, never all with all.
    """
    task, dims = list(task), range(len(resources))
    per_side = max(2, int(cells ** (1 / len(resources))))
    free = [f"f{i}" for i in dims]
    placed = nodes.select(F.col(node).alias("node"), *_amounts("capacity", "allocated", resources, "f"))
    total = reduce(lambda a, b: a + b, [F.when(F.col(c) == float("-inf"), 0.0).otherwise(F.col(c)) for c in free])
    placed = staged(placed.withColumn("slack", total))
    asked = tasks.select(*task, *_amounts(demand, None, resources, "d"))
    wants = [f"d{i}" for i in dims]

    shares = [i / per_side for i in range(1, per_side)]
    borders = placed.select(*[F.when(F.col(c) > float("-inf"), F.col(c)).alias(c) for c in free]).agg(
        *[F.percentile_approx(c, shares).alias(c) for c in free]).first()

    def celled(df: DataFrame, amounts: list[str], prefix: str) -> DataFrame:
        """The number of borders at or below each amount."""
        return df.withColumns({f"{prefix}{i}": reduce(
            lambda a, b: a + b, [(F.col(c) >= float(x)).cast("int") for x in sorted(set(borders[i] or []))], F.lit(0))
            for i, c in enumerate(amounts)})

    cell, home = [f"c{i}" for i in dims], [f"h{i}" for i in dims]
    placed = staged(celled(placed, free, "c"))
    demands = staged(celled(asked.select(*wants).distinct(), wants, "h"))

    # Cells that may hold something of each cell of demands, and whether they hold all of it.
    sides = demands.select(*home).distinct()
    for i in dims:
        sides = sides.withColumn(f"c{i}", F.explode(F.sequence(F.col(f"h{i}"), F.lit(per_side))))
    sides = sides.withColumn("sure", reduce(and_, [F.col(f"c{i}") > F.col(f"h{i}") for i in dims]))
    by_slack = [F.col("slack"), F.col("node")]
    best = placed.withColumn("_at", F.row_number().over(Window.partitionBy(*cell).orderBy(*by_slack))).where(F.col("_at") <= k)
    certain = sides.where("sure").join(best.drop("_at"), cell).withColumn(
        "_at", F.row_number().over(Window.partitionBy(*home).orderBy(*by_slack))).where(F.col("_at") <= k)
    certain = staged(certain.select(*home, "_at", *free, "slack", "node"))
    bound = certain.where(F.col("_at") == k).select(*home, F.struct("slack", "node").alias("bound"))
    edge = (sides.where("NOT sure").join(placed.groupBy(*cell).agg(F.min(F.struct("slack", "node")).alias("tightest")), cell)
            .join(bound, home, "left").where(F.col("bound").isNull() | (F.col("tightest") < F.col("bound"))).drop("tightest", "sure"))
    beside = edge.join(placed, cell).where(F.col("bound").isNull() | (F.struct("slack", "node") < F.col("bound")))
    candidates = certain.select(*home, *free, "slack", "node").unionByName(beside.select(*home, *free, "slack", "node"))

    fits = reduce(and_, [F.col(f) >= F.col(d) for f, d in zip(free, wants, strict=True)])
    ranked = demands.join(candidates, home).where(fits).withColumn(
        "rank", F.row_number().over(Window.partitionBy(*wants).orderBy(*by_slack))).where(F.col("rank") <= k)
    return asked.join(staged(ranked.select(*wants, "rank", F.col("node").alias(node), "slack")), wants).select(
        *task, "rank", node, "slack")
