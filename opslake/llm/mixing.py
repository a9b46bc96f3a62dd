"""Mixing sources to target weights by hierarchical budgets.

The levels (domain, language, source) form a tree. A budget of tokens enters at the root and is split among the
children of each node in proportion to their weights, top down. A child can take at most what its leaves hold in
``max_epochs`` passes; what it can't take goes to its siblings in proportion to their weights, and only what a whole
subtree can't take goes to the siblings of its ancestor. All amounts are whole numbers, so the split is exact and
the same everywhere.

A leaf's budget is a number of whole epochs and a rest. Every text counts once for each whole epoch; for the rest
the leaf's texts are ordered by a hash of (seed, epoch, id), and the longest prefix of whole texts that fits is taken.
The end of the prefix is found from token sums of hash ranges, so no task orders a whole leaf, and selection
is then a filter.

Defined results: a null level is the empty label; a text without words, empty or null, is never chosen; rows with
equal ids in a leaf are chosen together; children without a positive weight get nothing; an empty table gives an
empty result; further columns are passed through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslake.session import staged

WORD = r"[^\x20\x09-\x0D]+"


def _weight(column: Column, weights: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for label, w in weights.items():
        out = F.when(column == label, w).otherwise(out)
    return out.cast("long")


def split_budget(children: DataFrame, parents: list[str], label: str) -> DataFrame:
    """Add ``budget`` to rows (parents, label, capacity, weight, available): the parent's available amount is split.

    Children are met in order of capacity / weight. One is full if its capacity is at most its share of what
    those before it leave; the others share the rest by weight, rounded down.
    """
    rows = children.where(F.col("weight") > 0)
    whole = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    before = whole.orderBy(F.col("capacity") / F.col("weight"), label).rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("w_all", F.sum("weight").over(whole))
        .withColumn("w_before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("c_before", F.coalesce(F.sum("capacity").over(before), F.lit(0)))
    )
    wide = "decimal(38,0)"
    full = (F.col("capacity").cast(wide) * (F.col("w_all") - F.col("w_before"))
            <= (F.col("available") - F.col("c_before")).cast(wide) * F.col("weight"))
    rows = rows.withColumn("full", full)
    rest = F.col("available") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(whole)
    w_rest = F.col("w_all") - F.sum(F.when(F.col("full"), F.col("weight")).otherwise(0)).over(whole)
    rows = rows.withColumn("rest", rest).withColumn("w_rest", w_rest)
    share = F.expr("CAST(rest AS decimal(38,0)) * weight div w_rest")
    return rows.withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(share).cast("long")).drop(
        "w_all", "w_before", "c_before", "full", "rest", "w_rest", "available")


def budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], budget: int) -> DataFrame:
    """Rows (levels, tokens, budget) from rows (levels, tokens, capacity)."""
    given = None
    for depth, level in enumerate(levels):
        parents = levels[:depth]
        nodes = leaves.groupBy(*parents, level).agg(F.sum("capacity").alias("capacity")).withColumn(
            "weight", _weight(F.col(level), weights.get(level, {}), 0 if weights.get(level) else 1))
        nodes = (nodes.withColumn("available", F.lit(budget).cast("long")) if given is None
                 else nodes.join(given.select(*parents, F.col("budget").alias("available")), parents))
        given = split_budget(nodes, parents, level).select(*parents, level, "budget")
    return leaves.select(*levels, "tokens").join(given, levels)


def order_key(seed: int, epoch: Column, key: Column) -> Column:
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.concat(F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), text)), F.lit(":"), text)


def mix(docs: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, int]], share: float, max_epochs: int = 2,
        seed: int = 1, id_col: str = "doc_id", text_col: str = "text", name: str = "copies") -> DataFrame:
    """The rows of ``docs`` and ``name``, how often each is taken.

    ``levels`` maps names to columns, from the root down; ``weights`` maps a level to whole-number weights of its
    labels, and a level without weights weighs all labels alike. The budget is ``share`` of all tokens.
    """
    names = [f"__level{i}" for i in range(len(levels))]
    labels = [F.coalesce(c.cast("string"), F.lit("")) for c in levels.values()]
    known = {f"__level{i}": weights.get(level, {}) for i, level in enumerate(levels)}
    tokens = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    thin = staged(docs.select(*[c.alias(n) for c, n in zip(labels, names, strict=True)], F.col(id_col).alias("__id"),
                              tokens.alias("tokens")).where(F.col("tokens") > 0))
    leaves = staged(thin.groupBy(*names).agg(F.sum("tokens").alias("tokens")).withColumn(
        "capacity", F.col("tokens") * max_epochs))
    total, rows = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0], thin.count()
    plan = staged(
        budgets(leaves, names, known, int(total * share))
        .withColumn("epochs", F.expr("budget div tokens")).withColumn("rest", F.expr("budget % tokens")))

    digits = max(1, math.ceil(math.log(max(rows / 1000, 1), 16)))
    keyed = thin.join(plan.select(*names, "epochs", "rest"), names).where(F.col("rest") > 0).withColumn(
        "key", order_key(seed, F.col("epochs"), F.col("__id")))
    keyed = keyed.withColumn("range", F.substring("key", 1, digits))
    ranges = keyed.groupBy(*names, "rest", "range").agg(F.sum("tokens").alias("held"))
    upto = Window.partitionBy(*names).orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = ranges.withColumn("upto", F.sum("held").over(upto))
    last = ranges.where(F.col("upto") > F.col("rest")).groupBy(*names).agg(
        F.min("range").alias("range"), F.min(F.col("upto") - F.col("held")).alias("before"))
    inside = keyed.join(last, [*names, "range"]).withColumn(
        "upto", F.col("before") + F.sum("tokens").over(Window.partitionBy(*names, "range").orderBy("key")))
    # Where nothing of the last range fits, its name is the cut: keys of earlier ranges sort before it.
    cuts = inside.groupBy(*names, "range").agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("key"))).alias("key")).select(
        *names, F.coalesce("key", "range").alias("__cut"))
    chosen = staged(plan.select(*names, F.col("epochs").alias("__epochs")).join(cuts, names, "left"))

    joined = docs.join(chosen, [label == chosen[n] for label, n in zip(labels, names, strict=True)], "left")
    more = F.coalesce(order_key(seed, F.col("__epochs"), docs[id_col]) <= F.col("__cut"), F.lit(False)).cast("long")
    taken = F.when(docs[text_col].rlike(WORD), F.coalesce("__epochs", F.lit(0)) + more).otherwise(0).cast("long")
    return joined.select(*[docs[c] for c in docs.columns], taken.alias(name))
