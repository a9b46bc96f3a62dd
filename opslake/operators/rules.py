"""Rules over rows: topic routing, access policies, inference."""

from __future__ import annotations

import operator
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslake.session import staged

# Characters allowed in a topic.
TOPIC = r"^[a-zA-Z0-9\-_/]+$"


def _trie(rules: DataFrame) -> tuple[DataFrame, int, bool]:
    """Nodes below the root (parent, token, child), the patterns' beginnings; the most levels of a pattern, and whether one has ``#``."""
    levels = rules.select("pattern").distinct().withColumn("_levels", F.split("pattern", "/"))
    steps = levels.select("_levels", F.posexplode("_levels").alias("_at", "token"), F.size("_levels").alias("_n"))
    before = F.concat(F.concat_ws("/", F.slice("_levels", F.lit(1), F.col("_at"))), F.lit("/"))
    parent = F.when(F.col("_at") == 0, F.lit("")).otherwise(before)
    nodes = staged(steps.groupBy(parent.alias("parent"), "token").agg(F.max("_n").alias("_n")).withColumn(
        "child", F.concat("parent", "token", F.lit("/"))))
    found = nodes.agg(F.coalesce(F.max("_n"), F.lit(0)), F.coalesce(F.max(F.col("token") == "#"), F.lit(False))).first()
    return nodes.select("parent", "token", "child"), found[0], found[1]


def _walked(topics: DataFrame, nodes: DataFrame, depth: int, spread: int) -> DataFrame:
    """(topic, pattern) of all patterns that match, walking all topics down the trie one level per join.

    A walk at a node goes on by its next level, by ``+`` or by ``#``, as far as the trie has such a node, and stays at a ``#``
    as long as it likes. Every node is there ``spread`` times, so that a wildcard below the root is not one key for all topics.
    """
    trie = nodes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))).select(
        F.col("parent").alias("_parent"), F.col("token").alias("_token"), "_salt", F.col("child").alias("_child"))
    walks = topics.select(
        "topic", F.split("topic", "/").alias("levels"), F.lit("").alias("at"), F.lit(True).alias("filled"),
        F.pmod(F.xxhash64("topic"), F.lit(spread)).cast("int").alias("salt"))
    for i in range(depth):
        level = F.get("levels", F.lit(i))
        goes = F.size("levels") > i
        # What # has taken must not be empty; a walk that has taken one empty level there has to take another.
        moves = F.filter(F.array(
            F.struct(level.alias("token"), F.lit(True).alias("filled"), (goes & F.col("filled")).alias("ok")),
            F.struct(F.lit("+").alias("token"), F.lit(True).alias("filled"), (goes & F.col("filled") & (level != "")).alias("ok")),
            F.struct(F.lit("#").alias("token"), (level != "").alias("filled"), (goes & F.col("filled")).alias("ok")),
            F.struct(F.lit(None).cast("string").alias("token"), F.lit(True).alias("filled"), (~goes | F.col("at").endswith("#/")).alias("ok")),
        ), lambda m: m["ok"])
        moved = walks.withColumn("m", F.explode(moves)).join(
            trie, (F.col("at") == F.col("_parent")) & (F.col("m.token") == F.col("_token")) & (F.col("salt") == F.col("_salt")), "left")
        walks = moved.where("m.token IS NULL OR _child IS NOT NULL").select(
            "topic", "levels", F.coalesce("_child", "at").alias("at"),
            F.when(goes, F.col("m.filled")).otherwise(F.col("filled")).alias("filled"), "salt").distinct()
    return walks.where("filled").select("topic", F.expr("substring(at, 1, length(at) - 1)").alias("pattern")).distinct()


def topic_route(messages: DataFrame, rules: DataFrame, topic: str = "topic", spread: int = 8) -> DataFrame:
    """All matching rules of every message with a valid topic, numbered by priority (1 is highest).

    In a pattern ``+`` is one level that is not empty and ``#`` one or more levels, at the end or before further ones. Only
    distinct topics walk down the trie of the patterns, and the small result is joined back to the messages.
    """
    topics = staged(messages.select(F.col(topic).alias("topic")).filter(F.col("topic").rlike(TOPIC)).distinct())
    nodes, depth, hashes = _trie(rules)
    levels = F.size(F.split("topic", "/"))
    if hashes:
        depth = topics.agg(F.coalesce(F.max(levels), F.lit(0))).first()[0]
    topics = topics.filter(levels <= depth)
    matched = _walked(topics, nodes, depth, spread).join(rules.select("pattern", "priority", "qos"), "pattern")
    order = F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("p"), "pattern", "priority", "qos")))
    per_topic = matched.groupBy("topic").agg(order.alias("_rules"))
    numbered = per_topic.select(F.col("topic").alias(topic), F.posexplode("_rules").alias("_pos", "_rule")).select(
        topic, F.col("_rule.pattern").alias("pattern"), F.col("_rule.priority").alias("priority"),
        F.col("_rule.qos").alias("qos"), (F.col("_pos") + 1).alias("rank"))
    return messages.join(staged(numbered), topic)


_DAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]


def _day_set(days: list[str]) -> list[int]:
    wanted = set()
    for part in days:
        first, _, last = part.partition("-")
        a, b = _DAYS.index(first), _DAYS.index(last or first)
        wanted |= {i % 7 for i in range(a, b + 1 if b >= a else b + 8)}
    return sorted(wanted)


def _condition(name: str, value, ts: str) -> Column:
    """One entry of a policy's conditions as a Column."""
    if name == "time":
        now, parts = F.col(ts), []
        if "window" in value:
            start, end = value["window"].split("-")
            clock = F.date_format(now, "HH:mm")
            inside = [clock >= start, clock <= end]
            parts.append(reduce(operator.and_ if start <= end else operator.or_, inside))
        if "days" in value:
            parts.append(F.weekday(now).isin(_day_set(value["days"])))
        return reduce(operator.and_, parts, F.lit(True))
    if isinstance(value, list):
        return F.col(name).isin(value)
    if isinstance(value, str):
        compared = re.fullmatch(r"\s*(<=|>=|==|!=|<|>)\s*(-?[0-9.]+)\s*", value)
        if compared:
            op = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "==": operator.eq,
                  "!=": operator.ne}[compared.group(1)]
            return op(F.col(name), F.lit(float(compared.group(2))))
        if "*" in value or "?" in value:
            glob = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in value)
            return F.col(name).rlike(f"^{glob}$")
    return F.col(name) == F.lit(value)


def policy_match(requests: DataFrame, policies: list[dict], ts: str = "ts", source: str = "source_id") -> DataFrame:
    """Add ``rule_id`` and ``action`` of the first matching enabled policy by priority; no match is DENY.

    Policies are configuration, so they become one CASE expression: no join and no shuffle.
    """
    found = F.lit(None).cast("struct<rule_id:string,action:string>")
    active = sorted((p for p in policies if p.get("enabled", True)), key=lambda p: p["priority"])
    for policy in reversed(active):  # the outermost condition is met first; of equal priorities the first listed wins
        applies = reduce(operator.and_, [_condition(k, v, ts) for k, v in policy["conditions"].items()], F.lit(True))
        if policy.get("exceptions"):
            applies = applies & ~F.coalesce(F.col(source).isin(list(policy["exceptions"])), F.lit(False))
        hit = F.struct(F.lit(policy["id"]).alias("rule_id"), F.lit(policy["action"]).alias("action"))
        found = F.when(F.coalesce(applies, F.lit(False)), hit).otherwise(found)
    return requests.withColumn("_found", found).select(
        "*", F.col("_found.rule_id").alias("rule_id"), F.coalesce("_found.action", F.lit("DENY")).alias("action")).drop("_found")


def infer_forward(facts: DataFrame, rules: list[dict]) -> DataFrame:
    """Derive facts (relation, subject, value) until nothing new appears.

    A rule has ``if``: a list of {relation, value?} that must hold for the same subject, and ``then``:
    {relation, value?}. Without a value in ``then`` the subject itself is the value. Each round joins
    only on subjects that gained a fact in the round before. Rules and subjects are finite, so are the rounds.
    """
    columns = ["relation", "subject", "value"]
    fresh = staged(facts.select(*columns).distinct())
    parts = [fresh]
    while True:
        known = reduce(DataFrame.unionByName, parts)
        derived = None
        for rule in rules:
            subjects = None
            for need in rule["if"]:
                rows = known.filter(F.col("relation") == need["relation"])
                if "value" in need:
                    rows = rows.filter(F.col("value") == str(need["value"]))
                rows = rows.select("subject").distinct()
                subjects = rows if subjects is None else subjects.join(rows, "subject", "left_semi")
            subjects = subjects.join(fresh.select("subject").distinct(), "subject", "left_semi")
            head = rule["then"]
            value = F.lit(str(head["value"])) if "value" in head else F.col("subject")
            rows = subjects.select(F.lit(head["relation"]).alias("relation"), "subject", value.alias("value"))
            derived = rows if derived is None else derived.unionByName(rows)
        if derived is None:
            return known
        fresh = staged(derived.distinct().join(known, columns, "left_anti"))
        if fresh.isEmpty():
            return known
        parts.append(fresh)
        if len(parts) > 50:
            parts = [staged(reduce(DataFrame.unionByName, parts))]


def infer_backward(facts: DataFrame, rules: list[dict], hypotheses: DataFrame) -> DataFrame:
    """Hypotheses (relation, subject, value) that can be derived from the facts."""
    columns = ["relation", "subject", "value"]
    return hypotheses.join(infer_forward(facts, rules), columns, "left_semi")
