"""Policies, topics, messages, inference, graphs and versions on small examples."""

import datetime as dt
import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from opslake.functions import scalars as S
from opslake.functions import tokens
from opslake.operators import graph, ordered, registry, rules, security, versions
from opslake.plans.q_security import POLICIES


def requests(spark, rows):
    """Rows (event_id, ts, source_ip, source_id, resource, auth_level[, port, region])."""
    return spark.createDataFrame([(*r, *[9000, "r0"][len(r) - 6:]) for r in rows],
                                 "event_id long, ts timestamp, source_ip string, source_id string, resource string, auth_level int, port int, region string")


MONDAY = dt.datetime(2024, 1, 1, 10)
NIGHT = MONDAY.replace(hour=23)


def test_policy_sample(spark):
    wednesday = MONDAY + dt.timedelta(days=2)
    rows = {
        (NIGHT, "crew-4", "/ledger/2/close", 0): ("night-close", "DENY"),
        (NIGHT, "crew-11", "/ledger/2/close", 0): (None, "DENY"),
        (NIGHT, None, "/ledger/a/b/close", None): ("night-close", "DENY"),
        (MONDAY.replace(hour=5, minute=10), "u", "/ledger//close", 0): ("night-close", "DENY"),
        (MONDAY.replace(hour=5, minute=11), "u", "/ledger//close", 0, 8001): ("low-port", "ALLOW"),
        (wednesday, "u", "/maps/view", 2, 8000, "r5"): ("far-views", "DENY"),
        (wednesday, "u", "/maps/view", 1, 8000, "r5"): ("low-port", "ALLOW"),
        (wednesday, "u", "/maps/click", 3, 9000, "r5"): (None, "DENY"),
        (MONDAY, "u", "/maps/click", 3, 8000, "r5"): ("weekend-maps", "ALERT"),
        (MONDAY, "crew-1", "/maps/click", 3, 8000, "r5"): ("low-port", "ALLOW"),
    }
    df = requests(spark, [(i, at, "ip", *rest) for i, (at, *rest) in enumerate(rows)])
    got = {r.event_id: (r.rule_id, r.action) for r in rules.policy_match(df, POLICIES).collect()}
    assert got == dict(enumerate(rows.values()))


def test_first_listed_policy_wins_a_tie(spark):
    tied = [{"id": name, "priority": 1, "action": "ALLOW", "conditions": {}} for name in ("first", "second")]
    df = requests(spark, [(1, MONDAY, "ip", "u", "/x", 1)])
    assert rules.policy_match(df, tied).first().rule_id == "first"
    assert rules.policy_match(df, [*tied, {**tied[0], "id": "urgent", "priority": 0}]).first().rule_id == "urgent"


def test_policy_condition_kinds(spark):
    df = requests(spark, [(1, MONDAY.replace(hour=23), "ip", "a.b", "/x", 5)])

    def matched(conditions):
        rule = {"id": "r", "priority": 1, "action": "ALLOW", "conditions": conditions}
        return rules.policy_match(df, [rule]).first().action == "ALLOW"

    assert matched({"auth_level": ">= 5"}) and not matched({"auth_level": "!= 5"}) and matched({"auth_level": 5})
    assert matched({"source_id": "a.?"}) and not matched({"source_id": "a?c"}) and matched({"resource": ["/x", "/y"]})
    assert matched({"time": {"window": "22:00-06:00"}}) and matched({"time": {"days": ["Sat-Mon"]}}) and not matched({"time": {"days": ["Tue"]}})
    assert matched({})


def test_firewall_block_does_not_extend(spark):
    def at(minutes):
        return NIGHT + dt.timedelta(minutes=minutes)

    shut, open_ = "/ledger/1/close", "/ledger/open"
    df = requests(spark, [(1, at(0), "a", "u", shut, 1), (2, at(30), "a", "u", shut, 1), (3, at(59), "a", "u", open_, 9, 8000),
                          (4, at(60), "a", "u", open_, 9, 8000), (5, at(61), "a", "u", shut, 1), (6, at(62), "b", "u", open_, 9, 8000),
                          (7, at(63), "c", "u", "/other", 9), (8, at(64), "c", "u", open_, 9, 8000)])
    for seconds in (600, 10 ** 6):
        out = security.firewall_blocks(df, POLICIES, bucket=ordered.by_time("ts", seconds))
        assert {r.event_id: (r.decision, r.reason) for r in out.collect()} == {
            1: ("BLOCK", "Policy"), 2: ("BLOCK", "Known threat"), 3: ("BLOCK", "Known threat"), 4: ("ALLOW", None), 5: ("BLOCK", "Policy"),
            6: ("ALLOW", None), 7: ("DENY", None), 8: ("ALLOW", None)}


def route_by_hand(topic, pattern):
    """Levels of the pattern against levels of the topic; # takes one or more."""
    def goes(p, t):
        if not p:
            return not t
        if p[0] == "#":
            return any(goes(p[1:], t[k:]) for k in range(1, len(t) + 1) if "/".join(t[:k]))
        return bool(t) and (p[0] == t[0] or p[0] == "+" and t[0] != "") and goes(p[1:], t[1:])
    return bool(re.fullmatch("[a-zA-Z0-9_/-]+", topic)) and goes(pattern.split("/"), topic.split("/"))


def test_topics_of_several_levels(spark):
    rng = np.random.default_rng(8)
    names = ["z0", "z1", "z2", "hum", ""]
    topics = sorted({"/".join(rng.choice(names, rng.integers(1, 6))) or "/" for _ in range(60)} | {"bad topic", "z0/hum/z1"})
    patterns = sorted({"/".join(rng.choice([*names, "+", "+"], rng.integers(1, 5))) + rng.choice(["", "/#"]) for _ in range(50)}
                      | {"#", "+", "+/#", "z0/#/hum", "#/z1", "+/+/#/+", "z0/#/#"})
    table = spark.createDataFrame([(p, len(p) % 4, i) for i, p in enumerate(patterns)], "pattern string, priority int, qos int")
    got = {}
    for r in rules.topic_route(spark.createDataFrame([(t,) for t in topics], "topic string"), table).orderBy("rank").collect():
        got.setdefault(r.topic, []).append((r.pattern, r.priority))
    want = {t: sorted(((p, len(p) % 4) for p in patterns if route_by_hand(t, p)), key=lambda x: (-x[1], x[0])) for t in topics}
    assert got == {t: w for t, w in want.items() if w}


def test_messages_made_from_the_schema(spark):
    """Of each kind: the whole message, and one with each field missing, of another type, or beside a field too many."""
    good = {"string": "s", "date-time": "2021-06-05 04:03:02", "integer": 4, "object": {"a": [1]}, "map<number>": {"x": 0.5, "y": 2},
            "array<string>": ["p", "q"]}
    bad = {"string": 7, "date-time": "noon", "integer": 1.5, "object": "o", "map<number>": {"x": "y"}, "array<string>": [1]}
    rows = [("note", "{}", ["kind: unsupported"])]
    for kind, fields in security.MESSAGE_FIELDS.items():
        whole = {f: good[shape] for f, shape in fields.items()}
        rows += [(kind, json.dumps(whole), []), (kind, "[1", ["body: not an object"]), (kind, json.dumps({**whole, "zz": 0}), ["zz: unexpected"])]
        for f, shape in fields.items():
            rows.append((kind, json.dumps({k: v for k, v in whole.items() if k != f}), [] if f in security.OPTIONAL_FIELDS else [f"{f}: required"]))
            rows.append((kind, json.dumps({**whole, f: bad[shape]}), [f"{f}: type"]))
    df = spark.createDataFrame([(i, k, b) for i, (k, b, _) in enumerate(rows)], "i int, kind string, body string")
    got = {r.i: (r.valid, r.errors) for r in security.message_validate(df).collect()}
    assert got == {i: (not errors, errors) for i, (_, _, errors) in enumerate(rows)}


def test_inference_chain(spark):
    facts = spark.createDataFrame([("heat", "kiln", "high"), ("heat", "vat", "low"), ("shift", "kiln", "night")],
                                  "relation string, subject string, value string")
    chain = [{"if": [{"relation": "heat", "value": "high"}, {"relation": "shift", "value": "night"}], "then": {"relation": "watched"}},
             {"if": [{"relation": "watched"}, {"relation": "heat"}], "then": {"relation": "visits", "value": 3}}]
    got = {tuple(r) for r in rules.infer_forward(facts, chain).collect()} - {tuple(r) for r in facts.collect()}
    assert got == {("watched", "kiln", "kiln"), ("visits", "kiln", "3")}
    asked = spark.createDataFrame([("visits", "kiln", "3"), ("visits", "vat", "3")], facts.schema)
    assert [r.subject for r in rules.infer_backward(facts, chain, asked).collect()] == ["kiln"]


def dag(spark, edges, extra=()):
    names = sorted({n for e in edges for n in e if n != "ghost"} | set(extra))
    nodes = spark.createDataFrame([(1, n, "task", 300, 0, 0) for n in names],
                                  "dag_id int, node_id string, task_type string, timeout long, retries int, memory long")
    return nodes, spark.createDataFrame([(1, a, b) for a, b in edges], "dag_id int, node_id string, depends_on string")


def test_levels_of_diamond_and_cycle(spark):
    nodes, edges = dag(spark, [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("x", "y"), ("y", "x"), ("z", "x"), ("d", "ghost")], ["s"])
    got = {r.node_id: r.level for r in graph.dag_levels(nodes, edges).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 2, "s": 0, "x": None, "y": None, "z": None}
    assert {r.node_id for r in graph.dep_cycles(edges).collect()} == {"x", "y"}
    assert [(r.node_id, r.error) for r in graph.dag_validate(nodes, edges).collect()] == [("d", "undefined:ghost")]
    assert graph.dag_validate(nodes, edges, strict=False).count() == 0
    assert {r.node_id for r in graph.removable(nodes, edges).collect()} == {"d", "s", "z"}


def test_closure_of_a_long_chain(spark):
    _, edges = dag(spark, [(f"n{i + 1:03}", f"n{i:03}") for i in range(100)])
    assert graph.dep_closure(edges).count() == 101 * 100 // 2


def test_validation_needs_id_type_and_timeout(spark):
    nodes = spark.createDataFrame([(1, "a", None, 1, None, None), (1, "b", "t", None, None, None), (1, "c", "t", 1, None, None)],
                                  "dag_id int, node_id string, task_type string, timeout long, retries int, memory long")
    edges = spark.createDataFrame([], "dag_id int, node_id string, depends_on string")
    assert {tuple(r) for r in graph.dag_validate(nodes, edges).select("node_id", "error").collect()} == {("a", "task_type"), ("b", "timeout")}


def test_levels_respect_random_edges(spark):
    rng = np.random.default_rng(5)
    pairs = {tuple(sorted(p, reverse=True)) for p in rng.integers(0, 40, (80, 2)).tolist() if p[0] != p[1]}
    nodes, edges = dag(spark, [(f"n{a:02}", f"n{b:02}") for a, b in pairs])
    level = {r.node_id: r.level for r in graph.dag_levels(nodes, edges).collect()}
    for name in level:
        below = [level[f"n{b:02}"] for a, b in pairs if f"n{a:02}" == name]
        assert level[name] == (max(below) + 1 if below else 0)


def test_versions_order_by_number(spark):
    df = spark.createDataFrame([("s", v) for v in ("1.9.0", "1.10.0", "1.10.0-rc1", "2.0.0", "bad", "1.9.0", "1.2.3")], "name string, version string")
    got = {r.version: (r.position, r.previous) for r in versions.version_history(df, ["name"]).collect()}
    assert got == {"1.2.3": (1, None), "1.9.0": (2, "1.2.3"), "1.10.0-rc1": (3, "1.9.0"), "1.10.0": (4, "1.10.0-rc1"), "2.0.0": (5, "1.10.0")}
    assert versions.latest_version(df, ["name"], ">=1.0.0 <2.0.0").first().version == "1.10.0"
    assert versions.latest_version(df, ["name"], "1.9.0").first().version == "2.0.0"
    assert versions.latest_version(df, ["name"]).first().version == "2.0.0"


def test_dependency_ranges(spark):
    have = spark.createDataFrame([("a", v) for v in ("1.0.0", "1.2.0", "2.10.0")] + [("junk", "one")], "name string, version string")
    cases = {"*": None, "1.0.0": None, ">=1.0.0 <2.0.0": None, ">=1.2.1,<2.10.0": "version", ">2.10.0": "version", "<=1.0.0": None,
             "<1.0.0": "version", "==1.2.0": None, "=1.2.1": "version", ">=2.9.0": None, ">=2.1.x <3.0.0": "range", ">1.0.0 <1.2.0": "version"}
    needs = spark.createDataFrame([("a", r) for r in cases] + [("junk", "*"), ("none", ">=0.0.1")], "needs string, version_range string")
    got = {(r.needs, r.version_range): r.problem for r in graph.dependency_check(needs, have).collect()}
    want = {("a", r): p for r, p in cases.items() if p} | {("junk", "*"): "missing", ("none", ">=0.0.1"): "missing"}
    assert got == want


def test_bump(spark):
    df = spark.createDataFrame([("1.2.0",), ("1.2.3",)], "v string")
    assert [r[0] for r in df.select(S.semver_bump(F.col("v"))).collect()] == ["1.3.0", "1.2.4"]


def test_scalars(spark):
    df = spark.createDataFrame([("10.0.0.123", "$SYS/a", "mail me@x.org at 10.1.2.3 or +49 170 123 4567"), ("ab", "a/b:c", ""), ("", "", None)],
                               "ip string, topic string, text string")
    got = [tuple(r) for r in df.select(S.mask_ip(F.col("ip")), S.topic_to_path(F.col("topic")), S.pii_mask(F.col("text"))).collect()]
    assert got == [("10.0.0.***", None, "mail <EMAIL> at <IP> or <PHONE>"), ("***", ["a", "b", "c"], ""), (None, [""], None)]
    assert spark.range(1).select(S.attrs_sanitize(F.lit(None).cast("map<string,string>"))).first()[0] == {}
    words = spark.createDataFrame([("id 42 at 0xff " + "a" * 32,)], "m string").select(
        S.log_signature(F.col("m")).alias("a"), S.log_signature(F.col("m"), True).alias("b")).first()
    assert tuple(words) == ("id <NUM> at <NUM>xff <HASH>", "id <NUM> at <HEX> <HASH>")


def test_tampered_ciphertext_and_random_nonce(spark):
    key = F.lit(b"0" * 32)
    df = spark.createDataFrame([("secret",), ("secret",)], "p string").select(tokens.aes_gcm_encrypt(F.col("p"), key))
    a, b = (r[0] for r in df.collect())
    assert a != b and len(a) == 6 + 28
    bad = bytes(a[:-1]) + bytes([a[-1] ^ 1])
    got = spark.createDataFrame([(bytearray(a),), (bytearray(bad),)], "s binary").select(tokens.aes_gcm_decrypt(F.col("s"), key)).collect()
    assert [r[0] for r in got] == ["secret", None]


def test_broken_tokens_give_null(spark):
    df = spark.createDataFrame([("a.b.c",), ("nope",), (None,)], "t string")
    out = df.select(tokens.jwt_claims(F.col("t")).alias("c")).select(F.col("c.sub").alias("s"), tokens.token_valid(F.col("c"), "a", "i", 0).alias("v"))
    assert [tuple(r) for r in out.collect()] == [(None, False)] * 3


def nodes_table(spark, rows):
    return spark.createDataFrame(rows, "service string, node_no int, node_id string, weight int, connections int, healthy boolean, latency double")


def test_balancers(spark):
    nodes = nodes_table(spark, [("s", 1, "node1", 3, 6, True, .2), ("s", 2, "node2", 2, 2, True, .1), ("s", 3, "node3", 0, 0, True, .1),
                                ("p", 1, "x", 1, 9, True, 1.0)] + [("p", i, f"y{i}", 1, i, False, 1.0) for i in range(2, 8)]
                        + [("dead", 1, "z", 1, 0, False, 1.0)])
    assert {r.service: r.node_id for r in registry.least_loaded(nodes).collect()} == {"s": "node2", "p": "y2"}
    assert {r.service: r.node_id for r in registry.best_endpoint(nodes).collect()}["s"] == "node2"
    calls = spark.createDataFrame([("s", k) for k in range(1, 11)], "service string, k long")
    got = [r.node_id for r in registry.wrr_assign(calls, nodes, "k").orderBy("k").collect()]
    assert got == ["node1", "node1", "node2", "node2", "node1"] * 2


def test_placement(spark):
    nodes = spark.createDataFrame([("n1", {"cpu": 4.0, "gpu": 1.0}, {"cpu": 3.0}), ("n2", {"cpu": 8.0}, {"cpu": 9.0})],
                                  "node_id string, capacity map<string,double>, allocated map<string,double>")
    asked = spark.createDataFrame([(1, "n1", {"cpu": 1.0}), (2, "n1", {"cpu": 1.5}), (3, "n1", {"cpu": .5, "gpu": 1.0}), (4, "n1", {"tpu": 1.0}),
                                   (5, "n9", {"cpu": .1})], "t int, node_id string, demand map<string,double>")
    assert {r.t: r.feasible for r in registry.feasible_placement(asked, nodes).collect()} == {1: True, 2: False, 3: True, 4: False, 5: False}
    assert [r.node_id for r in registry.over_allocated(nodes).collect()] == ["n2"]
    assert abs(registry.utilization(nodes).first()[0] - ((.75 + 0) / 2 + 9 / 8) / 2) < 1e-12
