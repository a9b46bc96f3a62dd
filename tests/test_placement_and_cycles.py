"""Placement search and strongly connected components against plain searches."""

import collections
import random

import pytest

from opslake.operators import graph, placement

SHAPE = "node_id string, capacity map<string,double>, allocated map<string,double>"


def holds(capacity, allocated, demand):
    return all(r in capacity and (allocated or {}).get(r, 0.0) + v <= capacity[r] for r, v in demand.items())


@pytest.mark.parametrize("cells, k", [(27, 3), (8, 50)])
def test_placement_search(spark, cells, k):
    rng = random.Random(k)
    resources = ["cpu", "gpu", "memory"]

    def amounts(most, share):
        return {r: float(rng.randint(0, most)) for r in resources if rng.random() < share}

    # A third of the tasks ask for one thing, a third of the nodes are alike, and some ask for what no node names.
    nodes = [(f"n{i}", amounts(20, 0.9), amounts(6, 0.7)) for i in range(60)] + [(f"m{i}", {"cpu": 9.0, "gpu": 4.0}, None) for i in range(30)]
    tasks = [(i, amounts(16, 0.8)) for i in range(80)] + [(100 + i, {"cpu": 5.0}) for i in range(40)] + [(200, {}), (201, {"cpu": 99.0})]
    got = collections.defaultdict(list)
    found = placement.placement_search(spark.createDataFrame(tasks, "task_id int, demand map<string,double>"),
                                       spark.createDataFrame(nodes, SHAPE), resources, k=k, cells=cells)
    for r in found.orderBy("task_id", "rank").collect():
        got[r.task_id].append((r.slack, r.node_id))
    for task, demand in tasks:
        able = sorted((sum(c[r] - (a or {}).get(r, 0.0) for r in c), n) for n, c, a in nodes if holds(c, a, demand))
        assert got[task] == able[:k], task


def test_placement_search_without_rows(spark):
    tasks = spark.createDataFrame([(1, {"cpu": 1.0})], "task_id int, demand map<string,double>")
    nodes = spark.createDataFrame([("n", {"cpu": 1.0}, None)], SHAPE)
    assert placement.placement_search(tasks, nodes.where("false"), ["cpu"]).count() == 0
    assert placement.placement_search(tasks.where("false"), nodes, ["cpu"]).count() == 0
    assert [r.node_id for r in placement.placement_search(tasks, nodes, ["cpu"]).collect()] == ["n"]


def reached(edges):
    out = collections.defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    far = {}
    for v in {x for e in edges for x in e}:
        seen, stack = set(), list(out[v])
        while stack:
            w = stack.pop()
            if w not in seen:
                seen.add(w)
                stack.extend(out[w])
        far[v] = seen
    return far


def graph_of(spark, edges, dag="g"):
    return spark.createDataFrame([(dag, a, b) for a, b in edges], "dag_id string, node_id string, depends_on string")


@pytest.mark.parametrize("n, m", [(16, 30)])
def test_components_cycles_and_closure(spark, n, m):
    rng = random.Random(n)
    edges = {(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)}
    far = reached(edges)
    df = graph_of(spark, edges).unionByName(graph_of(spark, [("n1", "n2"), ("n2", "n1")], "other"))
    got = {(r.dag_id, r.node_id): r.component for r in graph.strong_components(df).collect()}
    want = {("g", v): min([w for w in far[v] if v in far[w]] + [v]) for v in far}
    assert got == {**want, ("other", "n1"): "n1", ("other", "n2"): "n1"}
    assert {(r.dag_id, r.node_id) for r in graph.dep_cycles(df).collect()} == {("g", v) for v in far if v in far[v]} | {("other", "n1"), ("other", "n2")}
    pairs = [(r.node_id, r.depends_on) for r in graph.dep_closure(df.where("dag_id = 'g'")).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(v, w) for v in far for w in far[v]}


def test_a_long_ring_with_a_long_tail(spark):
    ring = [(f"r{i:04}", f"r{(i + 1) % 3000:04}") for i in range(3000)]
    tail = [(f"t{i:04}", f"t{i + 1:04}") for i in range(1000)] + [("r0700", "t0000")]
    df = graph_of(spark, ring + tail)
    assert {r.node_id for r in graph.dep_cycles(df).collect()} == {a for a, _ in ring}
    answers, members = graph.condensed_closure(graph_of(spark, ring[:-1] + [(ring[-1][0], ring[0][0])] + [("r0700", "t0000")]))
    assert {(r.component, r.needs) for r in answers.collect()} == {("r0000", "r0000"), ("r0000", "t0000")}
    assert members.count() == 3001


def test_groups_of_any_size_close_without_broadcasts(spark, monkeypatch):
    """Small groups close in tasks and large ones by rounds, to the same pairs; neither sends tables through the driver."""
    rng = random.Random(5)
    dags = {f"g{i}": {(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(rng.randrange(1, 30))} for i in range(40)}
    df = spark.createDataFrame([(g, a, b) for g, edges in dags.items() for a, b in edges] + [("g0", None, "n1"), (None, "n1", "n1")],
                               "dag_id string, node_id string, depends_on string")
    far = {g: reached(edges) for g, edges in dags.items()}
    want = sorted((g, v, w) for g, ends in far.items() for v in ends for w in ends[v])
    for small in (15, graph.SMALL):
        monkeypatch.setattr(graph, "SMALL", small)
        found = graph.dep_closure(df)
        assert sorted(map(tuple, found.collect())) == want
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
        assert {tuple(r) for r in graph.dep_cycles(df).collect()} == {(g, v) for g, v, w in want if v == w} | {(None, "n1")}


def test_small_groups_take_no_rounds(spark, monkeypatch):
    df = graph_of(spark, [(f"n{i}", f"n{i + 1}") for i in range(200)] + [("n200", "n0")]).unionByName(graph_of(spark, [("a", "b")], "other"))
    for name in ("strong_components", "condensed_closure"):
        monkeypatch.setattr(graph, name, None)
    assert graph.dep_closure(df).count() == 201 * 201 + 1
    assert graph.dep_cycles(df).count() == 201
