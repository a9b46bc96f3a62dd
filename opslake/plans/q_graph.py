"""Graph, rule, registry and routing queries."""

import datetime as dt

from pyspark.sql import functions as F

from opslake.functions import scalars as S
from opslake.operators import graph, ordered, placement, registry, rules, versions
from opslake.plans.catalog import query

AS_OF = dt.datetime(2001, 8, 2)

# Known edges only, as a reusable part of the SQL below.
_DEFINED = """defined AS (SELECT DISTINCT e.dag_id, e.node_id, e.depends_on FROM v_dag_edges e
  JOIN v_dag_nodes n ON n.dag_id = e.dag_id AND n.node_id = e.depends_on)"""
_CLOSURE = f"""WITH RECURSIVE {_DEFINED}, closure AS (SELECT dag_id, node_id, depends_on FROM defined
  UNION SELECT c.dag_id, c.node_id, d.depends_on FROM closure c JOIN defined d ON c.dag_id = d.dag_id AND c.depends_on = d.node_id)"""


@query("dag_validate", """SELECT dag_id, node_id, 'task_type' AS error FROM v_dag_nodes WHERE NOT regexp_full_match(task_type, '[a-z0-9_]+')
UNION ALL SELECT dag_id, node_id, 'timeout' FROM v_dag_nodes WHERE timeout < 1
UNION ALL SELECT dag_id, node_id, 'retries' FROM v_dag_nodes WHERE retries < 0
UNION ALL SELECT dag_id, node_id, 'memory' FROM v_dag_nodes WHERE memory > 1024
UNION ALL SELECT dag_id, NULL, 'total_timeout' FROM v_dag_nodes GROUP BY dag_id HAVING sum(timeout) > 86400
UNION ALL SELECT e.dag_id, e.node_id, 'undefined:' || e.depends_on FROM v_dag_edges e LEFT JOIN v_dag_nodes n
  ON n.dag_id = e.dag_id AND n.node_id = e.depends_on WHERE n.node_id IS NULL""")
def _(t):
    return graph.dag_validate(t("v_dag_nodes"), t("v_dag_edges"))


@query("dag_levels", _CLOSURE + """, stuck AS (SELECT DISTINCT dag_id, node_id FROM (
    SELECT dag_id, node_id FROM closure WHERE node_id = depends_on
    UNION ALL SELECT c.dag_id, c.node_id FROM closure c JOIN closure s ON s.dag_id = c.dag_id AND s.node_id = c.depends_on
      AND s.node_id = s.depends_on)),
free AS (SELECT d.* FROM defined d ANTI JOIN stuck s ON s.dag_id = d.dag_id AND s.node_id = d.node_id),
paths AS (SELECT dag_id, node_id, depends_on, 1 AS hops FROM free
  UNION SELECT p.dag_id, p.node_id, f.depends_on, p.hops + 1 FROM paths p JOIN free f ON f.dag_id = p.dag_id AND f.node_id = p.depends_on)
SELECT n.dag_id, n.node_id, CASE WHEN any_value(s.node_id) IS NOT NULL THEN NULL ELSE coalesce(max(hops), 0) END AS level
FROM v_dag_nodes n LEFT JOIN paths p ON p.dag_id = n.dag_id AND p.node_id = n.node_id
LEFT JOIN stuck s ON s.dag_id = n.dag_id AND s.node_id = n.node_id GROUP BY n.dag_id, n.node_id""")
def _(t):
    return graph.dag_levels(t("v_dag_nodes"), t("v_dag_edges"))


@query("dep_closure", _CLOSURE + " SELECT * FROM closure")
def _(t):
    return graph.dep_closure(graph.defined_edges(t("v_dag_nodes"), t("v_dag_edges")))


@query("dep_cycles", _CLOSURE + " SELECT dag_id, node_id FROM closure WHERE node_id = depends_on")
def _(t):
    return graph.dep_cycles(t("v_dag_edges"))


@query("dependency_check", """WITH num AS (SELECT DISTINCT name, version, string_split(version, '.') AS p FROM v_skill_versions
  WHERE regexp_full_match(version, '[0-9]+\\.[0-9]+\\.[0-9]+')),
v AS (SELECT name, version, CAST(p[1] AS INT) * 1000000 + CAST(p[2] AS INT) * 1000 + CAST(p[3] AS INT) AS k FROM num),
n AS (SELECT *, CAST(regexp_extract(version_range, '>=([0-9]+)', 1) AS INT) * 1000000
  + CAST(regexp_extract(version_range, '>=[0-9]+\\.([0-9]+)', 1) AS INT) * 1000 AS lo FROM v_skill_needs),
j AS (SELECT n.row_id, any_value(n.name) AS name, any_value(n.needs) AS needs, any_value(n.version_range) AS version_range,
  count(*) FILTER (v.k >= n.lo AND v.k < 3000000) AS fits FROM n LEFT JOIN v ON v.name = n.needs GROUP BY n.row_id)
SELECT row_id, name, needs, version_range, CASE WHEN EXISTS (SELECT 1 FROM num s WHERE s.name = j.needs)
  THEN 'version' ELSE 'missing' END AS problem FROM j WHERE fits = 0""")
def _(t):
    return graph.dependency_check(t("v_skill_needs"), t("v_skill_versions"))


@query("dependency_drift", """WITH env AS (SELECT name AS lib, max(row_id) AS r FROM v_skill_versions GROUP BY name),
have AS (SELECT e.lib, v.version FROM env e JOIN v_skill_versions v ON v.row_id = e.r)
SELECT n.row_id, n.needs AS lib, '1.0.0' AS version, coalesce(h.version, '0.0.0') AS installed
FROM v_skill_needs n LEFT JOIN have h ON h.lib = n.needs WHERE coalesce(h.version, '0.0.0') <> '1.0.0'""")
def _(t):
    have = t("v_skill_versions").groupBy(F.col("name").alias("lib")).agg(F.max_by("version", "row_id").alias("version"))
    needs = t("v_skill_needs").select("row_id", F.col("needs").alias("lib"), F.lit("1.0.0").alias("version"))
    return graph.dependency_drift(needs, have).select("row_id", "lib", "version", "installed")


@query("reject_dependents", """SELECT n.dag_id, n.node_id, count(*) AS dependents FROM v_dag_nodes n JOIN v_dag_edges e
ON e.dag_id = n.dag_id AND e.depends_on = n.node_id GROUP BY n.dag_id, n.node_id""")
def _(t):
    return graph.reject_dependents(t("v_dag_nodes").select("dag_id", "node_id"), t("v_dag_edges"))


@query("semver_parse", """WITH v AS (SELECT row_id, version, string_split(version, '.') AS p,
  regexp_full_match(version, '[0-9]+\\.[0-9]+\\.[0-9]+(-[a-zA-Z0-9.]+)?(\\+[a-zA-Z0-9.]+)?') AS valid FROM v_skill_versions)
SELECT row_id, valid, CASE WHEN valid THEN concat_ws('.', TRY_CAST(p[1] AS INT), TRY_CAST(p[2] AS INT), TRY_CAST(p[3] AS INT)) END AS key,
CASE WHEN valid AND p[3] = '0' THEN p[1] || '.' || (TRY_CAST(p[2] AS INT) + 1) || '.0'
  WHEN valid THEN p[1] || '.' || p[2] || '.' || (TRY_CAST(p[3] AS INT) + 1) END AS bumped,
valid AND (TRY_CAST(p[1] AS INT) > 1 OR TRY_CAST(p[1] AS INT) = 1 AND TRY_CAST(p[2] AS INT) >= 5) AS matches FROM v""")
def _(t):
    v = F.col("version")
    return t("v_skill_versions").select(
        "row_id", S.semver_valid(v).alias("valid"), F.array_join(S.semver_key(v).cast("array<string>"), ".").alias("key"),
        F.when(S.semver_valid(v), S.semver_bump(v)).alias("bumped"),
        F.coalesce(S.semver_matches(v, ">=1.5.0"), F.lit(False)).alias("matches"))


_SORTED = """v AS (SELECT DISTINCT name, version FROM v_skill_versions WHERE regexp_full_match(version, '[0-9]+\\.[0-9]+\\.[0-9]+')),
k AS (SELECT *, CAST(string_split(version, '.')[1] AS INT) * 1000000 + CAST(string_split(version, '.')[2] AS INT) * 1000
  + CAST(string_split(version, '.')[3] AS INT) AS k FROM v)"""


@query("version_history", f"""WITH {_SORTED} SELECT name, version, row_number() OVER (PARTITION BY name ORDER BY k) AS position,
lag(version) OVER (PARTITION BY name ORDER BY k) AS previous FROM k""")
def _(t):
    return versions.version_history(t("v_skill_versions"), ["name"])


@query("latest_version", f"WITH {_SORTED} SELECT name, arg_max(version, k) AS version FROM k WHERE k >= 1001000 GROUP BY name")
def _(t):
    return versions.latest_version(t("v_skill_versions"), ["name"], ">=1.1.0")


@query("retention_keep_n", """SELECT row_id, name FROM (SELECT row_id, name, row_number() OVER (PARTITION BY name ORDER BY row_id DESC) AS n
FROM v_skill_versions) WHERE n > 3""")
def _(t):
    rows = t("v_skill_versions").select("row_id", "name")
    return versions.retention_expired(rows, ["name"], [F.col("row_id").desc()], 3, ["row_id"])


@query("rule_content_check", """SELECT doc_id, CASE WHEN length(content) > 1048576 THEN 'size'
WHEN regexp_matches(content, '(?i)(exec|system|eval)\\(') THEN 'forbidden' END AS violation,
CASE WHEN length(content) > 1048576 THEN 'size' WHEN regexp_matches(content, '(?i)exec\\(|os\\.system') THEN 'forbidden' END AS load_violation
FROM v_rule_texts""")
def _(t):
    c = F.col("content")
    return t("v_rule_texts").select("doc_id", S.rule_violation(c).alias("violation"),
                                    S.rule_violation(c, S.FORBIDDEN_RULE_CALL).alias("load_violation"))


@query("topic_bridge", """SELECT event_id, array_to_string(string_split(topic, '/'), '|') AS path, topic AS back FROM v_topics""")
def _(t):
    out = t("v_topics").select("event_id", S.topic_to_path(F.col("topic")).alias("path"))
    return out.select("event_id", F.array_join("path", "|").alias("path"), S.path_to_topic(F.col("path")).alias("back"))


@query("topic_route", """SELECT event_id, topic, pattern, priority, qos,
CAST(row_number() OVER (PARTITION BY event_id ORDER BY priority DESC, pattern) AS INT) AS rank FROM v_topics t JOIN v_topic_rules r
ON regexp_full_match(topic, '[a-zA-Z0-9_/-]+') AND regexp_full_match(topic, replace(replace(pattern, '+', '[^/]+'), '#', '.+'))""")
def _(t):
    return rules.topic_route(t("v_topics"), t("v_topic_rules"))


_FACT_RULES = [
    {"if": [{"relation": "agent_status", "value": "busy"}], "then": {"relation": "loaded", "value": "yes"}},
    {"if": [{"relation": "loaded", "value": "yes"}, {"relation": "rich", "value": "yes"}], "then": {"relation": "escalate"}},
    {"if": [{"relation": "escalate"}], "then": {"relation": "requires_approval", "value": "manager"}},
]
_FACTS = """facts AS (SELECT 'agent_status' AS relation, id AS subject, status AS value FROM v_agents
UNION ALL SELECT 'rich', id, CASE WHEN score > 5000 THEN 'yes' ELSE 'no' END FROM v_agents)"""
_DERIVED = """SELECT * FROM facts UNION SELECT 'loaded', id, 'yes' FROM v_agents WHERE status = 'busy'
UNION SELECT 'escalate', id, id FROM v_agents WHERE status = 'busy' AND score > 5000
UNION SELECT 'requires_approval', id, 'manager' FROM v_agents WHERE status = 'busy' AND score > 5000"""


def _facts(t):
    agents = t("v_agents")
    return agents.select(F.lit("agent_status").alias("relation"), F.col("id").alias("subject"), F.col("status").alias("value")).unionByName(
        agents.select(F.lit("rich").alias("relation"), F.col("id").alias("subject"),
                      F.when(F.col("score") > 5000, "yes").otherwise("no").alias("value")))


@query("infer_forward", f"WITH {_FACTS} {_DERIVED}")
def _(t):
    return rules.infer_forward(_facts(t), _FACT_RULES)


@query("infer_backward", "SELECT 'requires_approval' AS relation, id AS subject, 'manager' AS value FROM v_agents WHERE status = 'busy' AND score > 5000")
def _(t):
    asked = t("v_agents").select(F.lit("requires_approval").alias("relation"), F.col("id").alias("subject"),
                                 F.lit("manager").alias("value"))
    return rules.infer_backward(_facts(t), _FACT_RULES, asked)


@query("service_registry_view", """WITH l AS (SELECT service AS name, path AS service_id, method, ts, event_id,
  row_number() OVER (PARTITION BY service, path ORDER BY ts DESC, event_id DESC) AS n FROM v_requests)
SELECT name, service_id, epoch_us(ts) AS at_us FROM l WHERE n = 1 AND method = 'GET'
AND epoch_us(ts) + 86400000000 > epoch_us(TIMESTAMP '2024-01-31 00:00:00')""")
def _(t):
    leases = t("v_requests").select(
        F.col("service").alias("name"), F.col("path").alias("service_id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("endpoint"),
        "ts", F.lit(86400).alias("ttl"), F.create_map(F.lit("method"), F.col("method")).alias("metadata"))
    out = registry.service_registry_view(leases, dt.datetime(2024, 1, 31), filters={"method": "GET"})
    return out.select("name", "service_id", F.unix_micros("ts").alias("at_us"))


@query("best_endpoint", """SELECT service, node_id FROM (SELECT service, node_id, row_number() OVER (PARTITION BY service
ORDER BY latency, weight DESC, node_id) AS n FROM v_nodes) WHERE n = 1""")
def _(t):
    return registry.best_endpoint(t("v_nodes"))


_CANDIDATES = """s AS (SELECT service, count(*) FILTER (healthy) / count(*) AS share FROM v_nodes GROUP BY service),
c AS (SELECT n.* FROM v_nodes n JOIN s ON s.service = n.service WHERE share > 0 AND (healthy OR share < 0.2))"""


@query("least_loaded", f"""WITH {_CANDIDATES} SELECT service, node_id, round(connections / weight, 9) AS load FROM (SELECT *,
row_number() OVER (PARTITION BY service ORDER BY connections / weight, node_no) AS n FROM c) WHERE n = 1""")
def _(t):
    return registry.least_loaded(t("v_nodes")).select("service", "node_id", F.round("load", 9).alias("load"))


@query("wrr_assign", f"""WITH {_CANDIDATES}, r AS (SELECT service, node_id, sum(weight) OVER (PARTITION BY service ORDER BY node_no) AS hi,
  weight, sum(weight) OVER (PARTITION BY service) AS total FROM c),
q AS (SELECT event_id, service, row_number() OVER (PARTITION BY service ORDER BY ts, event_id) AS k FROM v_requests)
SELECT event_id, q.service, k, node_id FROM q JOIN r ON r.service = q.service AND k % total >= hi - weight AND k % total < hi""")
def _(t):
    requests = t("v_requests").select("event_id", "service", "ts")
    numbered = ordered.ranked(requests, ["service"], [F.col("ts"), F.col("event_id")],
                              ordered.fit_time(requests, ["service"], "ts"), "k")
    return registry.wrr_assign(numbered, t("v_nodes"), "k").select("event_id", "service", "k", "node_id")


def _resource_nodes(t):
    return t("v_node_resources").groupBy("node_id").agg(
        F.map_from_entries(F.collect_list(F.struct("resource", "capacity"))).alias("capacity"),
        F.map_from_entries(F.collect_list(F.struct("resource", "allocated"))).alias("allocated"))


@query("over_allocated", "SELECT DISTINCT node_id FROM v_node_resources WHERE allocated > capacity")
def _(t):
    return registry.over_allocated(_resource_nodes(t)).select("node_id")


@query("utilization", """SELECT round(avg(u), 9) AS utilization FROM (SELECT node_id, avg(allocated / capacity) AS u
FROM v_node_resources GROUP BY node_id)""")
def _(t):
    return registry.utilization(_resource_nodes(t)).select(F.round("utilization", 9).alias("utilization"))


@query("utilization_vector", """SELECT node_id, round(max(allocated / capacity) FILTER (resource = 'cpu'), 9) AS cpu,
round(max(allocated / capacity) FILTER (resource = 'gpu'), 9) AS gpu, round(max(allocated / capacity) FILTER (resource = 'memory'), 9) AS memory
FROM v_node_resources GROUP BY node_id""")
def _(t):
    out = registry.utilization_vector(_resource_nodes(t), ["cpu", "gpu", "memory"])
    return out.select("node_id", *[F.round(F.col("utilization")[i], 9).alias(n) for i, n in enumerate(["cpu", "gpu", "memory"])])


def _demand():
    return F.create_map(F.lit("cpu"), F.col("cpu"), F.lit("gpu"), F.col("gpu"), F.lit("memory"), F.col("memory"))


@query("feasible_placement", """SELECT p.task_no, p.node_id, p.line_no, count(*) FILTER (allocated + CASE resource WHEN 'cpu' THEN cpu
  WHEN 'gpu' THEN gpu ELSE memory END <= capacity) = 3 * count(DISTINCT p.i) AS feasible
FROM (SELECT *, row_number() OVER () AS i FROM v_proposals) p JOIN v_node_resources r ON r.node_id = p.node_id
GROUP BY p.i, p.task_no, p.node_id, p.line_no""")
def _(t):
    proposals = t("v_proposals").select("task_no", "node_id", "line_no", _demand().alias("demand"))
    return registry.feasible_placement(proposals, _resource_nodes(t)).select("task_no", "node_id", "line_no", "feasible")


@query("placement_search", """WITH free AS (SELECT node_id, max(capacity - allocated) FILTER (resource = 'cpu') AS c,
  max(capacity - allocated) FILTER (resource = 'gpu') AS g, max(capacity - allocated) FILTER (resource = 'memory') AS m
  FROM v_node_resources GROUP BY node_id),
wants AS (SELECT DISTINCT cpu, gpu, memory FROM v_proposals),
best AS (SELECT cpu, gpu, memory, node_id, CAST(c + g + m AS DOUBLE) AS slack,
  CAST(row_number() OVER (PARTITION BY cpu, gpu, memory ORDER BY c + g + m, node_id) AS INT) AS rank
  FROM wants JOIN free ON c >= cpu AND g >= gpu AND m >= memory)
SELECT task_no, line_no, rank, b.node_id, slack FROM v_proposals p
JOIN best b ON b.cpu = p.cpu AND b.gpu = p.gpu AND b.memory = p.memory WHERE rank <= 3""")
def _(t):
    tasks = t("v_proposals").select("task_no", "line_no", _demand().alias("demand"))
    return placement.placement_search(tasks, _resource_nodes(t), ["cpu", "gpu", "memory"], task=["task_no", "line_no"])


@query("task_features", """SELECT task_id, priority / 10 AS priority_norm,
round((epoch_us(deadline) - epoch_us(TIMESTAMP '2001-08-02 00:00:00')) / 3.6e9, 6) AS hours_left, CAST(retries + 0.5 AS DOUBLE) AS total_demand
FROM v_tasks""")
def _(t):
    tasks = t("v_tasks").withColumn("demand", F.create_map(F.lit("cpu"), F.col("retries").cast("double"), F.lit("gpu"), F.lit(0.5)))
    return registry.task_features(tasks, AS_OF).select(
        "task_id", "priority_norm", F.round("hours_left", 6).alias("hours_left"), F.round("total_demand", 6).alias("total_demand"))
