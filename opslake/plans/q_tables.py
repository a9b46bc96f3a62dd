"""Table maintenance and queue queries."""

import datetime as dt

from pyspark.sql import functions as F

from opslake.functions import scalars as S
from opslake.operators import queues, tables
from opslake.plans.catalog import query

AS_OF = dt.datetime(2001, 8, 2)
_AT = "TIMESTAMP '2001-08-02 00:00:00'"
_US = "epoch_us(TIMESTAMP '2001-08-02 00:00:00')"

_UPSERT = """, judged AS (
  SELECT i.*, c.version AS stored, c.agent_id IS NULL OR c.version = i.version AS fits
  FROM v_state_incoming i LEFT JOIN v_state_current c ON c.agent_id = i.agent_id),
picked AS (SELECT *, fits AND row_number() OVER (PARTITION BY agent_id ORDER BY fits DESC, version, seq) = 1 AS wins FROM judged)"""


def _with(sql):
    return "WITH unused AS (SELECT 1)" + sql


MERGED = _with(_UPSERT + """
SELECT coalesce(c.agent_id, p.agent_id) AS agent_id, coalesce(p.status, c.status) AS status,
  CASE WHEN p.agent_id IS NULL THEN c.version ELSE p.version + 1 END AS version
FROM v_state_current c FULL JOIN (SELECT * FROM picked WHERE wins) p ON c.agent_id = p.agent_id""")


@query("versioned_upsert", MERGED)
def _(t):
    return tables.versioned_upsert(t("v_state_current"), t("v_state_incoming"))[0]


@query("versioned_upsert_conflicts", _with(_UPSERT + """
SELECT agent_id, status, version, seq, stored AS stored_version FROM picked WHERE NOT wins"""))
def _(t):
    return tables.versioned_upsert(t("v_state_current"), t("v_state_incoming"))[1]


@query("dlq_upsert", """SELECT coalesce(c.message_id, i.message_id) AS message_id,
  coalesce(c.original_topic, i.original_topic) AS original_topic, coalesce(c.failure_reason, i.failure_reason) AS failure_reason,
  CASE WHEN i.message_id IS NULL THEN c.retries ELSE i.retries END AS retries,
  CASE WHEN i.message_id IS NULL THEN c.permanent_failure ELSE i.permanent_failure END AS permanent_failure
FROM (SELECT * REPLACE (CASE WHEN failure_reason = 'P' THEN 'old-' ELSE '' END || message_id AS message_id) FROM v_dead_letters) c FULL JOIN
  (SELECT CASE WHEN failure_reason = 'F' THEN 'new-' ELSE '' END || message_id AS message_id, 'new' AS original_topic,
   'again' AS failure_reason, retries + 1 AS retries, true AS permanent_failure FROM v_dead_letters) i ON c.message_id = i.message_id""")
def _(t):
    letters = t("v_dead_letters").select("message_id", "original_topic", "failure_reason", "ts", "retries",
                                         "last_attempt", "permanent_failure")


    def renamed(reason, mark):
        return letters.withColumn("message_id", F.when(F.col("failure_reason") == reason, F.concat(F.lit(mark), "message_id"))
                                  .otherwise(F.col("message_id")))

    incoming = renamed("F", "new-").withColumns({
        "original_topic": F.lit("new"), "failure_reason": F.lit("again"), "retries": F.col("retries") + 1,
        "permanent_failure": F.lit(True)})
    out = queues.dlq_upsert(renamed("P", "old-"), incoming, "ts")
    return out.select("message_id", "original_topic", "failure_reason", "retries", "permanent_failure")


@query("dlq_retry_pass", f"""SELECT m.message_id, retries + 1 AS retries, {_US} AS last_us,
  permanent_failure OR retries + 1 >= 5 AS permanent_failure
FROM v_dead_letters m JOIN v_delivery d ON m.message_id = d.message_id WHERE NOT delivered""")
def _(t):
    left, _alerts = queues.dlq_retry_pass(t("v_dead_letters"), t("v_delivery"), AS_OF)
    return left.select("message_id", "retries", F.unix_micros("last_attempt").alias("last_us"), "permanent_failure")


@query("dlq_alerts", """SELECT m.message_id, retries + 1 >= 5 AS is_final,
  CASE WHEN retries + 1 >= 5 THEN 'PERMANENT FAILURE' ELSE 'WARNING' END || ': Message ' || m.message_id || ' failed ' ||
  (retries + 1) || ' times. Last error: ' || failure_reason AS text,
  '{"message_id":"' || m.message_id || '","topic":"' || original_topic || '","retries":' || (retries + 1) ||
  ',"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '"}' AS metadata
FROM v_dead_letters m JOIN v_delivery d ON m.message_id = d.message_id WHERE NOT delivered AND retries + 1 >= 3""")
def _(t):
    return queues.dlq_retry_pass(t("v_dead_letters"), t("v_delivery"), AS_OF)[1]


_RETRIABLE = f"""v_dead_letters WHERE NOT permanent_failure AND retries < 5 AND
(last_attempt IS NULL OR last_attempt < {_AT} - INTERVAL '5832 milliseconds')"""


@query("retriable_messages", f"SELECT message_id, epoch_us(ts) AS at_us, retries FROM {_RETRIABLE} ORDER BY ts, message_id LIMIT 100")
def _(t):
    return queues.retriable_messages(t("v_dead_letters"), AS_OF).select(
        "message_id", F.unix_micros("ts").alias("at_us"), "retries")


@query("dlq_age", f"SELECT ({_US} - min(epoch_us(ts))) / 1e6 AS age_s FROM {_RETRIABLE}")
def _(t):
    return queues.dlq_age(t("v_dead_letters"), AS_OF)


@query("dlq_cleanup", f"SELECT message_id, original_topic FROM v_dead_letters WHERE ts >= {_AT} - INTERVAL '30' DAY")
def _(t):
    return queues.dlq_cleanup(t("v_dead_letters"), AS_OF).select("message_id", "original_topic")


@query("next_tasks", """SELECT task_id, priority, retries FROM v_tasks WHERE status = 'pending'
ORDER BY priority, retries, last_attempt NULLS FIRST, task_id LIMIT 50""")
def _(t):
    return queues.next_tasks(t("v_tasks"), 50).select("task_id", "priority", "retries")


@query("task_life_cycle", f"""SELECT task_id, CASE WHEN retries % 2 = 0 AND status = 'pending' THEN 'completed'
  WHEN status = 'pending' THEN 'processing' ELSE status END AS status,
  CASE WHEN status = 'pending' THEN {_US} ELSE epoch_us(last_attempt) END AS attempt_us FROM v_tasks""")
def _(t):
    tasks = t("v_tasks")
    picked = tasks.filter("status = 'pending'")
    done = queues.complete_tasks(queues.start_tasks(tasks, picked, AS_OF), picked.filter("retries % 2 = 0"), AS_OF)
    return done.select("task_id", "status", F.unix_micros("last_attempt").alias("attempt_us"))


@query("task_fail_pass", f"""SELECT task_id, CASE WHEN retries >= 3 THEN 'failed' ELSE 'pending' END AS status,
  CASE WHEN retries >= 3 THEN retries ELSE retries + 1 END AS retries,
  CASE WHEN retries >= 3 THEN epoch_us(next_attempt) ELSE {_US} + CAST(pow(1.5, retries) * 1000000 AS BIGINT) END AS next_us,
  {_US} AS updated_us FROM v_tasks WHERE status = 'processing'""")
def _(t):
    out = queues.task_fail_pass(t("v_tasks").filter("status = 'processing'"), AS_OF)
    return out.select("task_id", "status", "retries", F.unix_micros("next_attempt").alias("next_us"),
                      F.unix_micros("updated_at").alias("updated_us"))


@query("task_timeouts", f"""SELECT task_id, priority FROM v_tasks WHERE status = 'processing'
AND updated_at < {_AT} - INTERVAL '300' SECOND""")
def _(t):
    return queues.task_timeouts(t("v_tasks"), AS_OF).select("task_id", "priority")


@query("dynamic_priority", f"""SELECT task_id, priority + CAST(trunc(({_US} - epoch_us(created_at)) / 3.6e9 * 0.5) AS INT)
+ retries * 2 AS adjusted_priority FROM v_tasks""")
def _(t):
    return t("v_tasks").select("task_id", queues.dynamic_priority(AS_OF).alias("adjusted_priority"))


@query("deadline_misses", f"""SELECT count(*) FILTER (deadline < {_AT}) AS misses, count(*) AS open
FROM v_tasks WHERE status IN ('pending', 'processing')""")
def _(t):
    return queues.deadline_misses(t("v_tasks"), AS_OF)


@query("completion_score", f"""SELECT round(sum(priority * 0.3 + CASE WHEN {_AT} > deadline THEN -1 ELSE 0 END)::DOUBLE, 4) AS score
FROM v_tasks WHERE status = 'completed'""")
def _(t):
    return queues.completion_score(t("v_tasks"), AS_OF).select(F.round("score", 4).alias("score"))


@query("live_rows", "SELECT id, tenant_id, status FROM v_agents WHERE NOT is_deleted AND tenant_id = 7")
def _(t):
    return tables.live_rows(t("v_agents"), 7).select("id", "tenant_id", "status")


@query("find_by", "SELECT id, name FROM v_agents WHERE status = 'busy' AND tenant_id = 3")
def _(t):
    return tables.find_by(t("v_agents"), status="busy", tenant_id=3).select("id", "name")


@query("apply_filters", "SELECT id, score FROM v_agents WHERE score >= 1000 AND status IN ('idle', 'busy')")
def _(t):
    allowed = {"min_score": ("score", "ge"), "status": ("status", "in")}
    params = {"min_score": 1000, "status": ["idle", "busy"], "unknown": 1}
    return tables.apply_filters(t("v_agents"), allowed, params).select("id", "score")


@query("metadata_filter", """SELECT vec_id FROM embeddings WHERE label IN (1, 3, 5)""")
def _(t):
    body = t("embeddings").select("vec_id", F.to_json(F.struct("label", F.lit("x").alias("kind"))).alias("metadata"))
    keep = tables.metadata_filter({"label": ["1", "3", "5"], "kind": "x"}, tables.json_field("metadata"))
    return body.filter(keep).select("vec_id")


@query("ttl_live", """SELECT event_id, user_id FROM events WHERE epoch_us(ts) + (event_id % 90) * 86400000000
> epoch_us(TIMESTAMP '2024-01-31 00:00:00')""")
def _(t):
    docs = t("events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("saved_at"),
                              (F.col("event_id") % 90 * 86400).alias("ttl"))
    return tables.ttl_live(docs, dt.datetime(2024, 1, 31), ttl_s="ttl").select("event_id", "user_id")


@query("list_agents", """SELECT id, status FROM v_agents WHERE upper(status) = 'BUSY' AND id > 'a2' ORDER BY id LIMIT 25""")
def _(t):
    return tables.list_agents(t("v_agents"), "status=BUSY", 25, "a2").select("id", "status")


@query("page", "SELECT id, score FROM v_agents ORDER BY score DESC, id LIMIT 20 OFFSET 40")
def _(t):
    return tables.page(t("v_agents"), [F.col("score").desc(), F.col("id")], 3, 20).select("id", "score")


@query("page_info", "SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM v_agents")
def _(t):
    return tables.page_info(t("v_agents"), 20)


@query("keyset_page", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 100")
def _(t):
    return tables.keyset_page(t("orders"), "o_orderkey", 100, 500).select("o_orderkey", "o_custkey")


@query("agent_active", "SELECT id, status <> 'terminated' AS active, status IN ('idle', 'busy', 'terminated') AS valid FROM v_agents")
def _(t):
    return t("v_agents").select("id", tables.agent_active(F.col("status")).alias("active"),
                                tables.one_of("status", ["idle", "busy", "terminated"]).alias("valid"))


@query("check_constraints", """SELECT id, 'ck_agent_status' AS "constraint" FROM v_agents WHERE status NOT IN ('idle', 'busy', 'terminated')
UNION ALL SELECT id, 'score_range' FROM v_agents WHERE NOT score >= 0
UNION ALL SELECT id, 'id_length' FROM v_agents WHERE length(id) > 3""")
def _(t):
    return tables.check_constraints(t("v_agents"), "id", {
        "name_required": tables.not_null("name"), "id_length": tables.max_length("id", 3),
        "ck_agent_status": tables.one_of("status", ["idle", "busy", "terminated"]), "score_range": F.col("score") >= 0})


@query("illegal_transitions", """WITH m AS (SELECT agent_id, seq, state,
  coalesce(lag(state) OVER (PARTITION BY agent_id ORDER BY seq), 'CREATED') AS previous FROM v_lifecycle)
SELECT agent_id, seq, previous, state FROM m WHERE previous || '>' || state NOT IN ('CREATED>INITIALIZED', 'CREATED>ERROR',
 'INITIALIZED>RUNNING', 'INITIALIZED>STOPPED', 'RUNNING>PAUSED', 'RUNNING>STOPPED', 'RUNNING>ERROR', 'PAUSED>RUNNING',
 'PAUSED>STOPPED', 'ERROR>STOPPED')""")
def _(t):
    out = tables.illegal_transitions(t("v_lifecycle"))
    return out.select("agent_id", "seq", "previous", "state")


@query("active_clients", """SELECT agent_id, epoch_us(max(ts)) AS last_us,
max(ts) > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '3600' SECOND AS active FROM v_lifecycle GROUP BY agent_id""")
def _(t):
    out = tables.active_clients(t("v_lifecycle"), dt.datetime(2024, 1, 31), 3600)
    return out.select("agent_id", F.unix_micros("last_seen").alias("last_us"), "active")


@query("soft_delete", """SELECT id, is_deleted OR status = 'terminated' AS is_deleted FROM v_agents""")
def _(t):
    return tables.soft_delete(t("v_agents"), F.col("status") == "terminated").select("id", "is_deleted")


@query("purge", "SELECT id FROM v_agents WHERE status <> 'unknown'")
def _(t):
    agents = t("v_agents")
    return tables.purge(agents, agents.filter("status = 'unknown'"), "id").select("id")


@query("delete_by_ids", "SELECT agent_id, version FROM v_state_current WHERE agent_id NOT IN (SELECT agent_id FROM v_state_incoming WHERE status = 'P')")
def _(t):
    gone = t("v_state_incoming").filter("status = 'P'")
    return tables.delete_by_ids(t("v_state_current"), gone, "agent_id").select("agent_id", "version")


@query("audit_diff", """WITH n AS (SELECT id, status, CASE WHEN score < 0 THEN 'low' ELSE name END AS name,
  CASE WHEN status = 'busy' THEN tenant_id + 1 ELSE tenant_id END AS tenant_id FROM v_agents)
SELECT 'UPDATE' AS action, a.id AS model_id, 'name' AS "column", a.name AS old, n.name AS new FROM v_agents a JOIN n USING (id) WHERE a.name <> n.name
UNION ALL SELECT 'UPDATE', a.id, 'tenant_id', CAST(a.tenant_id AS VARCHAR), CAST(n.tenant_id AS VARCHAR)
FROM v_agents a JOIN n USING (id) WHERE a.tenant_id <> n.tenant_id""")
def _(t):
    old = t("v_agents")
    new = old.withColumns({"name": F.when(F.col("score") < 0, "low").otherwise(F.col("name")),
                           "tenant_id": F.when(F.col("status") == "busy", F.col("tenant_id") + 1).otherwise(F.col("tenant_id"))})
    out = tables.audit_diff(old, new, "id", ["name", "status", "tenant_id"], "Agent")
    return out.select("action", "model_id", F.inline("diff"))


@query("json_patch", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type AS kind, value AS score FROM events""")
def _(t):
    docs = t("events").select("event_id", "props", "event_type", "value")
    out = tables.json_patch(docs, "props", {"kind": F.col("event_type"), "score": F.col("value")})
    return out.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"),
                      F.get_json_object("props", "$.kind").alias("kind"),
                      F.get_json_object("props", "$.score").cast("double").alias("score"))


@query("sync_nodes", """WITH d AS (SELECT CASE WHEN connections = 3 THEN 'y' ELSE '' END || node_id AS node_id,
  CASE WHEN connections > 6 THEN weight + 1 ELSE weight END AS weight, address FROM v_nodes UNION ALL SELECT 'x' || node_id, weight, address FROM v_nodes WHERE connections = 5)
SELECT coalesce(c.node_id, d.node_id) AS node_id, CASE WHEN d.node_id IS NULL THEN 'remove' WHEN c.node_id IS NULL THEN 'add'
  WHEN c.weight = d.weight THEN 'keep' ELSE 'update' END AS action, coalesce(d.weight, c.weight) AS weight,
  coalesce(d.address, c.address) AS address FROM v_nodes c FULL JOIN d ON c.node_id = d.node_id""")
def _(t):
    nodes = t("v_nodes")
    moved = F.when(F.col("connections") == 3, F.concat(F.lit("y"), "node_id")).otherwise(F.col("node_id"))
    changed = nodes.withColumn("node_id", moved).withColumn(
        "weight", F.when(F.col("connections") > 6, F.col("weight") + 1).otherwise(F.col("weight")))
    added = nodes.filter("connections = 5").withColumn("node_id", F.concat(F.lit("x"), "node_id"))
    return tables.sync_nodes(nodes, changed.unionByName(added))


@query("row_stats", "SELECT label, count(*) AS row_count FROM embeddings GROUP BY label")
def _(t):
    return tables.row_stats(t("embeddings"), ["label"])


@query("record_key", "SELECT 'agent:' || id AS key, name FROM v_agents")
def _(t):
    return t("v_agents").select(S.record_key("Agent", F.col("id")).alias("key"), "name")
