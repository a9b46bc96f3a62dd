"""Input shapes for the registered queries, as SQL that Spark and an ANSI engine both run.

``@table`` stands for a given table. Views derive every row of their table. Two of them state
conditions that belong to the shape: ``v_state_current`` holds the agents known so far (so that others
arrive as new ones), and the conditions of ``v_dag_edges`` say which dependencies a node has.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_raw_events": """
SELECT concat('e', CAST(CASE WHEN event_id % 20 = 19 THEN event_id - 1 ELSE event_id END AS STRING)) AS event_id,
       CASE WHEN event_id % 101 = 0 THEN NULL ELSE CAST(ts AS TIMESTAMP) END AS event_time,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE concat('u', CAST(user_id AS STRING)) END AS user_id,
       CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 17 = 0 THEN -value ELSE value * 8 END AS value,
       event_type AS source_system,
       concat('10.0.', CAST(user_id % 256 AS STRING), '.', CAST(100 + event_id % 100 AS STRING)) AS user_ip
FROM @events""",
    "v_requests": """
SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, concat('svc', CAST(user_id % 5 AS STRING)) AS service,
       event_type <> 'error' AS success, value / 100 AS latency,
       CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS method,
       concat('/', event_type) AS path, CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS status
FROM @events""",
    "v_logs": """
SELECT event_id, CAST(ts AS TIMESTAMP) AS ts,
       CASE WHEN event_id % 3 = 0 THEN concat('{"level":"', CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END,
              '","message":"', event_type, ' by user ', CAST(user_id AS STRING), ' took ', CAST(event_id AS STRING), ' ms"}')
            WHEN event_id % 3 = 1 THEN concat('10.0.0.', CAST(user_id % 256 AS STRING),
              ' - - [01/Jan/2024:00:00:00 +0000] "GET /', event_type, ' HTTP/1.1" 200 ', CAST(event_id AS STRING))
            ELSE concat('worker 0x1f finished ', event_type, ' ', CAST(event_id AS STRING)) END AS raw,
       CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'ERROR' ELSE 'INFO' END AS level,
       CASE WHEN event_id % 3 = 0 THEN concat(event_type, ' by user ', CAST(user_id AS STRING), ' took ', CAST(event_id AS STRING), ' ms')
            WHEN event_id % 3 = 1 THEN concat('GET /', event_type)
            ELSE concat('worker 0x1f finished ', event_type, ' ', CAST(event_id AS STRING)) END AS message
FROM @events""",
    "v_spans": """
SELECT event_id AS span_id, event_id - event_id % 4 AS trace_id,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id - 1 END AS parent_id,
       concat('svc', CAST((event_id * 7 + user_id) % 5 AS STRING)) AS service, event_type = 'error' AS error,
       CASE WHEN event_id % 9 = 0 THEN 'high' ELSE 'normal' END AS priority, value AS duration_ms
FROM @events""",
    "v_access": """
SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, concat('10.0.0.', CAST(user_id % 20 AS STRING)) AS source_ip,
       concat('crew-', CAST(user_id % 30 AS STRING)) AS source_id,
       CASE event_type WHEN 'error' THEN concat('/ledger/', CAST(user_id % 3 AS STRING), '/close') WHEN 'purchase' THEN '/ledger/open'
                       ELSE concat('/maps/', event_type) END AS resource,
       CAST(event_id % 4 AS INT) AS auth_level, CAST(8000 + event_id % 3 AS INT) AS port, concat('r', CAST(user_id % 6 AS STRING)) AS region
FROM @events""",
    "v_topics": """
SELECT event_id, CASE WHEN event_id % 23 = 0 THEN 'not a topic?'
                      WHEN event_id % 3 = 0 THEN concat('z', CAST(user_id % 4 AS STRING), '/', event_type, '/', CAST(event_id % 5 AS STRING))
                      WHEN event_id % 3 = 1 THEN concat('z', CAST(user_id % 4 AS STRING), '/', event_type, '/', CAST(event_id % 5 AS STRING), '/raw/temp')
                      ELSE concat('z', CAST(user_id % 4 AS STRING), '/', event_type, '/', CAST(event_id % 5 AS STRING), '/raw/', CAST(user_id % 7 AS STRING), '/hum')
                 END AS topic
FROM @events""",
    "v_topic_rules": """
SELECT * FROM (VALUES ('z1/+/3/#', 7, 0), ('+/click/+/raw/temp', 31, 2), ('z2/view/#', 7, 1), ('z0/purchase/4', 12, 1),
                      ('+/+/2/+/+/hum', 20, 0), ('z3/+/+', 31, 1), ('#', 1, 0)) AS r(pattern, priority, qos)""",
    "v_tasks": """
SELECT concat('t', CAST(o_orderkey AS STRING)) AS task_id, CAST(substr(o_orderpriority, 1, 1) AS INT) * 10 AS priority,
       CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'processing' ELSE 'completed' END AS status,
       CAST(o_orderkey % 6 AS INT) AS retries, CAST(o_orderdate AS TIMESTAMP) AS created_at,
       CAST(o_orderdate AS TIMESTAMP) + INTERVAL '1' DAY AS updated_at,
       CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) + INTERVAL '1' DAY END AS last_attempt,
       CAST(o_orderdate AS TIMESTAMP) + INTERVAL '2' DAY AS next_attempt,
       CAST(o_orderdate AS TIMESTAMP) + INTERVAL '30' DAY AS deadline
FROM @orders""",
    "v_dead_letters": """
SELECT concat('m', CAST(o_orderkey AS STRING)) AS message_id, concat('topic', CAST(o_custkey % 5 AS STRING)) AS original_topic,
       concat('{"order_id":', CAST(o_orderkey AS STRING), '}') AS payload, o_orderstatus AS failure_reason,
       CAST(o_orderdate AS TIMESTAMP) AS ts, CAST(o_orderkey % 7 AS INT) AS retries,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) + INTERVAL '1' HOUR END AS last_attempt,
       o_orderkey % 7 >= 5 AS permanent_failure
FROM @orders""",
    "v_state_current": """
SELECT concat(CASE WHEN c_acctbal >= 0 THEN 'a' ELSE 'z' END, CAST(c_custkey AS STRING)) AS agent_id, c_mktsegment AS status,
       CAST(c_custkey % 4 AS INT) AS version
FROM @customer""",
    "v_state_incoming": """
SELECT concat('a', CAST(o_custkey AS STRING)) AS agent_id, o_orderstatus AS status,
       CAST(o_orderkey % 5 AS INT) AS version, o_orderkey AS seq
FROM @orders""",
    "v_agents": """
SELECT concat('a', CAST(c_custkey AS STRING)) AS id, c_name AS name,
       CASE c_custkey % 4 WHEN 0 THEN 'idle' WHEN 1 THEN 'busy' WHEN 2 THEN 'terminated' ELSE 'unknown' END AS status,
       c_nationkey AS tenant_id, c_custkey % 10 = 0 AS is_deleted, c_acctbal AS score
FROM @customer""",
    "v_lifecycle": """
SELECT concat('a', CAST(user_id AS STRING)) AS agent_id, event_id AS seq, CAST(ts AS TIMESTAMP) AS ts,
       CASE event_type WHEN 'signup' THEN 'INITIALIZED' WHEN 'view' THEN 'RUNNING' WHEN 'click' THEN 'PAUSED'
                       WHEN 'purchase' THEN 'STOPPED' ELSE 'ERROR' END AS state
FROM @events""",
    "v_nodes": """
SELECT concat('n', CAST(s_suppkey AS STRING)) AS node_id, s_suppkey AS node_no,
       concat('svc', CAST(s_nationkey % 5 AS STRING)) AS service,
       CAST(s_suppkey % 5 + 1 AS INT) AS weight, CAST(s_suppkey * 7 % 11 AS INT) AS connections,
       s_suppkey % 9 <> 0 AS healthy, s_acctbal / 100 AS latency, s_name AS address
FROM @supplier""",
    "v_node_resources": """
SELECT concat('n', CAST(s_suppkey AS STRING)) AS node_id, 'cpu' AS resource, 4 + (s_suppkey * 3) % 13 AS capacity,
       (s_suppkey * 9) % 9 AS allocated FROM @supplier
UNION ALL
SELECT concat('n', CAST(s_suppkey AS STRING)), 'gpu', 4 + (s_suppkey * 5) % 13, (s_suppkey * 15) % 9 FROM @supplier
UNION ALL
SELECT concat('n', CAST(s_suppkey AS STRING)), 'memory', 4 + (s_suppkey * 7) % 13, (s_suppkey * 22) % 9 FROM @supplier""",
    "v_proposals": """
SELECT l_orderkey AS task_no, concat('n', CAST(l_suppkey AS STRING)) AS node_id, l_linenumber AS line_no,
       CAST(l_linenumber AS BIGINT) AS cpu, CAST(l_quantity AS BIGINT) % 4 AS gpu, CAST(l_quantity AS BIGINT) % 7 AS memory
FROM @lineitem""",
    "v_dag_nodes": """
SELECT CAST((event_id - event_id % 8) / 8 AS BIGINT) AS dag_id, concat('t', CAST(event_id AS STRING)) AS node_id,
       CASE WHEN event_id % 61 = 0 THEN 'Bad-Type' ELSE 'data_processing' END AS task_type,
       CAST(user_id * 160 AS BIGINT) AS timeout, CAST(event_id % 4 AS INT) - CASE WHEN event_id % 53 = 0 THEN 4 ELSE 0 END AS retries,
       CAST(user_id * 8 AS BIGINT) AS memory
FROM @events""",
    "v_dag_edges": """
SELECT CAST((event_id - event_id % 8) / 8 AS BIGINT) AS dag_id, concat('t', CAST(event_id AS STRING)) AS node_id,
       concat('t', CAST(event_id - 1 AS STRING)) AS depends_on FROM @events WHERE event_id % 8 <> 0 AND user_id % 10 <> 0
UNION ALL
SELECT CAST((event_id - event_id % 8) / 8 AS BIGINT), concat('t', CAST(event_id AS STRING)),
       concat('t', CAST(event_id - 3 AS STRING)) FROM @events WHERE event_id % 8 > 2 AND user_id % 3 = 0
UNION ALL
SELECT CAST((event_id - event_id % 8) / 8 AS BIGINT), concat('t', CAST(event_id AS STRING)),
       concat('t', CAST(event_id + 2 AS STRING)) FROM @events WHERE event_id % 8 < 6 AND user_id % 41 = 0
UNION ALL
SELECT CAST((event_id - event_id % 8) / 8 AS BIGINT), concat('t', CAST(event_id AS STRING)), 'ghost'
FROM @events WHERE user_id % 97 = 1""",
    "v_skill_versions": """
SELECT p_partkey AS row_id, concat('skill', CAST(p_partkey % 50 AS STRING)) AS name,
       concat(CAST(p_size % 3 AS STRING), '.', CAST(p_partkey % 12 AS STRING),
              CASE WHEN p_partkey % 37 = 0 THEN 'x' ELSE concat('.', CAST(p_size % 10 AS STRING)) END) AS version
FROM @part""",
    "v_skill_needs": """
SELECT p_partkey AS row_id, concat('skill', CAST(p_partkey % 50 AS STRING)) AS name,
       concat('skill', CAST((p_partkey * 7 + 3) % 53 AS STRING)) AS needs,
       concat('>=', CAST(p_size % 3 AS STRING), '.', CAST(p_size % 14 AS STRING), '.0 <3.0.0') AS version_range
FROM @part""",
    "v_features": """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_quantity END AS quantity,
       CASE WHEN l_orderkey % 50 = 0 THEN l_extendedprice * 40 ELSE l_extendedprice END AS price,
       CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE l_returnflag END AS flag, CAST(l_shipdate AS TIMESTAMP) AS shipped
FROM @lineitem""",
    "v_system_states": """
SELECT event_id, concat('svc', CAST(user_id % 5 AS STRING)) AS service, CAST(ts AS TIMESTAMP) AS ts,
       value * 3 AS latency_ms, 400 + value * 5 AS throughput_rps, CAST(event_id % 100 AS DOUBLE) / 1000 AS error_rate,
       0.98 + CAST(event_id % 21 AS DOUBLE) / 1000 AS availability, CAST(event_id % 101 AS DOUBLE) / 100 AS cpu,
       CAST(user_id % 101 AS DOUBLE) / 100 AS memory, CAST(event_id % 8 AS INT) AS current_replicas
FROM @events""",
    "v_instances": """
SELECT concat('i', CAST(p_partkey AS STRING)) AS instance_type, p_retailprice / 100 AS price,
       CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice / 250 END AS spot_price, p_size AS vcpus,
       p_type AS family, p_brand AS zone, p_partkey AS seen_at
FROM @part""",
    "v_tokens": """
SELECT c_custkey AS row_id, CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE c_name END AS sub,
       1706659200 + (c_custkey % 7 - 3) * 3600 AS exp, 1706659200 - 3600 AS iat,
       CASE WHEN c_custkey % 8 = 0 THEN 'other' ELSE 'issuer' END AS iss, 'aud' AS aud,
       CASE WHEN c_custkey % 2 = 0 THEN 'read write' ELSE 'read' END AS scopes,
       concat('client', CAST(c_nationkey AS STRING)) AS client_id
FROM @customer""",
    "v_keys": """
SELECT concat('k', CAST(s_suppkey AS STRING)) AS key_id, CASE WHEN s_suppkey % 2 = 0 THEN 'aws' ELSE 'gcp' END AS provider,
       CAST(s_suppkey % 120 AS INT) AS age_days, s_suppkey * 15000 AS usage_count
FROM @supplier""",
    "v_rule_texts": """
SELECT doc_id, concat('ns', CAST(doc_id % 3 AS STRING)) AS namespace,
       CASE WHEN doc_id % 7 = 0 THEN concat(text, ' EVAL(x)') WHEN doc_id % 11 = 0 THEN concat(text, ' os.system') ELSE text END AS content
FROM @documents""",
    "v_delivery": """
SELECT concat('m', CAST(o_orderkey AS STRING)) AS message_id, o_totalprice < 100000 AS delivered FROM @orders""",
}

_NAME = re.compile(r"\bv_[a-z_]+\b")


def _needed(text: str, found: list[str]) -> list[str]:
    for name in _NAME.findall(text):
        if name in VIEWS and name not in found:
            _needed(VIEWS[name], found)
            found.append(name)
    return found


def oracle_text(sql: str) -> str:
    """The SQL with the views it names put in front as a WITH clause."""
    body = sql.strip()
    parts = ",\n".join(f"{n} AS ({VIEWS[n].replace('@', '').strip()})" for n in _needed(body, []))
    if not parts:
        return body
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(head):
            return f"{head}{parts},\n{body[len(head):]}"
    return f"WITH {parts}\n{body}"


class Tables:
    """Given tables and views of one data folder, by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}.parquet"

    def __call__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            return self.spark.read.parquet(self.path(name))

        def source(match):
            table = match.group(1)
            self(table).createOrReplaceTempView(f"opslake_{table}")
            return f"opslake_{table}"

        return self.spark.sql(re.sub(r"@(\w+)", source, VIEWS[name]))
