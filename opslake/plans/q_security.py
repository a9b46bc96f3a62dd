"""Access, compliance, key and token queries."""

import datetime as dt

from pyspark.sql import functions as F

from opslake.functions import scalars as S
from opslake.functions import tokens
from opslake.operators import rules, security
from opslake.plans.catalog import query

EPOCH = 1706659200

POLICIES = [
    {"id": "closed", "priority": 1, "enabled": False, "action": "DENY", "conditions": {}},
    {"id": "night-close", "priority": 2, "action": "DENY", "exceptions": ["crew-3", "crew-11", "crew-20"],
     "conditions": {"resource": "/ledger/*/close", "time": {"window": "21:45-05:10"}}},
    {"id": "far-views", "priority": 4, "action": "DENY", "conditions": {"region": ["r4", "r5"], "auth_level": ">= 2", "resource": "/maps/????"}},
    {"id": "weekend-maps", "priority": 6, "action": "ALERT", "exceptions": ["crew-1"], "conditions": {"resource": "/maps/*", "time": {"days": ["Sat-Mon"]}}},
    {"id": "low-port", "priority": 6, "action": "ALLOW", "conditions": {"port": "<= 8001"}},
]
_CASE = """CASE WHEN resource LIKE '/ledger/%/close' AND (strftime(ts, '%H:%M') >= '21:45' OR strftime(ts, '%H:%M') <= '05:10')
  AND source_id NOT IN ('crew-3', 'crew-11', 'crew-20') THEN '{0}'
 WHEN region IN ('r4', 'r5') AND auth_level >= 2 AND resource LIKE '/maps/____' THEN '{1}'
 WHEN resource LIKE '/maps/%' AND isodow(ts) IN (6, 7, 1) AND source_id <> 'crew-1' THEN '{2}' WHEN port <= 8001 THEN '{3}' ELSE {4} END"""
_RULES = ("night-close", "far-views", "weekend-maps", "low-port", "NULL")
_ACTS = ("DENY", "DENY", "ALERT", "ALLOW", "'DENY'")
_DENIED = "rule IN ('night-close', 'far-views')"


@query("policy_match", f"""SELECT event_id, {_CASE.format(*_RULES)} AS rule_id,
{_CASE.format(*_ACTS)} AS action FROM v_access""")
def _(t):
    return rules.policy_match(t("v_access"), POLICIES).select("event_id", "rule_id", "action")


@query("firewall_blocks", f"""WITH RECURSIVE j AS (SELECT *, {_CASE.format(*_RULES)} AS rule,
    {_CASE.format(*_ACTS)} AS act FROM v_access),
d AS (SELECT source_ip, epoch_us(ts) AS t_us, event_id FROM j WHERE {_DENIED}),
nxt AS (SELECT a.source_ip, a.event_id, a.t_us, (SELECT min(b.t_us) FROM d b WHERE b.source_ip = a.source_ip AND b.t_us >= a.t_us + 3600000000) AS next_at FROM d a),
b AS (SELECT source_ip, min(t_us) AS t_us FROM d GROUP BY source_ip
  UNION SELECT b.source_ip, n.next_at FROM b JOIN nxt n ON n.source_ip = b.source_ip AND n.t_us = b.t_us WHERE n.next_at IS NOT NULL),
k AS (SELECT j.*, (SELECT max(b.t_us) FROM b WHERE b.source_ip = j.source_ip AND b.t_us < epoch_us(j.ts)) AS last_at,
  EXISTS (SELECT 1 FROM b WHERE b.source_ip = j.source_ip AND b.t_us = epoch_us(j.ts)) AND {_DENIED} AS acted FROM j)
SELECT event_id, CASE WHEN acted OR coalesce(epoch_us(ts) - last_at < 3600000000, false) THEN 'BLOCK' ELSE act END AS decision,
  CASE WHEN coalesce(epoch_us(ts) - last_at < 3600000000, false) THEN 'Known threat' WHEN acted THEN 'Policy' END AS reason,
  CASE WHEN NOT coalesce(epoch_us(ts) - last_at < 3600000000, false) THEN rule END AS rule_id FROM k""")
def _(t):
    out = security.firewall_blocks(t("v_access"), POLICIES)
    return out.select("event_id", "decision", "reason", "rule_id")


@query("threat_sources", """SELECT source_ip, count(*) AS request_count, count(DISTINCT resource || source_id) AS unique_endpoints
FROM v_access GROUP BY source_ip HAVING count(*) > 40 AND count(DISTINCT resource || source_id) > 4""")
def _(t):
    access = t("v_access").withColumn("endpoint", F.concat("resource", "source_id"))
    return security.threat_sources(access, 40, 4, endpoint="endpoint")


@query("pii_mask", r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text,
'[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '<EMAIL>', 'g'), '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b', '<IP>', 'g'),
'\+?[0-9]{1,3}[ -][0-9]{3}[ -][0-9]{3,4}[ -][0-9]{3,4}', '<PHONE>', 'g') AS text FROM documents""")
def _(t):
    return t("documents").select("doc_id", S.pii_mask(F.col("text")).alias("text"))


def _token(t):
    def part(c):
        return F.translate(F.translate(F.base64(F.to_json(c).cast("binary")), "+/", "-_"), "=\r\n", "")

    head = F.struct(F.lit("RS256").alias("alg"), F.lit("JWT").alias("typ"))
    body = F.struct("sub", "exp", "iat", "iss", "aud", F.col("row_id").cast("string").alias("jti"), "scopes")
    return t("v_tokens").select("row_id", F.concat_ws(".", part(head), part(body), F.lit("sig")).alias("token"))


@query("jwt_claims", "SELECT row_id, 'RS256' AS alg, sub, exp, CAST(iat AS BIGINT) AS iat, iss, aud, CAST(row_id AS VARCHAR) AS jti, scopes FROM v_tokens")
def _(t):
    out = _token(t).select("row_id", tokens.jwt_claims(F.col("token")).alias("c"))
    return out.select("row_id", "c.alg", "c.sub", "c.exp", "c.iat", "c.iss", "c.aud", "c.jti", "c.scopes")


@query("token_valid", f"SELECT row_id, sub IS NOT NULL AND iss = 'issuer' AND exp > {EPOCH} AS valid FROM v_tokens")
def _(t):
    claims = tokens.jwt_claims(F.col("token"))
    return _token(t).select("row_id", tokens.token_valid(claims, "aud", "issuer", EPOCH).alias("valid"))


@query("scope_check", """SELECT row_id, scopes FROM v_tokens WHERE scopes LIKE '%write%' AND client_id IN
(SELECT CASE WHEN n_regionkey = 2 THEN 'other' ELSE 'client' END || n_nationkey FROM nation)""")
def _(t):
    name = F.when(F.col("n_regionkey") == 2, "other").otherwise("client")
    clients = t("nation").select(F.concat(name, F.col("n_nationkey").cast("string")).alias("client_id"))
    return security.scope_check(t("v_tokens"), clients, F.lit("write read")).select("row_id", "scopes")



@query("aes_gcm_encrypt", """SELECT c_custkey, CAST(length(c_name) + 28 AS INT) AS sealed_size, CAST(12 AS INT) AS nonce_size,
c_name AS opened, CAST(NULL AS VARCHAR) AS wrong_key, CAST(NULL AS VARCHAR) AS wrong_aad FROM customer""")
def _(t):
    key, other = F.lit(b"0123456789abcdef0123456789abcdef"), F.lit(b"x123456789abcdef0123456789abcdef")
    nonce = F.substring(F.sha2(F.col("c_custkey").cast("string"), 256), 1, 12).cast("binary")
    aad = F.col("c_mktsegment")
    sealed = t("customer").select("c_custkey", "c_mktsegment", tokens.aes_gcm_encrypt(F.col("c_name"), key, nonce, aad).alias("s"))
    s = F.col("s")
    return sealed.select(
        "c_custkey", F.length(s).alias("sealed_size"), F.length(tokens.aes_gcm_parts(s)["nonce"]).alias("nonce_size"),
        tokens.aes_gcm_decrypt(s, key, aad).alias("opened"), tokens.aes_gcm_decrypt(s, other, aad).alias("wrong_key"),
        tokens.aes_gcm_decrypt(s, key, F.lit("other")).alias("wrong_aad"))


@query("reencrypt_column", "SELECT s_suppkey, s_name AS opened, CAST(NULL AS VARCHAR) AS old_key FROM supplier")
def _(t):
    old, new = F.lit(b"0123456789abcdef"), F.lit(b"fedcba9876543210fedcba98")
    sealed = t("supplier").select("s_suppkey", tokens.aes_gcm_encrypt(F.col("s_name"), old).alias("s"))
    moved = sealed.select("s_suppkey", tokens.reencrypt(F.col("s"), old, new).alias("s"))
    return moved.select("s_suppkey", tokens.aes_gcm_decrypt(F.col("s"), new).alias("opened"),
                        tokens.aes_gcm_decrypt(F.col("s"), old).alias("old_key"))


@query("content_integrity", "SELECT doc_id FROM documents WHERE lang = 'de' OR n_chars % 13 = 0")
def _(t):
    stored = F.when((F.col("lang") == "de") | (F.col("n_chars") % 13 == 0), F.sha2(F.concat("text", F.lit("?")), 256)).otherwise(F.sha2("text", 256))
    rows = t("documents").select("doc_id", F.col("text").alias("content"), stored.alias("checksum"))
    return security.content_integrity(rows).select("doc_id")


@query("key_rotation_due", "SELECT key_id, provider, age_days FROM v_keys WHERE age_days >= 90 OR usage_count >= 1000000")
def _(t):
    return security.key_rotation_due(t("v_keys")).select("key_id", "provider", "age_days")


@query("key_versions_to_disable", """SELECT key_id, key_id || '-' || k AS version_id FROM v_keys, range(3) AS r(k)
WHERE (CASE WHEN (age_days + k) % 2 = 0 THEN 'ACTIVE' ELSE 'DISABLED' END) = 'ACTIVE' AND age_days * k > 24""")
def _(t):
    old = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.struct(
        F.concat_ws("-", "key_id", k.cast("string")).alias("id"),
        F.when((F.col("age_days") + k) % 2 == 0, "ACTIVE").otherwise("DISABLED").alias("state"),
        (F.col("age_days") * k).alias("age_hours")))
    return security.versions_to_disable(t("v_keys").withColumn("previous_versions", old))


def _entries(t):
    """Documents as data entries: one personal field per 200 characters."""
    n = F.floor(F.col("n_chars") / 200).cast("int")
    return t("documents").select(F.col("doc_id").alias("id"), "source", "n_chars",
                                 F.transform(F.sequence(F.lit(0), n), lambda i: F.concat(F.lit("f"), i.cast("string"))).alias("personal_data_fields"))


def _configs(t):
    return t("v_keys").select("key_id", F.when(F.col("provider") == "aws", "AES-256").otherwise("AES-128").alias("algorithm"),
                              F.col("age_days").alias("key_rotation_days"))


_GDPR = "documents WHERE CAST(floor(n_chars / 200) AS INT) + 1 > 15"


@query("gdpr_minimization", f"""SELECT doc_id AS id, 'Excessive personal data collection' AS reason, 'GDPR Article 5(1)(c)' AS article FROM {_GDPR}""")
def _(t):
    return security.gdpr_minimization(_entries(t))


@query("hipaa_encryption", """SELECT key_id, array_to_string(list_filter([CASE WHEN provider <> 'aws' THEN 'Insufficient encryption standard' END,
CASE WHEN age_days > 90 THEN 'Key rotation period exceeds 90 days' END], lambda x: x IS NOT NULL), '; ') AS issues FROM v_keys
WHERE provider <> 'aws' OR age_days > 90""")
def _(t):
    return security.hipaa_encryption(_configs(t)).select("key_id", F.array_join("issues", "; ").alias("issues"))


@query("compliance_report", f"""WITH h AS (SELECT sha256(count(*) || ':' || CAST(sum(('0x' || substr(md5(doc_id || '|' || n_chars), 1, 8))::BIGINT) AS VARCHAR)) AS a FROM documents),
g AS (SELECT sha256(count(*) || ':' || CAST(sum(('0x' || substr(md5(key_id || '|' || age_days), 1, 8))::BIGINT) AS VARCHAR)) AS b FROM v_keys),
n AS (SELECT (SELECT count(*) FROM {_GDPR}) AS gdpr_violations, (SELECT count(*) FROM v_keys WHERE provider <> 'aws' OR age_days > 90) AS hipaa_issues)
SELECT 'GDPR/HIPAA' AS framework, gdpr_violations = 0 AND hipaa_issues = 0 AS overall_status,
  CAST(gdpr_violations = 0 AS INT) + CAST(hipaa_issues = 0 AS INT) AS rules_passed,
  2 - CAST(gdpr_violations = 0 AS INT) - CAST(hipaa_issues = 0 AS INT) AS rules_failed, gdpr_violations, hipaa_issues,
  sha256(a || ':' || b) AS evidence_hash FROM h, g, n""")
def _(t):
    out = security.compliance_report(_entries(t), _configs(t), dt.datetime(2024, 1, 31), ["id", "n_chars"], ["key_id", "key_rotation_days"])
    return out.drop("assessment_date")


@query("message_validate", """SELECT event_id, CASE event_type WHEN 'view' THEN 'priority: type, payload: required'
  WHEN 'click' THEN 'extra: unexpected' WHEN 'error' THEN 'body: not an object' WHEN 'signup' THEN 'metrics: type' ELSE '' END AS errors,
event_type = 'purchase' AS valid FROM events""")
def _(t):
    kind = F.when(F.col("event_type") == "view", "task").when(F.col("event_type") == "click", "broadcast").otherwise("heartbeat")
    beat = F.struct(F.col("user_id").cast("string").alias("agent_id"), F.lit("2024-01-31T00:00:00").alias("timestamp"),
                    F.lit("active").alias("status"),
                    F.when(F.col("event_type") == "signup", F.lit('{"cpu":"hot"}')).otherwise(F.lit('{"cpu":0.5,"n":3}')).alias("m"))
    beat_json = F.concat(F.regexp_replace(F.to_json(F.struct(beat["agent_id"].alias("agent_id"), beat["timestamp"].alias("timestamp"),
                                                              beat["status"].alias("status"))), r"\}$", ""),
                         F.lit(',"metrics":'), beat["m"], F.lit("}"))
    task = F.to_json(F.struct(F.col("event_id").cast("string").alias("task_id"), F.lit("high").alias("priority")))
    cast = F.to_json(F.struct(F.lit("alert").alias("message_type"), F.lit("system").alias("scope"),
                              F.struct("value").alias("content"), F.lit(1).alias("extra")))
    body = F.when(kind == "task", task).when(kind == "broadcast", cast).when(F.col("event_type") == "error", "[1, 2]").otherwise(beat_json)
    out = security.message_validate(t("events").select("event_id", kind.alias("kind"), body.alias("body")))
    return out.select("event_id", F.array_join(F.reverse(F.array_sort("errors")), ", ").alias("errors"), "valid")
