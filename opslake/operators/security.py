"""Access control, compliance, key rotation and integrity."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslake.functions.tokens import scopes_granted
from opslake.operators.folds import cooldown_replay
from opslake.operators.rules import policy_match


def threat_sources(access: DataFrame, min_requests: int = 1000, min_endpoints: int = 50, source: str = "source_ip",
                   endpoint: str = "resource", approximate: bool = False) -> DataFrame:
    """Sources with more requests and more distinct endpoints than the limits.

    Requests are counted per (source, endpoint) first, so a very busy source is combined before it
    meets in one task.
    """
    if approximate:
        totals = access.groupBy(source).agg(F.count(F.lit(1)).alias("request_count"),
                                            F.approx_count_distinct(endpoint).alias("unique_endpoints"))
    else:
        pairs = access.groupBy(source, endpoint).agg(F.count(F.lit(1)).alias("_n"))
        totals = pairs.groupBy(source).agg(F.sum("_n").alias("request_count"), F.count(endpoint).alias("unique_endpoints"))
    return totals.filter((F.col("request_count") > min_requests) & (F.col("unique_endpoints") > min_endpoints))


def firewall_blocks(access: DataFrame, policies: list[dict], block_s: int = 3600, source: str = "source_ip",
                    ts: str = "ts", tie: str = "event_id", bucket: Column | None = None) -> DataFrame:
    """Final decision per request.

    A denial by a policy blocks its source for ``block_s`` seconds; requests inside are blocked
    without evaluation and do not extend the block. A request that no policy matches is denied
    without a block. Adds ``decision``, ``reason`` and the rule.
    """
    judged = policy_match(access, policies, ts)
    denies = (F.col("action") == "DENY") & F.col("rule_id").isNotNull()
    replayed = cooldown_replay(judged, [source], ts, tie, denies, F.lit(block_s), bucket)
    blocked = F.coalesce(F.unix_micros(ts) - F.unix_micros("last_action") < block_s * 1_000_000, F.lit(False))
    return replayed.select(
        *access.columns,
        F.when(blocked | F.col("acted"), "BLOCK").otherwise(F.col("action")).alias("decision"),
        F.when(blocked, "Known threat").when(F.col("acted"), "Policy").alias("reason"),
        F.when(~blocked, F.col("rule_id")).alias("rule_id"))


def scope_check(tokens: DataFrame, clients: DataFrame, required: Column, granted: str = "scopes",
                client: str = "client_id") -> DataFrame:
    """Tokens of known clients that carry every required scope."""
    return tokens.join(clients.select(client).distinct(), client, "left_semi").filter(scopes_granted(F.col(granted), required))


# Texts and limits of the reports.
TOO_MANY_FIELDS, TOO_MANY_FIELDS_ARTICLE = "Excessive personal data collection", "GDPR Article 5(1)(c)"
WEAK_CIPHER, LATE_ROTATION = "Insufficient encryption standard", "Key rotation period exceeds 90 days"


def gdpr_minimization(entries: DataFrame, fields: str = "personal_data_fields", limit: int = 15) -> DataFrame:
    """Violation rows for entries that hold too many personal fields."""
    return entries.filter(F.size(fields) > limit).select(
        "id", F.lit(TOO_MANY_FIELDS).alias("reason"), F.lit(TOO_MANY_FIELDS_ARTICLE).alias("article"))


def _encryption_issues(algorithm: str, rotation: str, max_days: int) -> Column:
    return F.array_compact(F.array(
        F.when(F.col(algorithm) != "AES-256", WEAK_CIPHER),
        F.when(F.col(rotation) > max_days, LATE_ROTATION)))


def hipaa_encryption(configs: DataFrame, algorithm: str = "algorithm", rotation: str = "key_rotation_days",
                     max_days: int = 90) -> DataFrame:
    """Configurations with their issues."""
    return configs.withColumn("issues", _encryption_issues(algorithm, rotation, max_days)).filter(F.size("issues") > 0)


def _evidence_parts(columns: Sequence[str]) -> list[Column]:
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    number = F.conv(F.substring(F.md5(row), 1, 8), 16, 10).cast("decimal(38,0)")
    return [F.count(F.lit(1)).alias("_n"), F.coalesce(F.sum(number), F.lit(0)).alias("_s")]


def _evidence_hash() -> Column:
    return F.sha2(F.concat_ws(":", F.col("_n").cast("string"), F.col("_s").cast("string")), 256)


def evidence_hash(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Hash of a table that does not depend on the row order: count and sum of the row hashes."""
    return df.agg(*_evidence_parts(columns)).select(_evidence_hash().alias("evidence_hash"))


def compliance_report(entries: DataFrame, configs: DataFrame, as_of: dt.datetime, entry_columns: Sequence[str],
                      config_columns: Sequence[str], fields: str = "personal_data_fields", limit: int = 15) -> DataFrame:
    """One row: framework, overall status, passed and failed rules, violation counts, evidence hash.

    Each table is read once: its violations and its hash come from the same aggregation.
    """
    gdpr = entries.agg(F.count_if(F.size(fields) > limit).alias("_bad"), *_evidence_parts(entry_columns))
    issues = F.size(_encryption_issues("algorithm", "key_rotation_days", 90)) > 0
    hipaa = configs.agg(F.count_if(issues).alias("_bad"), *_evidence_parts(config_columns))
    rules = gdpr.withColumn("_rule", F.lit("gdpr")).unionByName(hipaa.withColumn("_rule", F.lit("hipaa")))

    def of(rule, value):
        return F.max(F.when(F.col("_rule") == rule, value))

    row = rules.agg(of("gdpr", F.col("_bad")).alias("gdpr_violations"), of("hipaa", F.col("_bad")).alias("hipaa_issues"),
                    of("gdpr", _evidence_hash()).alias("_a"), of("hipaa", _evidence_hash()).alias("_b"))
    passed = (F.col("gdpr_violations") == 0).cast("int") + (F.col("hipaa_issues") == 0).cast("int")
    return row.select(
        F.lit("GDPR/HIPAA").alias("framework"), F.lit(as_of).alias("assessment_date"), (passed == 2).alias("overall_status"),
        passed.alias("rules_passed"), (2 - passed).alias("rules_failed"), "gdpr_violations", "hipaa_issues",
        F.sha2(F.concat_ws(":", "_a", "_b"), 256).alias("evidence_hash"))


def content_integrity(df: DataFrame, content: str = "content", checksum: str = "checksum") -> DataFrame:
    """Rows whose content does not match its stored SHA-256."""
    return df.filter(~F.sha2(content, 256).eqNullSafe(F.col(checksum)))


def key_rotation_due(keys: DataFrame, max_age_days: int = 90, max_usage: int = 1_000_000) -> DataFrame:
    """Keys that must rotate, by age or by use."""
    return keys.filter((F.col("age_days") >= max_age_days) | (F.col("usage_count") >= max_usage))


def versions_to_disable(keys: DataFrame, min_active_hours: float = 24) -> DataFrame:
    """Old key versions still active after the grace period: (key_id, version_id)."""
    rows = keys.select("key_id", F.explode("previous_versions").alias("_v"))
    return rows.filter((F.col("_v.state") == "ACTIVE") & (F.col("_v.age_hours") > min_active_hours)).select(
        "key_id", F.col("_v.id").alias("version_id"))


# Message kinds with the JSON type of each field; all are required except dependencies.
MESSAGE_FIELDS = {
    "heartbeat": {"agent_id": "string", "timestamp": "date-time", "status": "string", "metrics": "map<number>"},
    "task": {"task_id": "string", "payload": "object", "priority": "integer", "dependencies": "array<string>"},
    "broadcast": {"message_type": "string", "scope": "string", "content": "object"},
}
OPTIONAL_FIELDS = {"dependencies"}
DATE_TIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"


def _field_ok(doc: Column, name: str, kind: str) -> Column:
    shape = F.schema_of_variant(F.variant_get(doc, f"$.{name}", "variant"))
    if kind == "string":
        return shape == "STRING"
    if kind == "date-time":
        return (shape == "STRING") & F.try_variant_get(doc, f"$.{name}", "string").rlike(DATE_TIME)
    if kind == "integer":
        return shape == "BIGINT"
    if kind == "object":
        return shape.startswith("OBJECT")
    if kind == "array<string>":
        return shape.isin("ARRAY<STRING>", "ARRAY<VOID>")
    numbers = F.try_variant_get(doc, f"$.{name}", "map<string,variant>")
    return shape.startswith("OBJECT") & F.forall(
        F.map_values(numbers), lambda v: F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|DECIMAL.*)$"))


def message_validate(messages: DataFrame, kind: str = "kind", body: str = "body") -> DataFrame:
    """Add ``valid`` and ``errors`` for JSON messages of the known kinds."""
    doc = F.try_parse_json(body)
    found = F.json_object_keys(body)
    by_kind = F.when(F.lit(False), F.array().cast("array<string>"))
    for name, fields in MESSAGE_FIELDS.items():
        checks = []
        for field, shape in fields.items():
            present = F.array_contains(found, field)
            if field not in OPTIONAL_FIELDS:
                checks.append(F.when(~present, F.lit(f"{field}: required")))
            checks.append(F.when(present & ~F.coalesce(_field_ok(doc, field, shape), F.lit(False)), F.lit(f"{field}: type")))
        extra = F.transform(F.array_except(found, F.array(*[F.lit(f) for f in fields])), lambda k: F.concat(k, F.lit(": unexpected")))
        errors = F.concat(F.array_compact(F.array(*checks)), extra)
        by_kind = by_kind.when(F.col(kind) == name, errors)
    errors = F.when(doc.isNull() | found.isNull(), F.array(F.lit("body: not an object"))).otherwise(
        by_kind.otherwise(F.array(F.lit("kind: unsupported"))))
    return messages.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)
