"""Column expressions for events, logs, spans and versions. Everything stays inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns and labels that results must match.
ANONYMOUS = "ANONYMOUS"
REDACTED = "<REDACTED>"
SENSITIVE_KEY = "(?i)(token|password|key|secret)"
SENSITIVE_PARTS = ("password", "token", "authorization")
SEMVER = r"^\d+\.\d+\.\d+(-[a-zA-Z0-9\.]+)?(\+[a-zA-Z0-9\.]+)?$"
SKILL_NAME = r"^[a-z0-9_\-]+$"
METRIC_NAME = r"^[a-zA-Z_:][a-zA-Z0-9_:]*$"
FORBIDDEN_CALL = r"(?i)(exec|system|eval)\("
FORBIDDEN_RULE_CALL = r"(?i)exec\(|os\.system"
MAX_RULE_CHARS = 1024 * 1024
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
IPV4 = r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"
SIGNATURE_STEPS = [(r"[0-9]+", "<NUM>"), (r"0x[0-9a-f]+", "<HEX>")]
SIGNATURE_LAST = (r"\b[A-Za-z0-9_]{32,}\b", "<HASH>")
PHONE = r"\+?[0-9]{1,3}[ -][0-9]{3}[ -][0-9]{3,4}[ -][0-9]{3,4}"


def fill_default(c: Column, default) -> Column:
    return F.coalesce(c, F.lit(default))


def value_category(c: Column, threshold: float = 1000) -> Column:
    return F.when(c > threshold, "HIGH").otherwise("NORMAL")


def hash_user(c: Column) -> Column:
    return F.sha2(c, 256)


def time_bucket(ts: Column, seconds: int = 300) -> Column:
    """Epoch seconds cut down to a multiple of ``seconds``."""
    return (F.unix_seconds(ts) / seconds).cast("long") * seconds


def mask_ip(c: Column) -> Column:
    """Replace the last three characters by ``***``; empty and null give null."""
    kept = F.substring(c, F.lit(1), F.greatest(F.length(c) - 3, F.lit(0)))
    return F.when(F.length(c) > 0, F.concat(kept, F.lit("***")))


def log_signature(message: Column, hex_first: bool = False) -> Column:
    """Replace numbers, hex numbers and long words by placeholders."""
    steps = SIGNATURE_STEPS[::-1] if hex_first else SIGNATURE_STEPS
    for pattern, mark in [*steps, SIGNATURE_LAST]:
        message = F.regexp_replace(message, pattern, mark)
    return message


def attrs_sanitize(attributes: Column) -> Column:
    """Redact map values whose key looks sensitive; null becomes an empty map."""
    clean = F.transform_values(attributes, lambda k, v: F.when(k.rlike(SENSITIVE_KEY), REDACTED)
                               .otherwise(v.cast("string")))
    return F.coalesce(clean, F.create_map().cast("map<string,string>"))


def attrs_redact_keys(attributes: Column, keys: Sequence[str] = (), parts: Sequence[str] = SENSITIVE_PARTS) -> Column:
    """Redact the listed keys, and keys that contain one of ``parts`` in any case."""

    def hidden(k):
        found = k.isin(list(keys)) if keys else F.lit(False)
        for part in parts:
            found = found | F.lower(k).contains(part)
        return found

    return F.transform_values(attributes, lambda k, v: F.when(hidden(k), REDACTED).otherwise(v))


def time_features(df: DataFrame, *columns: str) -> DataFrame:
    """Year, day of week (Monday 0) and hour of each timestamp column, which is then dropped."""
    for c in columns:
        df = df.select("*", F.year(c).alias(f"{c}_year"), F.weekday(c).alias(f"{c}_dayofweek"),
                       F.hour(c).alias(f"{c}_hour"))
    return df.drop(*columns)


def json_timestamp(doc: Column, name: str = "timestamp") -> Column:
    """Time field of a parsed JSON value, as epoch seconds or as text; null when it is neither."""
    seconds = F.try_variant_get(doc, f"$.{name}", "double")
    return F.coalesce(F.timestamp_micros((seconds * 1_000_000).try_cast("long")),
                      F.try_variant_get(doc, f"$.{name}", "timestamp"))


def topic_to_path(topic: Column) -> Column:
    """Path segments of a topic; a colon also separates segments. ``$SYS`` topics give null."""
    return F.when(~topic.startswith("$SYS"), F.split(F.translate(topic, "/", ":"), ":"))


def path_to_topic(path: Column) -> Column:
    return F.array_join(path, "/")


def semver_valid(version: Column) -> Column:
    return version.rlike(SEMVER)


def semver_key(version: Column) -> Column:
    """Numeric sort key [major, minor, patch]; null if the version is not valid."""
    main = F.split(F.regexp_extract(version, r"^(\d+\.\d+\.\d+)", 1), r"\.")
    return F.when(semver_valid(version), F.transform(main, lambda x: x.try_cast("long")))


def semver_release(version: Column) -> Column:
    """1 for a release, 0 for a pre-release of the same number, so that releases sort last."""
    return F.when(version.rlike(r"^\d+\.\d+\.\d+-"), 0).otherwise(1)


def semver_bump(version: Column) -> Column:
    """Next version: minor step if the patch is 0, else patch step."""
    k = semver_key(version)
    return F.when(k[2] == 0, F.concat_ws(".", k[0], k[1] + 1, F.lit(0))).otherwise(
        F.concat_ws(".", k[0], k[1], k[2] + 1))


def semver_matches(version: Column, constraint: str) -> Column:
    """``*``, a minimum version ``x.y.z``, or a space separated list such as ``>=2.1.0 <3.0.0``."""
    k = semver_key(version)
    ok = k.isNotNull()
    if constraint.strip() == "*":
        return ok
    for part in constraint.split():
        number = part.lstrip("<>=!")
        op = part[: len(part) - len(number)] or ">="
        bound = F.array(*[F.lit(int(x)).cast("long") for x in number.split(".")[:3]])
        ok = ok & {">=": k >= bound, ">": k > bound, "<=": k <= bound, "<": k < bound,
                   "==": k == bound, "=": k == bound, "!=": k != bound}[op]
    return ok


def semver_bucket(key: Column) -> Column:
    """A number that never decreases along version keys: one per major and minor number."""
    return F.least(key[0], F.lit(10 ** 9)) * 1_000_000 + F.least(key[1], F.lit(999_999))


def semver_bounds(constraint: Column) -> Column:
    """Struct (low, high) of a constraint column: a version fits when low <= its key with 0 appended < high.

    The constraint is ``*`` or parts separated by spaces or commas, each with >=, >, <=, <, = or ==; a
    bare version is a minimum. Null when a part cannot be read.
    """
    parts = F.filter(F.split(F.trim(constraint), r"[ ,]+"), lambda p: (p != "") & (p != "*"))
    readable = F.forall(parts, lambda p: p.rlike(r"^(>=|>|<=|<|==?)?\d+\.\d+\.\d+$"))

    def bound(p, edge):
        number = F.transform(F.split(F.regexp_extract(p, r"(\d+\.\d+\.\d+)$", 1), r"\."), lambda x: x.try_cast("long"))
        return F.concat(number, F.array(F.lit(edge).cast("long")))

    def op(p):
        return F.regexp_extract(p, r"^([<>=]*)", 1)

    lows = F.transform(parts, lambda p: F.when(op(p).isin("", ">=", "=", "=="), bound(p, 0)).when(op(p) == ">", bound(p, 1)))
    highs = F.transform(parts, lambda p: F.when(op(p).isin("<=", "=", "=="), bound(p, 1)).when(op(p) == "<", bound(p, 0)))
    lowest = F.array(*[F.lit(0).cast("long")] * 4)
    highest = F.array(*[F.lit(2 ** 62).cast("long")] * 4)
    return F.when(readable, F.struct(F.coalesce(F.array_max(lows), lowest).alias("low"),
                                     F.coalesce(F.array_min(highs), highest).alias("high")))


def rule_violation(content: Column, pattern: str = FORBIDDEN_CALL) -> Column:
    """``size``, ``forbidden`` or null for a rule text."""
    return F.when(F.length(content) > MAX_RULE_CHARS, "size").when(content.rlike(pattern), "forbidden")


def metric_name_valid(name: Column) -> Column:
    return name.rlike(METRIC_NAME)


def record_key(model: str | Column, identifier: Column) -> Column:
    model = F.lit(model.lower()) if isinstance(model, str) else F.lower(model)
    return F.concat(model, F.lit(":"), identifier)


def generated_id() -> Column:
    """A fresh ``obj:<hex>`` id per row; not repeatable, so write the result before using it twice."""
    return F.concat(F.lit("obj:"), F.translate(F.uuid(), "-", ""))


def pii_mask(text: Column) -> Column:
    """Mask e-mail addresses, IPv4 addresses and phone numbers."""
    for pattern, mark in [(EMAIL, "<EMAIL>"), (IPV4, "<IP>"), (PHONE, "<PHONE>")]:
        text = F.regexp_replace(text, pattern, mark)
    return text
