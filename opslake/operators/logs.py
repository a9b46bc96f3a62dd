"""Log parsing, error rates, pattern counts and log features."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslake.functions.scalars import json_timestamp, log_signature

# Common log format, level codes.
# Text that can be a JSON value at all; saves parsing (and failing on) plain text lines.
MAYBE_JSON = r'^\s*([\[{"]|(-?[0-9][0-9.eE+-]*|true|false|null)\s*$)'
CLF = r'^(\S+) (\S+) (\S+) \[([^\]]+)\] "(\S+) (\S+) (\S+)" (\d+) (\d+)'
LEVEL_CODES = {"DEBUG": 0, "INFO": 1, "WARN": 2, "ERROR": 3}


def log_parse(df: DataFrame, raw: str = "raw", arrived: str = "ts") -> DataFrame:
    """Add timestamp, level, message, context and parse_error.

    JSON objects give their own fields; lines in common log format give method, path, client and
    status; anything else is the message itself. JSON without a message is flagged.
    """
    text = F.col(raw)
    parsed = df.withColumns({
        "_doc": F.when(text.rlike(MAYBE_JSON), F.try_parse_json(text)),
        "_clf": F.when(text.rlike(CLF), F.split(F.regexp_replace(text, f"(?s){CLF}.*", "$1\u0001$5 $6\u0001$8"), "\u0001")),
    })
    doc, clf = F.col("_doc"), F.col("_clf")
    is_json, is_clf = doc.isNotNull(), clf.isNotNull()
    message = F.try_variant_get(doc, "$.message", "string")
    empty = F.create_map().cast("map<string,string>")
    return parsed.select(
        *df.columns,
        F.coalesce(json_timestamp(doc), F.col(arrived)).alias("timestamp"),
        F.coalesce(F.try_variant_get(doc, "$.level", "string"), F.lit("INFO")).alias("level"),
        F.when(is_json & message.isNotNull(), message).when(~is_json & is_clf, clf[1]).otherwise(text).alias("message"),
        F.when(is_json, F.coalesce(F.try_variant_get(doc, "$.context", "map<string,string>"), empty))
        .when(is_clf, F.create_map(F.lit("client"), clf[0], F.lit("status"), clf[2]))
        .otherwise(empty).alias("context"),
        (is_json & message.isNull()).alias("parse_error"),
    )


def log_error_rate(df: DataFrame, as_of: dt.datetime, window_s: int = 300, threshold: float = 0.05,
                   denominator: str = "all") -> DataFrame:
    """Errors in the window over all logs (or over the window's logs), with the anomaly flag."""
    recent = (F.col("ts") >= F.lit(as_of - dt.timedelta(seconds=window_s))) & (F.col("ts") <= F.lit(as_of))
    errors = F.count_if(recent & (F.col("level") == "ERROR"))
    total = F.count(F.lit(1)) if denominator == "all" else F.count_if(recent)
    rate = F.when(total > 0, errors / total).otherwise(0.0)
    return df.agg(rate.alias("error_rate")).select(
        "error_rate", F.lit(threshold).alias("threshold"), (F.col("error_rate") > threshold).alias("anomaly"))


def log_pattern_freq(df: DataFrame, threshold: int = 1000, message: str = "message", hex_first: bool = False) -> DataFrame:
    """Message signatures that occur more than ``threshold`` times."""
    counts = df.groupBy(log_signature(F.col(message), hex_first).alias("pattern")).agg(F.count(F.lit(1)).alias("count"))
    return counts.filter(F.col("count") > threshold)


def level_code(level: Column) -> Column:
    code = F.lit(4)
    for name, number in LEVEL_CODES.items():
        code = F.when(level == name, number).otherwise(code)
    return F.when(level.isNull(), 4).otherwise(code)


def log_features(df: DataFrame, as_of: dt.datetime, window_s: int | None = None, last: int | None = None) -> DataFrame:
    """Length, words, special characters, level code and seconds from the log's own time to ``as_of`` of every message.

    With ``window_s`` only the logs of that window, with ``last`` only the newest ones are kept.
    """
    if window_s is not None:
        df = df.filter((F.col("ts") >= F.lit(as_of - dt.timedelta(seconds=window_s))) & (F.col("ts") <= F.lit(as_of)))
    if last is not None:
        df = df.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(last)
    message = F.col("message")
    words = F.filter(F.split(message, r"\s+"), lambda w: w != "")
    return df.select(
        "*", F.length(message).alias("length"), F.size(words).alias("words"),
        F.length(F.regexp_replace(message, r"[\p{L}\p{N}]", "")).alias("special"),
        level_code(F.col("level")).alias("level_code"),
        ((F.unix_micros(F.lit(as_of)) - F.unix_micros("timestamp")) / 1e6).alias("age_s"))


def error_alerts(rate: DataFrame, source: str = "log-processor") -> DataFrame:
    """One alert payload per error-rate anomaly row of :func:`log_error_rate`."""
    # Names and texts of the payload.
    detail = F.struct(F.lit("statistical").alias("method"), F.lit("error_rate").alias("type"),
                      F.col("error_rate").alias("value"), "threshold")
    payload = F.struct(F.lit("1 log anomalies detected").alias("summary"), F.lit("critical").alias("severity"),
                       F.lit(source).alias("source"), F.array(detail).alias("custom_details"))
    return rate.filter("anomaly").select(
        F.to_json(F.struct(F.lit("trigger").alias("event_action"), payload.alias("payload"))).alias("alert"))
