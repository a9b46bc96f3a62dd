"""SLA, log, metric and trace queries."""

import datetime as dt

from pyspark.sql import functions as F

from opslake.functions import scalars as S
from opslake.operators import logs, metrics, sla, traces
from opslake.plans.catalog import query
from opslake.sources import sinks

AS_OF = dt.datetime(2024, 1, 31)
_WEEK = 7 * 86400
_SINCE = "ts >= TIMESTAMP '2024-01-24 00:00:00' AND ts <= TIMESTAMP '2024-01-31 00:00:00'"
_P99 = "list_sort(list(latency))[count(*) - CAST(floor(count(*) * (1 - 0.99)) AS BIGINT)]"
_AVAIL = "count(*) FILTER (success) / count(*) * 100"


def _r(name, digits=6):
    return F.round(name, digits).alias(name)


@query("sla_availability", f"SELECT service, round({_AVAIL}, 6) AS availability FROM v_requests GROUP BY service")
def _(t):
    return sla.availability(t("v_requests"), ["service"]).select("service", _r("availability"))


@query("sla_latency_pctl", f"SELECT service, {_P99} AS latency_p99 FROM v_requests GROUP BY service")
def _(t):
    return sla.latency_quantile(t("v_requests"), ["service"], 0.99, name="latency_p99")


@query("sla_throughput", """SELECT service, round(count(*) / 2592000.0, 9) AS throughput FROM v_requests
WHERE ts >= TIMESTAMP '2024-01-01 00:00:00' AND ts <= TIMESTAMP '2024-01-31 00:00:00' GROUP BY service""")
def _(t):
    rows = sla.in_window(t("v_requests"), AS_OF, 30 * 86400)
    return sla.throughput(rows, 30 * 86400, ["service"]).select("service", _r("throughput", 9))


@query("sla_compliance", f"""WITH m AS (SELECT service, {_AVAIL} AS availability, {_P99} AS latency_p99,
  count(*) / 604800.0 AS throughput FROM v_requests WHERE {_SINCE} GROUP BY service)
SELECT service, 'availability' AS metric, round(availability, 6) AS actual, 99.95::DOUBLE AS target, availability >= 99.95 AS ok FROM m
UNION ALL SELECT service, 'latency_p99', round(latency_p99, 6), 0.5, latency_p99 <= 0.5 FROM m
UNION ALL SELECT service, 'throughput', round(throughput, 6), 1000, throughput >= 1000 FROM m""")
def _(t):
    targets = {"availability": 99.95, "latency_p99": 0.5, "throughput": 1000}
    out = sla.sla_compliance(t("v_requests"), targets, AS_OF, _WEEK, ["service"])
    return out.select("service", "metric", _r("actual"), "target", "ok")


@query("sla_report", f"""SELECT service, epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS start_us,
  epoch_us(time_bucket(INTERVAL '1 hour', ts)) + 3600000000 AS end_us, round({_AVAIL}, 6) AS availability,
  {_P99} AS latency_p99, round(count(*) / 3600.0, 9) AS throughput
FROM v_requests WHERE ts >= TIMESTAMP '2024-01-01 00:00:00' AND ts < TIMESTAMP '2024-01-31 00:00:00'
GROUP BY service, time_bucket(INTERVAL '1 hour', ts)""")
def _(t):
    out = sla.sla_report(t("v_requests"), AS_OF, 30 * 86400, "1h")
    return out.select("service", F.unix_micros("slice_start").alias("start_us"), F.unix_micros("slice_end").alias("end_us"),
                      _r("availability"), "latency_p99", _r("throughput", 9))


@query("sla_sliding", f"""WITH s AS (SELECT r.*, time_bucket(INTERVAL '60 seconds', ts) - k * INTERVAL '60 seconds' AS ws
  FROM v_requests r, range(5) AS g(k))
SELECT service, epoch_us(ws) AS start_us, round({_AVAIL}, 6) AS availability, {_P99} AS latency_p99,
  round(count(*) / 300.0, 9) AS throughput FROM s GROUP BY service, ws""")
def _(t):
    return sla.sla_sliding(t("v_requests")).select(
        "service", F.unix_micros("window_start").alias("start_us"), _r("availability"), "latency_p99", _r("throughput", 9))


@query("throughput_anomalies", """WITH s AS (SELECT service, time_bucket(INTERVAL '1 hour', ts) AS h, count(*) / 3600.0 AS rps
  FROM v_requests GROUP BY ALL), m AS (SELECT service, count(*) AS n, avg(rps) AS mean, stddev_pop(rps) AS std FROM s GROUP BY service)
SELECT s.service, epoch_us(h) AS hour_us, round(rps, 9) AS rps, round((rps - mean) / std, 6) AS z_score,
  CASE WHEN rps > mean THEN 'high' ELSE 'low' END AS status
FROM s JOIN m ON s.service = m.service WHERE n >= 30 AND abs((rps - mean) / std) > 1.5""")
def _(t):
    samples = t("v_requests").groupBy("service", F.window("ts", "1 hour")["start"].alias("hour")).agg(
        (F.count(F.lit(1)) / 3600.0).alias("rps"))
    out = sla.throughput_anomalies(samples, ["service"], sensitivity=1.5)
    return out.select("service", F.unix_micros("hour").alias("hour_us"), _r("rps", 9), _r("z_score"), "status")


@query("log_context", """SELECT event_id, 'access /p' || event_id % 5 AS message, '10.1.0.' || user_id % 9 AS client, CAST(200 + event_id % 3 AS VARCHAR) AS status,
  CAST(NULL AS VARCHAR) AS zone FROM events WHERE event_id % 2 = 0 UNION ALL
SELECT event_id, 'm' || event_id, NULL, NULL, 'z' || user_id % 4 FROM events WHERE event_id % 2 = 1""")
def _(t):
    number = F.col("event_id").cast("string")
    line = F.concat(F.lit("10.1.0."), (F.col("user_id") % 9).cast("string"), F.lit(" - - [01/Jan/2024:00:00:00 +0000] \"access /p"),
                    (F.col("event_id") % 5).cast("string"), F.lit(" HTTP/1.1\" "), (200 + F.col("event_id") % 3).cast("string"), F.lit(" 12"))
    body = F.concat(F.lit('{"message":"m'), number, F.lit('","context":{"zone":"z'), (F.col("user_id") % 4).cast("string"), F.lit('"}}'))
    raw = t("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_id") % 2 == 0, line).otherwise(body).alias("raw"))
    context = F.col("context")
    return logs.log_parse(raw).select("event_id", "message", context["client"].alias("client"), context["status"].alias("status"),
                                      context["zone"].alias("zone"))


@query("log_parse", "SELECT event_id, level, message, epoch_us(ts) AS at_us, false AS parse_error FROM v_logs")
def _(t):
    return logs.log_parse(t("v_logs").select("event_id", "ts", "raw")).select(
        "event_id", "level", "message", F.unix_micros("timestamp").alias("at_us"), "parse_error")


_SIGNATURE = r"""regexp_replace(regexp_replace(regexp_replace({0}, '[0-9]+', '<NUM>', 'g'), '0x[0-9a-f]+', '<HEX>', 'g'),
'\b[A-Za-z0-9_]{{32,}}\b', '<HASH>', 'g')"""


@query("log_signature", f"SELECT doc_id, {_SIGNATURE.format('text')} AS signature FROM documents")
def _(t):
    return t("documents").select("doc_id", S.log_signature(F.col("text")).alias("signature"))


@query("log_error_rate", f"""SELECT round(count(*) FILTER (level = 'ERROR' AND {_SINCE}) / count(*), 9) AS error_rate,
0.02::DOUBLE AS threshold, count(*) FILTER (level = 'ERROR' AND {_SINCE}) / count(*) > 0.02 AS anomaly FROM v_logs""")
def _(t):
    parsed = logs.log_parse(t("v_logs").select("event_id", "ts", "raw"))
    return logs.log_error_rate(parsed, AS_OF, _WEEK, 0.02).select(_r("error_rate", 9), "threshold", "anomaly")


@query("log_pattern_freq", f"""SELECT {_SIGNATURE.format('message')} AS pattern, count(*) AS count FROM v_logs
GROUP BY 1 HAVING count(*) > 50""")
def _(t):
    return logs.log_pattern_freq(logs.log_parse(t("v_logs").select("event_id", "ts", "raw")), 50)


@query("log_features", """SELECT event_id, CAST(length(message) AS INT) AS length,
  CAST(len(list_filter(regexp_split_to_array(message, '\\s+'), lambda w: w <> '')) AS INT) AS words,
  CAST(length(regexp_replace(message, '[\\p{L}\\p{N}]', '', 'g')) AS INT) AS special,
  CASE level WHEN 'DEBUG' THEN 0 WHEN 'INFO' THEN 1 WHEN 'WARN' THEN 2 WHEN 'ERROR' THEN 3 ELSE 4 END AS level_code,
  round((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) / 1e6, 6) AS age_s FROM v_logs""")
def _(t):
    rows = logs.log_features(logs.log_parse(t("v_logs").select("event_id", "ts", "raw")), AS_OF)
    return rows.select("event_id", "length", "words", "special", "level_code", _r("age_s"))


@query("alert_rows", f"""WITH r AS (SELECT count(*) FILTER (level = 'ERROR' AND {_SINCE}) / count(*) AS rate FROM v_logs)
SELECT 'trigger' AS event_action, 'critical' AS severity, '1 log anomalies detected' AS summary, round(rate, 9) AS value
FROM r WHERE rate > 0.001""")
def _(t):
    parsed = logs.log_parse(t("v_logs").select("event_id", "ts", "raw"))
    alerts = logs.error_alerts(logs.log_error_rate(parsed, AS_OF, _WEEK, 0.001))

    def at(path):
        return F.get_json_object("alert", path)

    return alerts.select(at("$.event_action").alias("event_action"), at("$.payload.severity").alias("severity"),
                         at("$.payload.summary").alias("summary"),
                         F.round(at("$.payload.custom_details[0].value").cast("double"), 9).alias("value"))


@query("metric_counters", "SELECT method, path, status, count(*) AS value FROM v_requests GROUP BY ALL")
def _(t):
    return metrics.metric_counters(t("v_requests"), ["method", "path", "status"])


@query("metric_histogram", """WITH b AS (SELECT * FROM (VALUES ('0.01', 0.01), ('0.1', 0.1), ('0.5', 0.5), ('1.0', 1.0),
  ('5.0', 5.0), ('10.0', 10.0), ('+Inf', 1e300)) AS x(le, bound))
SELECT method, status, le, count(*) FILTER (latency <= bound) AS bucket, count(*) AS count, round(sum(latency), 4) AS sum
FROM v_requests, b GROUP BY method, status, le""")
def _(t):
    out = metrics.metric_histogram(t("v_requests"), ["method", "status"], "latency", metrics.HTTP_BUCKETS)
    return out.select("method", "status", "le", "bucket", "count", _r("sum", 4))


@query("metric_gauge", """SELECT 'latency' AS name, 'gauge' AS type, service, path, round(arg_max(latency, event_id), 9) AS value
FROM v_requests GROUP BY service, path""")
def _(t):
    last = metrics.metric_gauge(t("v_requests"), ["service", "path"], "latency", ["ts", "event_id"])
    out = metrics.metric_snapshot(last, "latency", "gauge", ["service", "path"])
    return out.select("name", "type", F.col("labels")["service"].alias("service"), F.col("labels")["path"].alias("path"),
                      _r("value", 9))


@query("metric_name_valid", """SELECT path, regexp_full_match(path, '[a-zA-Z_:][a-zA-Z0-9_:]*') AS valid,
regexp_full_match(substr(path, 2), '[a-zA-Z_:][a-zA-Z0-9_:]*') AS valid_tail FROM v_requests""")
def _(t):
    return t("v_requests").select("path", S.metric_name_valid(F.col("path")).alias("valid"),
                                  S.metric_name_valid(F.expr("substr(path, 2)")).alias("valid_tail"))


@query("tsdb_rows", f"""SELECT service AS measurement, 'prod' AS env, round({_AVAIL}, 6) AS availability, {_P99} AS latency_p99
FROM v_requests WHERE {_SINCE} GROUP BY service""")
def _(t):
    m = sla.sla_metrics(sla.in_window(t("v_requests"), AS_OF, _WEEK), ["service"], _WEEK).withColumn("env", F.lit("prod"))
    out = sinks.tsdb_rows(m, F.col("service"), ["env"], ["availability", "latency_p99"])
    return out.select("measurement", F.col("tags")["env"].alias("env"),
                      F.round(F.col("fields")["availability"], 6).alias("availability"),
                      F.col("fields")["latency_p99"].alias("latency_p99"))


@query("tail_sample", """SELECT span_id, trace_id, service FROM v_spans WHERE error OR priority = 'high' OR trace_id % 5 = 0""")
def _(t):
    return traces.tail_sample(t("v_spans")).select("span_id", "trace_id", "service")


@query("service_topology", """SELECT p.service AS source, c.service AS target, count(*) AS calls
FROM v_spans c JOIN v_spans p ON c.parent_id = p.span_id GROUP BY ALL""")
def _(t):
    return traces.service_topology(t("v_spans"))


@query("topology_nodes", "SELECT service AS id, count(*) AS spans FROM v_spans GROUP BY service")
def _(t):
    return traces.topology_nodes(t("v_spans"))


@query("attrs_sanitize", """SELECT event_id, '<REDACTED>' AS api_key, '<REDACTED>' AS password_hint, event_type AS kind,
CAST(user_id AS VARCHAR) AS user_id FROM events""")
def _(t):
    attributes = F.create_map(F.lit("Api_KEY"), F.col("props"), F.lit("passwordHint"), F.col("event_type"),
                              F.lit("kind"), F.col("event_type"), F.lit("user_id"), F.col("user_id").cast("string"))
    out = t("events").select("event_id", S.attrs_sanitize(attributes).alias("a"))
    return out.select("event_id", *[F.col("a")[k].alias(n) for k, n in [
        ("Api_KEY", "api_key"), ("passwordHint", "password_hint"), ("kind", "kind"), ("user_id", "user_id")]])


@query("attrs_redact_keys", """SELECT event_id, '<REDACTED>' AS auth, '<REDACTED>' AS kind, props AS secret FROM events""")
def _(t):
    attributes = F.create_map(F.lit("Authorization"), F.col("props"), F.lit("kind"), F.col("event_type"),
                              F.lit("secret"), F.col("props"))
    out = t("events").select("event_id", S.attrs_redact_keys(attributes, ["kind"]).alias("a"))
    return out.select("event_id", F.col("a")["Authorization"].alias("auth"), F.col("a")["kind"].alias("kind"),
                      F.col("a")["secret"].alias("secret"))
