"""Planning, scoring and moving-average queries."""

from pyspark.sql import functions as F

from opslake.operators import folds, planning
from opslake.plans.catalog import query


# Added before rounding so that values with few decimals do not sit on a rounding tie.
_OFF = 0.0000000337


def _states(t):
    return t("v_system_states").withColumn("usage", F.create_map(F.lit("cpu"), F.col("cpu"), F.lit("memory"), F.col("memory")))


def _pen(c):
    return f"CASE WHEN {c} > 0.8 THEN -0.5 * ({c} - 0.8) * 10 WHEN {c} < 0.2 THEN -0.2 * (0.2 - {c}) * 5 ELSE 0 END"


_TERMS = f"""SELECT *, CASE WHEN latency_ms <= 100 THEN 1.0 WHEN latency_ms > 500 THEN -2.0
    ELSE 1.0 - pow((latency_ms - 100) / 400, 1.5) END AS r_lat,
  CASE WHEN throughput_rps >= 1000 THEN 1.0 WHEN throughput_rps < 500 THEN -1.5 ELSE (throughput_rps - 500) / 500 END AS r_thr,
  CASE WHEN error_rate <= 0.01 THEN 1.0 WHEN error_rate > 0.05 THEN -3.0 ELSE 1.0 - exp(5 * (error_rate - 0.01)) END AS r_err,
  CASE WHEN availability >= 0.999 THEN 1.0 WHEN availability < 0.99 THEN -2.5 ELSE 0.5 END AS r_av,
  {_pen('cpu')} + {_pen('memory')} AS pen FROM v_system_states"""


@query("reward_terms", f"""SELECT event_id, round(r_lat, 6) AS latency, round(r_thr, 6) AS throughput, round(r_err, 6) AS error_rate,
CAST(r_av AS DOUBLE) AS availability, round(pen, 6) AS penalty FROM ({_TERMS})""")
def _(t):
    terms = planning.reward_terms()
    return _states(t).select("event_id", *[F.round(c, 6).alias(n) for n, c in terms.items()],
                             F.round(planning.resource_penalty(F.col("usage")), 6).alias("penalty"))


@query("sla_reward", f"""SELECT event_id, round(0.4 * r_lat + 0.3 * r_thr + 0.2 * r_err + 0.1 * r_av + pen + {_OFF}, 6) AS reward,
latency_ms > 500 AS latency_violation, throughput_rps < 500 AS throughput_violation, error_rate > 0.05 AS error_rate_violation,
availability < 0.99 AS availability_violation FROM ({_TERMS})""")
def _(t):
    return planning.sla_reward(_states(t), digits=None).select(
        "event_id", F.round(F.col("reward") + _OFF, 6).alias("reward"), "latency_violation", "throughput_violation", "error_rate_violation", "availability_violation")


def _weight(metric, column, weight, target):
    return f"""CASE WHEN coalesce(stddev_samp({column}) OVER w, 0) > 0 THEN {weight} * (1 + (
  (exp(2 * (avg({column}) OVER w - {target}) / stddev_samp({column}) OVER w) - 1) /
  (exp(2 * (avg({column}) OVER w - {target}) / stddev_samp({column}) OVER w) + 1))) ELSE {weight} END AS {metric}"""


@query("reward_dynamic_weights", f"""WITH r AS (SELECT event_id, row_number() OVER (PARTITION BY service ORDER BY ts, event_id) AS n,
  {_weight('a', 'least(latency_ms, 250)', 0.4, 100)}, {_weight('b', 'throughput_rps / 1000', 0.3, 1)},
  {_weight('c', 'error_rate', 0.2, 0.01)}, {_weight('d', 'availability', 0.1, 0.999)}
  FROM v_system_states WINDOW w AS (PARTITION BY service ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))
SELECT event_id, round(CASE WHEN n < 300 THEN 0.4 ELSE a / (a + b + c + d) END, 6) AS w_latency,
  round(CASE WHEN n < 300 THEN 0.3 ELSE b / (a + b + c + d) END, 6) AS w_throughput,
  round(CASE WHEN n < 300 THEN 0.2 ELSE c / (a + b + c + d) END, 6) AS w_error_rate,
  round(CASE WHEN n < 300 THEN 0.1 ELSE d / (a + b + c + d) END, 6) AS w_availability FROM r""")
def _(t):
    states = t("v_system_states").withColumns({"latency_ms": F.least("latency_ms", F.lit(250.0)),
                                               "throughput_rps": F.col("throughput_rps") / 1000})
    goals = planning.SlaGoals(throughput_rps=(1, 0.5))
    out = planning.reward_dynamic_weights(states, ["service"], ["ts", "event_id"], goals)
    return out.select("event_id", *[F.round(f"w_{n}", 6).alias(f"w_{n}") for n in goals.weights])


@query("latency_p95", """SELECT event_id, service, round(quantile_cont(latency_ms, 0.95) OVER (PARTITION BY service
ORDER BY ts, event_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW), 6) AS latency_p95 FROM v_system_states""")
def _(t):
    out = planning.latency_p95(t("v_system_states"), ["service"], ["ts", "event_id"])
    return out.select("event_id", "service", F.round("latency_p95", 6).alias("latency_p95"))


@query("ewma", f"""WITH RECURSIVE o AS (SELECT event_id, service, latency, row_number() OVER (PARTITION BY service ORDER BY ts, event_id) AS n
  FROM v_requests),
f AS (SELECT service, n, event_id, latency AS e FROM o WHERE n = 1
  UNION ALL SELECT o.service, o.n, o.event_id, CASE WHEN f.e = 0 THEN o.latency ELSE 0.95 * f.e + 0.05 * o.latency END
  FROM f JOIN o ON o.service = f.service AND o.n = f.n + 1)
SELECT event_id, service, round(e + {_OFF}, 6) AS ewma FROM f""")
def _(t):
    rows = t("v_requests").select("event_id", "service", "ts", "latency")
    out = folds.ewma(rows, ["service"], ["ts", "event_id"], "latency")
    return out.select("event_id", "service", F.round(F.col("ewma") + _OFF, 6).alias("ewma"))


@query("desired_replicas", """SELECT event_id, greatest(least(CAST(trunc(current_replicas * ((cpu * 0.6 + memory * 2 * 0.4) / 0.7)) AS INT), 10), 1)
AS desired FROM v_system_states""")
def _(t):
    return t("v_system_states").select("event_id", planning.desired_replicas(
        F.col("current_replicas"), F.col("cpu"), F.col("memory") * 2).alias("desired"))


_REPLICAS = "greatest(least(CAST(trunc(current_replicas * ((cpu * 0.6 + memory * 2 * 0.4) / 0.7)) AS INT), 10), 1)"


@query("autoscale_replay", f"""WITH RECURSIVE o AS (SELECT event_id, service, epoch_us(ts) AS t_us, {_REPLICAS} AS desired, current_replicas,
  {_REPLICAS} <> current_replicas AS ok, CASE WHEN current_replicas = 0 THEN 0 WHEN current_replicas < 10 THEN 300 ELSE 600 END * 1000000::BIGINT AS wait,
  row_number() OVER (PARTITION BY service ORDER BY ts, event_id) AS n FROM v_system_states),
f AS (SELECT service, n, event_id, ok AS acted, CASE WHEN ok THEN t_us END AS last FROM o WHERE n = 1
  UNION ALL SELECT o.service, o.n, o.event_id, o.ok AND (f.last IS NULL OR o.t_us - f.last >= o.wait),
    CASE WHEN o.ok AND (f.last IS NULL OR o.t_us - f.last >= o.wait) THEN o.t_us ELSE f.last END
  FROM f JOIN o ON o.service = f.service AND o.n = f.n + 1)
SELECT f.event_id, f.service, f.acted, CASE WHEN NOT f.acted THEN NULL WHEN desired > current_replicas THEN 'up' ELSE 'down' END AS direction
FROM f JOIN o ON o.event_id = f.event_id""")
def _(t):
    states = t("v_system_states").withColumn("desired", planning.desired_replicas(
        F.col("current_replicas"), F.col("cpu"), F.col("memory") * 2))
    out = planning.autoscale_replay(states, ["service"], "ts", "event_id")
    return out.select("event_id", "service", "acted", "direction")


@query("cost_plan", """WITH RECURSIVE s AS (SELECT r_name AS scenario, r_regionkey * 37.5::DOUBLE + 25 AS budget,
  CASE WHEN r_regionkey % 2 = 0 THEN 0.95 ELSE 0.8 END AS rel, r_regionkey * 40 + 100 AS need FROM region),
o AS (SELECT s.*, i.instance_type, i.price, i.vcpus, CASE WHEN spot_price > 0 AND rel < 0.9 THEN spot_price ELSE price END AS pays,
  row_number() OVER (PARTITION BY scenario ORDER BY price / vcpus, instance_type) AS n FROM s, v_instances i),
f AS (SELECT scenario, 0::BIGINT AS n, 0.0::DOUBLE AS spent, 0::BIGINT AS vcpus, false AS done, []::VARCHAR[] AS plan FROM s
  UNION ALL SELECT o.scenario, o.n,
    CASE WHEN f.done OR spent + price > budget THEN spent ELSE spent + pays * CAST(floor((budget - spent) / pays) AS BIGINT) END,
    CASE WHEN f.done OR spent + price > budget THEN f.vcpus ELSE f.vcpus + o.vcpus * CAST(floor((budget - spent) / pays) AS BIGINT) END,
    f.done OR spent + price > budget,
    CASE WHEN f.done OR spent + price > budget OR floor((budget - spent) / pays) = 0 THEN plan
      ELSE list_append(plan, instance_type || ':' || CAST(floor((budget - spent) / pays) AS BIGINT)) END
  FROM f JOIN o ON o.scenario = f.scenario AND o.n = f.n + 1)
SELECT f.scenario, round(spent, 6) AS spent, vcpus, vcpus >= need AS meets_performance, array_to_string(plan, ',') AS plan FROM f JOIN s ON s.scenario = f.scenario
WHERE n = (SELECT max(n) FROM o)""")
def _(t):
    scenarios = t("region").select(
        F.col("r_name").alias("scenario"), (F.col("r_regionkey") * 37.5 + 25.0).alias("max_budget"),
        F.when(F.col("r_regionkey") % 2 == 0, 0.95).otherwise(0.8).alias("reliability"),
        (F.col("r_regionkey") * 40 + 100).alias("min_performance"))
    out = planning.cost_plan(t("v_instances"), scenarios)
    return out.select("scenario", F.round("spent", 6).alias("spent"), "vcpus", "meets_performance",
                      F.array_join(F.transform("plan", lambda p: F.concat_ws(":", p["instance_type"], p["count"].cast("string"))), ",").alias("plan"))


@query("spot_price_summary", """SELECT family, zone, round(min(price), 6) AS min_price, round(median(price), 6) AS median_price,
round(arg_max(price, seen_at), 6) AS latest_price FROM v_instances GROUP BY family, zone""")
def _(t):
    out = planning.spot_price_summary(t("v_instances"), ["family", "zone"])
    return out.select("family", "zone", *[F.round(c, 6).alias(c) for c in ("min_price", "median_price", "latest_price")])
