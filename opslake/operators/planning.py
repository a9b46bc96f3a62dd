"""SLA rewards, replica counts, cost plans and price summaries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslake.operators.folds import cooldown_replay
from opslake.operators.ordered import attach, exact_quantiles, fit_time, ranked, rolling, value_band
from opslake.session import staged


@dataclass(frozen=True)
class SlaGoals:
    """Fixed values: (target, limit) per metric, weights, bounds of the resource penalty."""

    latency_ms: tuple[float, float] = (100, 500)
    throughput_rps: tuple[float, float] = (1000, 500)
    error_rate: tuple[float, float] = (0.01, 0.05)
    availability: tuple[float, float] = (0.999, 0.99)
    weights: dict[str, float] = field(default_factory=lambda: {
        "latency": 0.4, "throughput": 0.3, "error_rate": 0.2, "availability": 0.1})

    def __post_init__(self):
        for name in ("latency_ms", "error_rate"):
            target, limit = getattr(self, name)
            if target >= limit:
                raise ValueError(f"{name}: lower is better, the target must be below the limit")
        for name in ("throughput_rps", "availability"):
            target, limit = getattr(self, name)
            if target <= limit:
                raise ValueError(f"{name}: higher is better, the target must be above the limit")
        if abs(sum(self.weights.values()) - 1) > 0.001:
            raise ValueError(f"the weights add up to {sum(self.weights.values())}, not to one")


# Metric name -> column of a system state row.
STATE_COLUMNS = {"latency": "latency_ms", "throughput": "throughput_rps", "error_rate": "error_rate",
                 "availability": "availability"}


def reward_terms(goals: SlaGoals = SlaGoals()) -> dict[str, Column]:
    """The four SLA pieces, one Column each."""
    lat, thr, err, av = (F.col(c) for c in STATE_COLUMNS.values())
    lat_t, lat_max = goals.latency_ms
    thr_t, thr_min = goals.throughput_rps
    err_t, err_max = goals.error_rate
    av_t, av_min = goals.availability
    return {
        "latency": F.when(lat <= lat_t, 1.0).when(lat > lat_max, -2.0).otherwise(
            1.0 - F.pow((lat - lat_t) / (lat_max - lat_t), F.lit(1.5))),
        "throughput": F.when(thr >= thr_t, 1.0).when(thr < thr_min, -1.5).otherwise(
            (thr - thr_min) / (thr_t - thr_min)),
        "error_rate": F.when(err <= err_t, 1.0).when(err > err_max, -3.0).otherwise(1.0 - F.exp(5 * (err - err_t))),
        "availability": F.when(av >= av_t, 1.0).when(av < av_min, -2.5).otherwise(0.5),
    }


def violations(goals: SlaGoals = SlaGoals()) -> dict[str, Column]:
    return {
        "latency": F.col("latency_ms") > goals.latency_ms[1],
        "throughput": F.col("throughput_rps") < goals.throughput_rps[1],
        "error_rate": F.col("error_rate") > goals.error_rate[1],
        "availability": F.col("availability") < goals.availability[1],
    }


def resource_penalty(usage: Column) -> Column:
    """Penalty over a map of resource shares: too full above 0.8, idle below 0.2."""

    def step(total, share):
        return total + F.when(share > 0.8, -0.5 * (share - 0.8) * 10).when(share < 0.2, -0.2 * (0.2 - share) * 5).otherwise(0.0)

    return F.aggregate(F.map_values(usage), F.lit(0.0), step)


def reward_dynamic_weights(states: DataFrame, keys: Sequence[str], order: Sequence[str], goals: SlaGoals = SlaGoals(),
                           warmup: int = 300, recent: int = 100, bucket: Column | None = None) -> DataFrame:
    """Add ``w_<metric>``: weights raised by 1 + tanh((mean - target) / std) of the last ``recent`` rows,
    then normalised. Until ``warmup`` rows exist the configured weights apply."""
    bucket = fit_time(states, keys, order[0]) if bucket is None else bucket
    placed = ranked(states, keys, [F.col(c) for c in order], bucket, "_rank")
    stats = {}
    for name, column in STATE_COLUMNS.items():
        stats[f"_mean_{name}"] = lambda frame, c=column: frame[c].mean()
        stats[f"_std_{name}"] = lambda frame, c=column: frame[c].std()
    framed = rolling(placed, keys, "_rank", recent, stats)
    raw = {}
    for name, column in STATE_COLUMNS.items():
        risk = (F.col(f"_mean_{name}") - getattr(goals, column)[0]) / F.col(f"_std_{name}")
        raw[name] = F.when(F.col(f"_std_{name}") > 0, goals.weights[name] * (1 + F.tanh(risk))).otherwise(goals.weights[name])
    total = sum(raw.values(), F.lit(0.0))
    out = framed.withColumns({f"w_{n}": F.when(F.col("_rank") < warmup, goals.weights[n]).otherwise(c / total)
                              for n, c in raw.items()})
    return out.drop("_rank", *stats)


def sla_reward(states: DataFrame, goals: SlaGoals = SlaGoals(), usage: str = "usage", digits: int | None = 4) -> DataFrame:
    """Reward (4 decimals) and violation flags. Uses ``w_<metric>`` columns where present."""
    weights = {n: F.col(f"w_{n}") if f"w_{n}" in states.columns else F.lit(w) for n, w in goals.weights.items()}
    total = sum((weights[n] * term for n, term in reward_terms(goals).items()), F.lit(0.0)) + resource_penalty(F.col(usage))
    return states.select("*", (total if digits is None else F.round(total, digits)).alias("reward"),
                         *[v.alias(f"{n}_violation") for n, v in violations(goals).items()])


def latency_p95(states: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "latency_ms", last: int = 1000,
                q: float = 0.95, chunk: int | None = None, bucket: Column | None = None) -> DataFrame:
    """Interpolated quantile over the last ``last`` rows after every row.

    Chunks of consecutive rows are handled on their own, so a long history of one key is spread out.
    """
    bucket = fit_time(states, keys, order[0]) if bucket is None else bucket
    placed = ranked(states, keys, [F.col(c) for c in order], bucket, "_rank")
    found = {"latency_p95": lambda frame: frame[value].quantile(q, interpolation="linear")}
    return rolling(placed, keys, "_rank", last, found, chunk).drop("_rank")


def desired_replicas(current: Column, cpu: Column, queue: Column, target: float = 0.7, low: int = 1, high: int = 10,
                     cpu_weight: float = 0.6, queue_weight: float = 0.4) -> Column:
    """Replicas scaled by weighted load over target, cut to whole numbers, within [low, high]."""
    wanted = (current * ((cpu * cpu_weight + queue * queue_weight) / target)).cast("int")
    return F.greatest(F.least(wanted, F.lit(high)), F.lit(low))


def autoscale_replay(states: DataFrame, keys: Sequence[str], ts: str, tie: str, desired: str = "desired",
                     current: str = "current_replicas", high: int = 10, up_wait: int = 300, down_wait: int = 600,
                     bucket: Column | None = None) -> DataFrame:
    """Scaling decisions over time with cooldowns: none at zero replicas, ``up_wait`` below the maximum,
    else ``down_wait`` seconds. Adds ``acted``, ``last_action`` and ``direction``."""
    wait = F.when(F.col(current) == 0, 0).when(F.col(current) < high, up_wait).otherwise(down_wait)
    out = cooldown_replay(states, keys, ts, tie, F.col(desired) != F.col(current), wait, bucket)
    return out.withColumn("direction", F.when(F.col("acted"), F.when(F.col(desired) > F.col(current), "up").otherwise("down")))


def cost_plan(instances: DataFrame, scenarios: DataFrame, spot_below: float = 0.9, block: int = 64) -> DataFrame:
    """Greedy purchase per scenario (scenario, max_budget, reliability, min_performance), for any number of scenarios.

    Instance types go by price per vCPU, then name. The first one whose price is over the rest of the
    budget ends the plan; otherwise as many as fit are bought, at spot price if the scenario allows it.

    The catalogue is numbered in that order and cut into blocks; every round takes all open scenarios through their next block,
    one join and one fold over at most ``block`` offers. A purchase leaves less than its price, so most plans end in the first block.
    """
    offers = instances.select("instance_type", "price", "spot_price", "vcpus", (F.col("price") / F.col("vcpus")).alias("rate"), F.lit(1).alias("_all"))
    numbered = ranked(offers, ["_all"], [F.col("rate"), F.col("instance_type")], value_band(F.col("rate")), "_at")
    offer = F.struct("_at", "instance_type", "price", "spot_price", "vcpus")
    blocks = staged(numbered.groupBy(F.floor((F.col("_at") - 1) / block).cast("long").alias("_block")).agg(
        F.array_sort(F.collect_list(offer)).alias("_offers")))

    def step(acc: Column, o: Column) -> Column:
        rest = F.col("max_budget") - acc["spent"]
        pays = F.when((F.col("reliability") < spot_below) & (o["spot_price"] > 0), o["spot_price"]).otherwise(o["price"])
        over = acc["done"] | F.coalesce(acc["spent"] + o["price"] > F.col("max_budget"), F.lit(False))
        number = F.when(over, 0).otherwise(F.coalesce(F.floor(rest / pays), F.lit(0))).cast("long")
        bought = F.struct(o["instance_type"].alias("instance_type"), number.alias("count"), pays.alias("price"))
        buys = number >= 1
        return F.struct(
            F.when(buys, acc["spent"] + pays * number).otherwise(acc["spent"]).alias("spent"),
            F.when(buys, acc["vcpus"] + o["vcpus"] * number).otherwise(acc["vcpus"]).cast("long").alias("vcpus"),
            over.alias("done"), F.when(buys, F.array_append(acc["plan"], bought)).otherwise(acc["plan"]).alias("plan"))

    empty = F.array().cast("array<struct<instance_type:string,count:bigint,price:double>>")
    start = F.struct(F.lit(0.0).alias("spent"), F.lit(0).cast("long").alias("vcpus"), F.lit(False).alias("done"), empty.alias("plan"))
    names = ["scenario", "max_budget", "reliability", "min_performance"]
    still_open = staged(scenarios.select(*names, start.alias("_s")))
    finished = []
    for number in count():
        joined = still_open.withColumn("_block", F.lit(number).cast("long")).join(blocks, "_block", "left").drop("_block")
        went = staged(joined.select(*names, F.when(F.col("_offers").isNull(), F.col("_s").withField("done", F.lit(True))).otherwise(
            F.aggregate(F.coalesce("_offers", F.array().cast(blocks.schema["_offers"].dataType)), F.col("_s"), step)).alias("_s")))
        finished.append(went.filter("_s.done"))
        still_open = went.filter("NOT _s.done")
        if still_open.isEmpty():
            break
    return reduce(DataFrame.unionByName, finished).select(
        "scenario", F.col("max_budget").cast("double").alias("max_budget"), "_s.spent", "_s.vcpus",
        (F.col("_s.vcpus") >= F.col("min_performance")).alias("meets_performance"), "_s.plan")


def spot_price_summary(prices: DataFrame, keys: Sequence[str], price: str = "price", seen_at: str = "seen_at") -> DataFrame:
    """Lowest, median and latest price per key."""
    keys = list(keys)
    base = prices.groupBy(*keys).agg(F.min(price).alias("min_price"), F.max_by(price, seen_at).alias("latest_price"))
    median = staged(exact_quantiles(prices, keys, price, {"median_price": (0.5, "cont")}))
    return attach(base, median, keys)
