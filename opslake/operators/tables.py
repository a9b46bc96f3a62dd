"""Table maintenance: versioned upserts, audits, patches, checks, filters and paging."""

from __future__ import annotations

import datetime as dt
import operator
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslake.operators.ordered import fit_range, with_previous


def versioned_writes(current: DataFrame, incoming: DataFrame, key: str = "agent_id", version: str = "version",
                     order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Optimistic locking. Returns (rows of the keys that change, conflicting rows with the stored version).

    A new key is inserted, a known key is updated when the incoming version equals the stored one;
    the version then grows by one. One write per key and batch is accepted: the lowest version, then
    the first by ``order``, then the smallest row. Which write wins is decided on (key, version) groups; only
    writes that tie in all three are numbered.
    """
    stored = current.select(key, F.col(version).alias("_stored"))
    groups = incoming.groupBy(key, version).agg(F.min(order).alias("_first")).join(stored, key, "left")
    accepted = F.col("_stored").isNull() | (F.col(version) == F.col("_stored"))
    winners = groups.groupBy(key).agg(
        F.max("_stored").alias("_stored"),
        F.min(F.when(accepted, F.struct(F.col(version), F.col("_first")))).alias("_win"))
    rest = [F.col(c) for c in incoming.columns if c not in (key, version, order)]
    tied = Window.partitionBy(key, version, order).orderBy(F.to_json(F.struct(*rest)) if rest else F.lit(0))
    judged = incoming.join(winners, key, "left").withColumn("_copy", F.row_number().over(tied)).withColumn(
        "_wins", F.coalesce((F.col(version) == F.col(f"_win.{version}")) & (F.col(order) == F.col("_win._first"))
                            & (F.col("_copy") == 1), F.lit(False))).drop("_copy")
    conflicts = judged.filter(~F.col("_wins")).drop("_win", "_wins").withColumnRenamed("_stored", "stored_version")
    grown = (F.coalesce("_stored", version) + 1).cast(current.schema[version].dataType).alias(version)
    return judged.filter("_wins").select(*[grown if c == version else F.col(c) for c in current.columns]), conflicts


def versioned_upsert(current: DataFrame, incoming: DataFrame, key: str = "agent_id", version: str = "version",
                     order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(merged table, conflicting rows) of :func:`versioned_writes`."""
    writes, conflicts = versioned_writes(current, incoming, key, version, order)
    fields = [c for c in current.columns if c != key]
    merged = current.join(writes.select(key, F.struct(*fields).alias("_new")), key, "full_outer").select(
        key, *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in fields])
    return merged, conflicts


def upsert(current: DataFrame, incoming: DataFrame, key: str, changing: Sequence[str], order: str | None = None) -> DataFrame:
    """Insert new keys; for known keys only the ``changing`` columns take the incoming values.

    Several incoming rows of one key apply in ``order``: the first one inserts, the last one sets the
    changing columns.
    """
    rest = [c for c in current.columns if c != key and c not in changing]
    first, last = F.struct(*rest), F.struct(*changing)
    if order is None:
        folded = incoming.select(key, first.alias("_first"), last.alias("_last"))
    else:
        folded = incoming.groupBy(key).agg(F.min_by(first, order).alias("_first"), F.max_by(last, order).alias("_last"))
    known = current.withColumn("_known", F.lit(True))
    joined = known.join(folded, key, "full_outer")
    return joined.select(*[
        F.col(key) if c == key else
        F.when(F.col("_last").isNotNull(), F.col(f"_last.{c}")).otherwise(F.col(c)).alias(c) if c in changing else
        F.when(F.col("_known").isNull(), F.col(f"_first.{c}")).otherwise(F.col(c)).alias(c)
        for c in current.columns])


def audit_diff(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str], model: str) -> DataFrame:
    """One UPDATE record per changed row: the changed columns with old and new value, and the full new row."""
    pair = old.select(key, *[F.col(c).alias(f"_old_{c}") for c in columns]).join(new.select(key, *columns), key)
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"_old_{c}").cast("string").alias("old"),
                      F.col(c).cast("string").alias("new")) for c in columns]
    changed = reduce(operator.or_, [~F.col(c).eqNullSafe(F.col(f"_old_{c}")) for c in columns])
    return pair.filter(changed).select(
        F.lit("UPDATE").alias("action"), F.lit(model).alias("model_type"), F.col(key).alias("model_id"),
        F.filter(F.array(*cells), lambda x: ~x["old"].eqNullSafe(x["new"])).alias("diff"),
        F.to_json(F.struct(key, *columns)).alias("row"))


def soft_delete(df: DataFrame, condition: Column) -> DataFrame:
    return df.withColumn("is_deleted", F.when(condition, True).otherwise(F.col("is_deleted")))


def purge(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return delete_by_ids(df, ids, key)


def delete_by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def live_rows(df: DataFrame, tenant=None) -> DataFrame:
    """Rows not soft-deleted, of one tenant if given."""
    df = df.filter(~F.col("is_deleted"))
    return df if tenant is None else df.filter(F.col("tenant_id") == tenant)


def find_by(df: DataFrame, **equal) -> DataFrame:
    for name, value in equal.items():
        df = df.filter(F.col(name) == value)
    return df


FILTER_OPERATORS: dict[str, Callable[[Column, object], Column]] = {
    "eq": operator.eq, "ne": operator.ne, "lt": operator.lt, "le": operator.le, "gt": operator.gt, "ge": operator.ge,
    "in": lambda c, v: c.isin(list(v)), "like": lambda c, v: c.like(v), "startswith": lambda c, v: c.startswith(v),
    "contains": lambda c, v: c.contains(v), "is_null": lambda c, v: c.isNull() if v else c.isNotNull(),
}


def apply_filters(df: DataFrame, allowed: dict[str, tuple[str, str]], params: dict) -> DataFrame:
    """Filter by the parameters named in ``allowed`` (parameter -> (column, operator)); others are ignored."""
    for name, value in params.items():
        if name in allowed:
            column, op = allowed[name]
            df = df.filter(FILTER_OPERATORS[op](F.col(column), value))
    return df


def metadata_filter(wanted: dict | None, field: Callable[[str], Column] = F.col) -> Column:
    """Conjunction over the dict: a list means membership, anything else equality; empty means all rows."""
    parts = [field(k).isin(v) if isinstance(v, list) else field(k) == v for k, v in (wanted or {}).items()]
    return reduce(operator.and_, parts, F.lit(True))


def json_field(body: str) -> Callable[[str], Column]:
    """Field access for :func:`metadata_filter` on a JSON text column."""
    return lambda k: F.get_json_object(body, f"$.{k}")


def map_field(column: str) -> Callable[[str], Column]:
    """Field access for :func:`metadata_filter` on a map column."""
    return lambda k: F.col(column)[k]


def ttl_live(df: DataFrame, as_of: dt.datetime, saved_at: str = "saved_at", ttl_s: str | int = 3600) -> DataFrame:
    """Rows whose time to live has not passed at ``as_of``; a null time to live never ends."""
    if isinstance(ttl_s, int):
        return df.filter(F.col(saved_at) > F.lit(as_of - dt.timedelta(seconds=ttl_s)))
    ends = F.unix_micros(saved_at) + F.col(ttl_s).cast("long") * 1_000_000
    return df.filter(F.col(ttl_s).isNull() | (ends > F.unix_micros(F.lit(as_of))))


def agent_filter(text: str) -> Column:
    """Predicate from ``k=v,k.sub=v``; values compare without case."""
    condition = F.lit(True)
    for part in filter(None, (p.strip() for p in text.split(","))):
        name, value = part.split("=", 1)
        condition = condition & (F.upper(F.col(name.strip()).cast("string")) == value.strip().upper())
    return condition


def keyset_page(df: DataFrame, key: str, page_size: int, token=None) -> DataFrame:
    """Next page after ``token``; the last key of a page is the token of the next."""
    if token is not None:
        df = df.filter(F.col(key) > F.lit(token))
    return df.orderBy(key).limit(page_size)


def list_agents(df: DataFrame, filter_text: str = "", page_size: int = 100, page_token=None, key: str = "id") -> DataFrame:
    return keyset_page(df.filter(agent_filter(filter_text)), key, page_size, page_token)


def page(df: DataFrame, order: Sequence[Column | str], number: int, per_page: int) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * per_page).limit(per_page)


def page_info(df: DataFrame, per_page: int) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / per_page))


def agent_active(status: Column) -> Column:
    return status != "terminated"


def check_constraints(df: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """(key, constraint) for every failed check, all checks in one pass. Unknown counts as passed."""
    failed = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]))
    return df.select(key, F.explode(failed).alias("constraint"))


def not_null(column: str) -> Column:
    return F.col(column).isNotNull()


def max_length(column: str, n: int) -> Column:
    return F.length(column) <= n


def one_of(column: str, values: Sequence[str]) -> Column:
    return F.col(column).isin(list(values))


def json_patch(df: DataFrame, body: str, updates: dict[str, Column]) -> DataFrame:
    """Set top-level fields of a JSON object column; other fields keep their value and type."""
    if not updates:
        return df
    doc = F.try_variant_get(F.parse_json(body), "$", "map<string,variant>")
    kept = F.map_filter(doc, lambda k, v: ~k.isin(list(updates)))
    wrapped = F.create_map(*[x for k, v in updates.items() for x in (F.lit(k), F.parse_json(F.to_json(F.array(v))))])
    added = F.transform_values(wrapped, lambda k, v: F.variant_get(v, "$[0]", "variant"))
    return df.withColumn(body, F.to_json(F.map_concat(kept, added)))


def row_stats(df: DataFrame, partition: Sequence[str] = ()) -> DataFrame:
    """Rows per partition value, or in total."""
    return df.groupBy(*partition).agg(F.count(F.lit(1)).alias("row_count"))


# Legal moves of the agent lifecycle.
TRANSITIONS = [("CREATED", "INITIALIZED"), ("CREATED", "ERROR"), ("INITIALIZED", "RUNNING"), ("INITIALIZED", "STOPPED"),
               ("RUNNING", "PAUSED"), ("RUNNING", "STOPPED"), ("RUNNING", "ERROR"), ("PAUSED", "RUNNING"),
               ("PAUSED", "STOPPED"), ("ERROR", "STOPPED")]


def illegal_transitions(log: DataFrame, key: str = "agent_id", order: str = "seq", state: str = "state",
                        initial: str = "CREATED", bucket: Column | None = None) -> DataFrame:
    """Moves in a lifecycle log that are not allowed; the first state follows ``initial``."""
    bucket = fit_range(log, [key], order) if bucket is None else bucket
    moves = with_previous(log, [key], [order], bucket, {state: "previous"}).withColumn(
        "previous", F.coalesce("previous", F.lit(initial)))
    legal = reduce(operator.or_, [(F.col("previous") == a) & (F.col(state) == b) for a, b in TRANSITIONS])
    return moves.filter(~legal)


def active_clients(heartbeats: DataFrame, as_of: dt.datetime, ttl_s: int = 30, client: str = "agent_id",
                   ts: str = "ts") -> DataFrame:
    """Last heartbeat per client, and whether it is within the time to live at ``as_of``."""
    last = heartbeats.filter(F.col(ts) <= F.lit(as_of)).groupBy(client).agg(F.max(ts).alias("last_seen"))
    return last.withColumn("active", F.col("last_seen") > F.lit(as_of - dt.timedelta(seconds=ttl_s)))


def sync_nodes(current: DataFrame, desired: DataFrame, key: str = "node_id",
               updated: Sequence[str] = ("weight", "address")) -> DataFrame:
    """Action per node: remove, update (weight and address taken over), add or keep."""
    now = current.select(key, *[F.col(c).alias(f"_now_{c}") for c in updated], F.lit(True).alias("_here"))
    then = desired.select(key, *updated, F.lit(True).alias("_wanted"))
    same = reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"_now_{c}")) for c in updated])
    both = now.join(then, key, "full_outer")
    action = (F.when(F.col("_wanted").isNull(), "remove").when(F.col("_here").isNull(), "add")
              .when(same, "keep").otherwise("update"))
    return both.select(key, action.alias("action"), *[
        F.coalesce(F.col(c), F.when(F.col("_wanted").isNull(), F.col(f"_now_{c}"))).alias(c) for c in updated])
