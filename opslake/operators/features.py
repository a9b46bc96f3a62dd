"""Feature preparation: impute, outliers, scaling, encoding, narrowing, splitting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opslake.functions.scalars import time_features
from opslake.operators.etl import dedupe_exact
from opslake.operators.ordered import attach, exact_quantiles
from opslake.session import staged


class NullsLeft(ValueError):
    """Columns that still hold nulls when features are finished."""


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]


def column_profile(df: DataFrame) -> DataFrame:
    """(column, nulls, std, constant) for every column, in one pass; std only for numbers."""
    numeric = set(numeric_columns(df))
    cells = []
    for c in df.columns:
        std = F.stddev_samp(c) if c in numeric else F.lit(None).cast("double")
        cells.append(F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("nulls"), std.alias("std"),
                              F.coalesce(std == 0, F.lit(False)).alias("constant")))
    return df.agg(F.array(*cells).alias("_p")).select(F.inline("_p"))


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact median per column; one value per column comes to the driver."""
    if not columns:
        return {}
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    rows = exact_quantiles(long, ["column"], "value", {"median": (0.5, "cont")}).collect()
    return {r["column"]: r["median"] for r in rows}


def impute(df: DataFrame, text_default: str = "missing") -> DataFrame:
    """Null text becomes ``missing``; null numbers become the column's exact median.

    A whole-number column with nulls turns into doubles, so that the median keeps its fraction.
    """
    numeric = numeric_columns(df)
    with_nulls = []
    if numeric:
        counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in numeric]).first()
        with_nulls = [c for c in numeric if counts[c]]
    middle = medians(df, with_nulls)
    changed = {c: F.coalesce(c, F.lit(text_default)) for c in text_columns(df)}
    changed |= {c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in middle.items()}
    return df.withColumns(changed) if changed else df


def iqr_filter(df: DataFrame, columns: Sequence[str] | None = None, factor: float = 1.5) -> DataFrame:
    """Column by column, keep rows within the quartiles extended by ``factor`` times their distance.

    Each column's quartiles are those of the rows the columns before have left. The bounds are two
    numbers per column, used as literals, so later steps filter during the scan.
    """
    for c in numeric_columns(df) if columns is None else columns:
        found = exact_quantiles(df, [], c, {"low": (0.25, "cont"), "high": (0.75, "cont")}).first()
        if found is None or found["low"] is None:
            continue
        reach = factor * (found["high"] - found["low"])
        df = df.filter((F.col(c) >= found["low"] - reach) & (F.col(c) <= found["high"] + reach))
    return df


def zscore(df: DataFrame, columns: Sequence[str] | None = None) -> tuple[DataFrame, dict[str, dict[str, float]]]:
    """Scale by mean and sample deviation, skipping constant columns. Returns (rows, statistics used)."""
    columns = numeric_columns(df) if columns is None else list(columns)
    if not columns:
        return df, {}
    row = df.agg(*[F.avg(c).alias(f"{c}#m") for c in columns], *[F.stddev_samp(c).alias(f"{c}#s") for c in columns]).first()
    stats = {c: {"mean": row[f"{c}#m"], "std": row[f"{c}#s"]} for c in columns if row[f"{c}#s"] and row[f"{c}#s"] > 0}
    scaled = {c: (F.col(c) - s["mean"]) / s["std"] for c, s in stats.items()}
    return (df.withColumns(scaled) if scaled else df), stats


def hash_encode(c: Column, buckets: int = 1000) -> Column:
    """Repeatable bucket of a text."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long") % buckets


def freq_encode(df: DataFrame, column: str, output: str | None = None) -> DataFrame:
    """Replace a value by its share among the non-null values.

    Shares are counted before the join, so a frequent value reaches the join as one row.
    """
    counts = staged(df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0]
    shares = counts.select(column, (F.col("_n") / F.lit(float(total or 1))).alias("_share"))
    joined = attach(df, shares, [column])
    target = output or column
    return joined.withColumn(target, F.col("_share")).drop("_share")


def onehot(df: DataFrame, column: str) -> DataFrame:
    """One 0/1 column per level but the first (in sorted order); null gives zeros.

    The levels become the schema, so they come to the driver; see :func:`onehot_sparse` for columns of many levels.
    """
    levels = [r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column).collect()]
    return df.select("*", *[F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{column}_{v}")
                            for v in levels[1:]]).drop(column)


def onehot_sparse(df: DataFrame, column: str, output: str | None = None) -> DataFrame:
    """The same encoding as one long column for any number of levels: the number of the level's 0/1 column, from 1.

    Null and the first level have no column of their own: null and 0. Levels are numbered in a table by value
    range and joined, nothing is collected.
    """
    levels = staged(df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n")))
    head = F.substring(F.col(column).cast("string"), 1, 2)
    before = Window.orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)
    heads = levels.groupBy(head.alias("_head")).agg(F.count(F.lit(1)).alias("_n")).select(
        "_head", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_head").orderBy(F.col(column).cast("string"))
    numbered = levels.withColumn("_head", head).withColumn("_at", F.row_number().over(inside)).join(heads, "_head").select(
        column, (F.col("_before") + F.col("_at") - 1).alias("_code"))
    joined = attach(df, numbered, [column])
    return joined.withColumn(output or column, F.col("_code")).drop("_code")


# Fixed value: the largest change by which a double still counts as a float.
FLOAT_TOLERANCE = 5e-4
_INTEGERS = [(T.ByteType(), 7), (T.ShortType(), 15), (T.IntegerType(), 31), (T.LongType(), 63)]


def narrow_types(df: DataFrame) -> DataFrame:
    """Smallest integer or float type that holds each numeric column's values.

    Doubles become floats where no value changes by more than ``FLOAT_TOLERANCE``.
    """
    ints = [f.name for f in df.schema if isinstance(f.dataType, T.IntegralType)]
    floats = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    if not ints and not floats:
        return df

    def finite(c: str) -> Column:
        return F.abs(c) <= 3.4028234e38

    ranges = df.agg(*[fn(c).alias(f"{c}#{n}") for c in ints + floats for n, fn in (("lo", F.min), ("hi", F.max))],
                    *[F.max(F.abs(F.col(c) - F.when(finite(c), F.col(c)).cast("float").cast("double"))).alias(f"{c}#off")
                      for c in floats]).first()
    out = {}
    for c in ints:
        lo, hi = ranges[f"{c}#lo"], ranges[f"{c}#hi"]
        if lo is not None:
            kind = next(t for t, bits in _INTEGERS if -(2 ** bits) <= lo and hi < 2 ** bits)
            out[c] = F.col(c).cast(kind)
    for c in floats:
        lo, hi = ranges[f"{c}#lo"], ranges[f"{c}#hi"]
        if lo is not None and max(abs(lo), abs(hi)) <= 3.4028234e38 and ranges[f"{c}#off"] <= FLOAT_TOLERANCE:
            out[c] = F.col(c).cast("float")
    return df.withColumns(out) if out else df


def stratified_split(df: DataFrame, stratum: str | None, row_key: Sequence[str], test_share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """(train, test): in every stratum the first round(n * share) rows by hash of the row key are test rows.

    The row at the cut is found from counts per hash prefix and then only among the rows of one
    prefix; the split itself is a filter against one cut per stratum, without moving the rows.
    """
    keys = [stratum] if stratum else []
    hashed = df.withColumn("_hash", F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in row_key])))
    hashed = hashed.withColumn("_prefix", F.substring("_hash", 1, 4))
    place = F.struct("_hash", *row_key)
    per_key = Window.partitionBy(*keys)
    running = per_key.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, 0)
    wanted, upto, count = F.round(F.col("_size") * test_share), F.col("_upto"), F.col("_n")
    target = staged(
        hashed.groupBy(*keys, "_prefix").agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_prefix", "_n", F.sum("_n").over(running).alias("_upto"), F.sum("_n").over(per_key).alias("_size"))
        .filter((upto - count < wanted) & (wanted <= upto))
        .select(*keys, "_prefix", (wanted - upto + count).cast("long").alias("_nth"))
    )
    inside = Window.partitionBy(*keys).orderBy(place)
    cuts = staged(
        attach(hashed.select(*dict.fromkeys([*keys, "_prefix", "_hash", *row_key])), target, [*keys, "_prefix"], "inner")
        .withColumn("_at", F.row_number().over(inside)).filter(F.col("_at") == F.col("_nth"))
        .select(*keys, place.alias("_cut"))
    )
    judged = attach(hashed, cuts, keys).withColumn("_test", F.coalesce(place <= F.col("_cut"), F.lit(False)))
    return tuple(judged.filter(F.col("_test") == wants).select(*df.columns) for wants in (False, True))


def require_no_nulls(df: DataFrame) -> DataFrame:
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first()
    bad = [c for c in df.columns if counts[c]]
    if bad:
        raise NullsLeft(f"nulls are left in {', '.join(bad)}")
    return df


def encode_text(df: DataFrame, encoders: Sequence[str]) -> DataFrame:
    """Encode every text column: ``hash``, else ``frequency``, else one-hot."""
    for c in text_columns(df):
        if "hash" in encoders:
            df = df.withColumn(c, hash_encode(F.col(c)))
        elif "frequency" in encoders:
            df = freq_encode(df, c)
        else:
            df = onehot(df, c)
    return df


def prepare(df: DataFrame, encoders: Sequence[str] = ()) -> DataFrame:
    """Clean, scale, encode, add time features, check for nulls and narrow the types.

    The rows are staged after duplicate removal and after encoding; the steps between are projections
    and filters with literal bounds, so their statistics read the staged rows.
    """
    scaled, _ = zscore(iqr_filter(impute(staged(dedupe_exact(df)))))
    encoded = time_features(encode_text(scaled, encoders), *datetime_columns(scaled))
    return narrow_types(require_no_nulls(staged(encoded)))
