"""Version histories and retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslake.functions.scalars import semver_bucket, semver_key, semver_matches, semver_release
from opslake.operators.ordered import ranked, with_previous


def version_history(df: DataFrame, keys: Sequence[str], version: str = "version") -> DataFrame:
    """Distinct valid versions per key in version order, with position and previous version (rollback target).

    Ordered inside (key, major, minor) groups, so one name with very many versions stays spread out.
    """
    keys = list(keys)
    distinct = (
        df.select(*keys, version).distinct().withColumn("_key", semver_key(F.col(version)))
        .filter(F.col("_key").isNotNull()).withColumn("_release", semver_release(F.col(version)))
    )
    bucket = semver_bucket(F.col("_key"))
    order = ["_key", "_release", version]
    placed = ranked(distinct, keys, [F.col(c) for c in order], bucket, "position")
    return with_previous(placed, keys, order, bucket, {version: "previous"}).drop("_key", "_release")


def latest_version(df: DataFrame, keys: Sequence[str], constraint: str = "*", version: str = "version") -> DataFrame:
    """Highest version per key that satisfies the constraint; combined before the shuffle."""
    fits = df.filter(semver_matches(F.col(version), constraint))
    order = F.struct(semver_key(F.col(version)), semver_release(F.col(version)), F.col(version))
    return fits.groupBy(*keys).agg(F.max_by(version, order).alias(version))


def retention(df: DataFrame, keys: Sequence[str], newest: Sequence[Column], keep: int) -> DataFrame:
    """Mark the newest ``keep`` rows per key as kept; the rest can be removed.

    The kept rows are found with a per-task limit before the shuffle; the others never meet.
    """
    w = Window.partitionBy(*keys).orderBy(*newest)
    kept = df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= keep).drop("_n")
    return kept


def retention_expired(df: DataFrame, keys: Sequence[str], newest: Sequence[Column], keep: int, row_id: Sequence[str]) -> DataFrame:
    """Rows beyond the newest ``keep`` per key."""
    return df.join(retention(df, keys, newest, keep).select(*row_id), list(row_id), "left_anti")
