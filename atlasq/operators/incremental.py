"""Incremental state: file deltas, replacement by path, promotion to a full refresh, keyed deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed value: build files and configuration, whose change makes everything stale.
BUILD_FILES = r"(^|/)(pom\.xml|build\.gradle(\.kts)?|settings\.gradle(\.kts)?)$|[^/]\.(?i:properties|ya?ml)$"


def hash_delta(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, status): added, modified, deleted or unchanged. Both sides: (path, sha256), one row a path."""
    a, b = before.select("path", F.col("sha256").alias("old")), now.select("path", F.col("sha256").alias("new"))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") == F.col("new"), "unchanged").otherwise("modified")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


def needs_full(delta: DataFrame) -> DataFrame:
    """One row: whether a build or configuration file changed or went."""
    return delta.agg(F.coalesce(F.bool_or(F.col("status").isin("modified", "deleted", "added") & F.col("path").rlike(BUILD_FILES)), F.lit(False)).alias("full"))


def replaced_by_path(old: DataFrame, new: DataFrame, touched: DataFrame) -> DataFrame:
    """Rows of paths that were not touched, and the new rows."""
    return old.join(touched.select("path").distinct(), "path", "left_anti").unionByName(new)


def purged(facts: DataFrame, delta: DataFrame) -> DataFrame:
    return facts.join(delta.where("status = 'deleted'").select("path"), "path", "left_anti")


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def last_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return first_wins(df, keys, [c.desc() for c in order])


def needs_full_for_contracts(delta: DataFrame, model_roots: DataFrame) -> DataFrame:
    """One row: whether a changed path can alter who publishes a contract: a ``.rest`` declaration, a POM, or anything in a
    model module. model_roots: (folder). An equi join on the paths' ancestors."""
    from .resolve import ancestors

    touched = delta.where("status <> 'unchanged'").select("path")
    own = touched.select(F.col("path").rlike(r"(?i)\.rest$|pom\.xml$").alias("hit"))
    inside = touched.select(F.explode(ancestors(F.col("path"))).alias("folder")).join(model_roots.select("folder").distinct(), "folder", "left_semi").select(F.lit(True).alias("hit"))
    return own.union(inside).agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("full"))


def freshness(indexed: DataFrame, now: DataFrame) -> DataFrame:
    """One row: how many files were added, modified and deleted since the inventory, and whether it is stale."""
    counts = [F.sum(F.when(F.col("status") == s, 1).otherwise(0)).alias(s) for s in ("added", "modified", "deleted")]
    return hash_delta(indexed, now).agg(*(F.coalesce(c, F.lit(0)) for c in counts)).toDF("added", "modified", "deleted").withColumn("stale", F.col("added") + F.col("modified") + F.col("deleted") > 0)


def meta_changed(before: dict[str, str], now: dict[str, str], keys: tuple[str, ...] = ("signature", "strategy", "config")) -> list[str]:
    """Which keys force a full refresh."""
    return [k for k in keys if before.get(k) != now.get(k)]
