"""Keyed merges without a transactional table: joins that give the new state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str], guard: Column | None = None) -> DataFrame:
    """SNK-03: the target after the source was merged in: non-null source values win, unless `guard` (over t.*) forbids."""
    joined = target.alias("t").join(source.alias("s"), [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys], "full_outer")
    allowed = F.coalesce(guard, F.lit(True)) if guard is not None else F.lit(True)
    merged = lambda c: F.when(F.col(f"t.{keys[0]}").isNull() | allowed, F.coalesce(f"s.{c}", f"t.{c}")).otherwise(F.col(f"t.{c}")).alias(c)
    return joined.select(*(F.coalesce(f"t.{k}", f"s.{k}").alias(k) for k in keys), *map(merged, columns))


def insert_ignore(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-04: the target and the source rows whose key it lacks."""
    return target.unionByName(source.join(target, keys, "left_anti"))


def insert_replace(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-04: the source and the target rows whose key it lacks."""
    return source.unionByName(target.join(source, keys, "left_anti"))


def replace_preserving(target: DataFrame, source: DataFrame, scope: list[str], keep: Column) -> DataFrame:
    """SNK-05: within the source's scopes only target rows that `keep` marks stay; other scopes are untouched."""
    scopes = source.select(*scope).distinct()
    return target.join(scopes, scope, "left_anti").unionByName(target.where(keep).join(scopes, scope, "left_semi")).unionByName(source)


def ledger_merge(ledger: DataFrame, scanned: DataFrame, key: str, now: Column, columns: list[str]) -> DataFrame:
    """SET-05: rows once seen stay; first_seen never changes, last_seen is now for what the scan has."""
    joined = ledger.alias("l").join(scanned.alias("s"), F.col(f"l.{key}") == F.col(f"s.{key}"), "full_outer")
    seen = F.col(f"s.{key}").isNotNull()
    return joined.select(F.coalesce(f"l.{key}", f"s.{key}").alias(key), F.coalesce("l.first_seen", now).alias("first_seen"), F.when(seen, now).otherwise(F.col("l.last_seen")).alias("last_seen"), *(F.coalesce(f"s.{c}", f"l.{c}").alias(c) for c in columns))


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """SET-07: the first row of each key in a stated order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
