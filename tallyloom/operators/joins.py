"""Joins that Spark has no operator for, as equi-joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_join(left: DataFrame, right: DataFrame, left_at: str, right_start: str, right_end: str, width: float, keys: tuple[str, ...] = (), how: str = "inner") -> DataFrame:
    """JOIN-11/12: rows of left whose numeric left_at lies in [right_start, right_end] of right, ends included.

    Intervals are dealt into buckets of `width` that they touch, points into theirs, and both meet by an equi-join on the
    bucket, so nothing is compared all against all. A null end is open only up to the start's bucket: close it first.
    Choose a width near the usual interval's length; a much longer interval is repeated once per bucket.
    """
    points = left.withColumn("_b", F.floor(F.col(left_at) / width))
    spans = right.withColumn("_b", F.explode(F.sequence(F.floor(F.col(right_start) / width), F.floor(F.col(right_end) / width))))
    on = [F.col("l._b") == F.col("r._b"), F.col(f"l.{left_at}") >= F.col(f"r.{right_start}"), F.col(f"l.{left_at}") <= F.col(f"r.{right_end}")]
    on += [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return points.alias("l").join(spans.alias("r"), condition, how).drop("_b")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, values: list[str], forward: bool = False) -> DataFrame:
    """JOIN-13: to each row of left the values of right's latest row at or before it (forward: first at or after).

    Both sides are sorted together once per key and the last seen right row is carried on, without any pairing. Of right
    rows at the same time the largest values win.
    """
    carried = F.struct(F.col(right_at).alias("_at"), *values)
    side = 0 if not forward else 1
    l_rows = left.select(*keys, F.col(left_at).alias("_t"), F.lit(1 - side).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(carried.alias("s")).schema["s"].dataType).alias("_value"))
    r_rows = right.select(*keys, F.col(right_at).alias("_t"), F.lit(side).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("s")).schema["s"].dataType).alias("_row"), carried.alias("_value"))
    both = l_rows.unionByName(r_rows)
    w = Window.partitionBy(*keys)
    if forward:
        order = w.orderBy("_t", "_side", F.col("_value").desc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
        seen = F.first("_value", ignorenulls=True).over(order)
    else:
        order = w.orderBy("_t", "_side", "_value").rowsBetween(Window.unboundedPreceding, 0)
        seen = F.last("_value", ignorenulls=True).over(order)
    found = both.withColumn("_found", seen).where(F.col("_row").isNotNull())
    return found.select("_row.*", F.col("_found._at").alias(f"found_{right_at}"), *(F.col(f"_found.{v}").alias(v) for v in values))


def unpivot_sides(df: DataFrame, sides: list[str], name: str, keep: list[str]) -> DataFrame:
    """JOIN-10: one row per side, so that a condition `x = a OR x = b` becomes an equi-join."""
    return df.select(*keep, F.explode(F.array(*sides)).alias(name))


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], warnings: list[tuple[Column, str]]) -> DataFrame:
    """JOIN-18: keys and code of every disagreement of two sources; neither is changed. Columns are a.* and b.*."""
    joined = a.alias("a").join(b.alias("b"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "full_outer")
    codes = F.array_compact(F.array(*(F.when(case, F.lit(code)) for case, code in warnings)))
    return joined.select(*(F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys), F.explode(codes).alias("code"))


def complete_dimension(dim: DataFrame, facts: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """JOIN-21: the dimension with a default row for each key that only facts have."""
    missing = facts.select(key).where(F.col(key).isNotNull()).distinct().join(dim, key, "left_anti")
    return dim.unionByName(missing.select(key, *(v.alias(c) for c, v in defaults.items())))
