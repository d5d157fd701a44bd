"""Ordered observations: islands, change points, runs, budgets and stateful folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """WIN-03/04/15: numbers the runs of each key; a row that `starts` says true (or is the first) begins one.

    `starts` may use the window functions over previous rows that it needs; null counts as false.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def previous(column: str, keys: list[str], order: list[str], n: int = 1) -> Column:
    return F.lag(column, n).over(Window.partitionBy(*keys).orderBy(*order))


def change_points(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """WIN-02: rows whose value differs from the one before, with that value as previous_value."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("previous_value", F.lag(value).over(w)).where(F.col("previous_value").isNotNull() & (F.col(value) != F.col("previous_value")))


def run_lengths(df: DataFrame, keys: list[str], order: list[str], value: str, at: str) -> DataFrame:
    """WIN-07: one row per run of equal values: its value, first and last `at` and length."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = ~F.col(value).eqNullSafe(F.lag(value).over(w))
    marked = islands(df.withColumn("_changed", changed), keys, order, F.col("_changed"), "run")
    return marked.groupBy(*keys, "run").agg(F.min(value).alias(value), F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("length"))


def forward_fill(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """WIN-15: the last non-null value up to each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, gap: float = 0) -> DataFrame:
    """WIN-10: overlapping intervals, or those at most `gap` apart, become one."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = islands(df.withColumn("_new", F.col(start) > reach + gap), keys, [start, end], F.col("_new"))
    return marked.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("parts")).drop("island")


def running_sum(df: DataFrame, keys: list[str], order: list[str], size: str, bucket: Column, name: str) -> DataFrame:
    """Adds `name`, the sum of `size` over the rows before each in the order of its key, null sizes as 0, and `name`_all, the key's sum.

    bucket must rise with the order (such as a number divided by a width): rows are summed within a key's bucket, and one
    total per bucket gives each its offset. So a key that holds a third of all rows spreads over as many tasks as it has
    buckets.
    """
    rows = df.withColumn("_bucket", bucket).withColumn("_size", F.coalesce(F.col(size), F.lit(0)))
    totals = rows.groupBy(*keys, "_bucket").agg(F.sum("_size").alias("_total"))
    w = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_total").over(w.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_bucket").alias("_b"), before.alias("_before"), F.sum("_total").over(w).alias(f"{name}_all"))
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("_inner", F.coalesce(F.sum("_size").over(inner), F.lit(0)))
    same = F.col("_bucket").eqNullSafe(F.col("_b"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = summed.join(offsets, same).withColumn(name, F.col("_before") + F.col("_inner"))
    return out.select(*df.columns, name, f"{name}_all")


def evict_until_budget(df: DataFrame, keys: list[str], order: list[str], size: str, budget: float, bucket: Column | None = None) -> DataFrame:
    """WIN-12: the oldest rows that must go so that the rest fits the budget; bucket as in running_sum()."""
    rows = running_sum(df, keys, order, size, F.lit(0) if bucket is None else bucket, "_before_it")
    return rows.where(F.col("_before_it") < F.col("_before_it_all") - budget).select(*df.columns)


def typed(rows: list[tuple], columns: list[str], schema: str) -> pd.DataFrame:
    """rows as a frame whose numbers may be missing, for a schema of `name type` parts."""
    kinds = {c.split()[0]: c.split()[1] for c in schema.split(", ") if len(c.split()) == 2}
    plain = {"double": "float64", "long": "Int64", "int": "Int32", "bigint": "Int64", "boolean": "boolean"}
    out = pd.DataFrame(rows, columns=columns)
    return out.astype({c: plain[kinds[c]] for c in columns if kinds.get(c) in plain})


def fold_sorted(df: DataFrame, key: str | list[str], order: list[str], columns: list[str], start: Callable, step: Callable, end: Callable, schema: str) -> DataFrame:
    """WIN-06/14: a fold over each key's rows in order, for state that windows can't express.

    Rows are dealt by key and sorted; one task passes over them and holds one key's state and one batch, so a key of any
    number of rows fits. start(key) makes a state; step(state, values of `columns`) and end(state) yield result rows. A
    list of keys gives start() a tuple; rows with a null in a key are left out.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    keys = [key] if isinstance(key, str) else list(key)
    n = len(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            rows: list[tuple] = []
            for row in pdf[[*keys, *columns]].itertuples(index=False, name=None):
                own, values = (row[0] if isinstance(key, str) else row[:n]), row[n:]
                if state is None or own != current:
                    if state is not None:
                        rows += end(state)
                    current, state = own, start(own)
                rows += step(state, values)
            if rows:
                yield typed(rows, names, schema)
        if state is not None:
            yield typed(list(end(state)), names, schema)

    return df.dropna(subset=keys).repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def monotone(df: DataFrame, key: str, order: str, columns: tuple[str, str]) -> DataFrame:
    """WIN-14: rows neither of whose two values falls below the largest that was accepted before; nulls are not accepted."""

    def step(state: list, row: tuple) -> Iterator[tuple]:
        own, high = state
        if all(v >= h for v, h in zip(row[1:], high, strict=True)):
            state[1] = row[1:]
            yield own, *row

    names = [key, order, *columns]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*names).schema)
    return fold_sorted(df.dropna(subset=list(columns)), key, [order, *columns], names[1:], lambda own: [own, (float("-inf"),) * 2], step, lambda state: [], schema)


def span_capped(df: DataFrame, key: str, at: str, gap: float, span: float) -> DataFrame:
    """WIN-21: batches of a key's sorted points: a new one after a gap, or where it would grow longer than the span."""

    def step(state: list, row: tuple) -> Iterator[tuple]:
        (v,) = row
        if state[1:] and (v - state[2] > gap or v - state[1] > span):
            yield tuple(state)
            del state[1:]
        if not state[1:]:
            state += [v, v, 0]
        state[2], state[3] = v, state[3] + 1

    kinds = {f.name: f.dataType.simpleString() for f in df.select(key, at).schema}
    schema = f"{key} {kinds[key]}, first_at {kinds[at]}, last_at {kinds[at]}, n long"
    return fold_sorted(df.where(F.col(at).isNotNull()), key, [at], [at], lambda own: [own], step, lambda state: [tuple(state)] if state[1:] else [], schema)


def absorbed(runs: DataFrame, key: str, value: str, at: str, length: str, least: int, order: str) -> DataFrame:
    """WIN-07: runs in the order of a column, those shorter than `least` joined to the one before, and so are equal neighbours."""

    def step(state: list, row: tuple) -> Iterator[tuple]:
        first, v, n = row
        if state[1:] and (n < least or v == state[1]):
            state[3] += n
            return
        if state[1:]:
            yield tuple(state)
        state[1:] = [v, first, n]

    kinds = {f.name: f.dataType.simpleString() for f in runs.select(key, value, at, length).schema}
    schema = f"{key} {kinds[key]}, value {kinds[value]}, first_at {kinds[at]}, length {kinds[length]}"
    return fold_sorted(runs, key, [order], [at, value, length], lambda own: [own], step, lambda state: [tuple(state)] if state[1:] else [], schema)
