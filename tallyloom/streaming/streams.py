"""Structured Streaming counterparts: windows, sessions, ledgers and keyed state, run over what a folder holds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyloom.operators.merge import ledger_merge
from tallyloom.sources.bucketed import BucketedTable


def event_stream(spark: SparkSession, path: str, schema: str, at: str) -> DataFrame:
    """A stream of the Parquet files of a folder; `at` becomes an instant, which watermarks need."""
    return spark.readStream.schema(schema).parquet(path).withColumn(at, F.col(at).cast("timestamp"))


def tumbling(events: DataFrame, at: str, width: str, late: str) -> DataFrame:
    """STM-02: counts of fixed windows; rows later than `late` behind the newest are dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, width)).agg(F.count("*").alias("n"))


def sliding(events: DataFrame, at: str, width: str, step: str, late: str) -> DataFrame:
    """STM-03: counts of overlapping windows."""
    return events.withWatermark(at, late).groupBy(F.window(at, width, step)).agg(F.count("*").alias("n"))


def around(points: DataFrame, marks: DataFrame, key: str, at: str, mark_at: str, before: str, after: str, late: str) -> DataFrame:
    """STM-03: points (key, at) with every mark (key, mark_at) of their key from `before` ahead of it to `after` behind it.

    Both sides are streams with a watermark of their own; a side's rows are held until the other's watermark has passed all
    that they can meet, so the state is as long as the window and the lateness. Rows later than `late` meet nothing: see
    late_rows(). The columns of the marks but the key are joined; on tables the result is that of the same join.
    """
    p, m = points.withWatermark(at, late).alias("p"), marks.withWatermark(mark_at, late).alias("m")
    near = (F.col(f"p.{at}") >= F.col(f"m.{mark_at}") - F.expr(f"interval {before}")) & (F.col(f"p.{at}") <= F.col(f"m.{mark_at}") + F.expr(f"interval {after}"))
    return p.join(m, (F.col(f"p.{key}") == F.col(f"m.{key}")) & near).select("p.*", *(F.col(f"m.{c}") for c in marks.columns if c != key))


def late_rows(query) -> int:
    """Rows that the watermark of a query dropped, over the progress that it still keeps."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])


def sessions(events: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """STM-04: counts of runs whose rows are at most `gap` apart."""
    return events.withWatermark(at, late).groupBy(key, F.session_window(at, gap)).agg(F.count("*").alias("n"))


def once(events: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """STM-08: one row per natural key, remembered for as long as rows may be late."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def stale_keys(events: DataFrame, key: str, at: str, silence: str, late: str) -> DataFrame:
    """STM-06: (key, last_at) of each key once the watermark has passed its newest row by `silence` (such as "90 seconds").

    A key that is heard again afterwards starts anew. The state is one instant per key and goes with the timeout.
    """
    seconds = events.sparkSession.sql(f"SELECT cast(interval {silence} AS interval second) AS s").first()["s"].total_seconds()
    kind = events.schema[key].dataType.simpleString()

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({key: [keys[0]], "last_at": pd.to_datetime([last], unit="us")})
            return
        newest = max(int(pdf["_us"].max()) for pdf in batches)
        if state.exists:
            newest = max(newest, state.get[0])
        state.update((newest,))
        due = newest // 1000 + int(seconds * 1000)
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    timed = events.withWatermark(at, late).select(key, at, F.unix_micros(at).alias("_us"))
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, last_at timestamp", "newest long", "append", GroupStateTimeout.EventTimeTimeout)


def accumulate(stream: DataFrame, ledger: BucketedTable, key: str, columns: list[str], checkpoint: str, writer: str = "stream") -> None:
    """STM-01: merges every batch into a ledger (key, first_seen, last_seen and columns), rewriting the buckets of its keys.

    Of rows of a batch that repeat a key the largest (columns in their order) counts. A batch that runs twice changes
    nothing; a batch that meets another writer in a bucket fails and is run again by the next start.
    """

    def merge(batch: DataFrame, number: int) -> None:
        now = F.lit(number).cast("long")
        fresh = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*columns)).alias("_row")).select(key, "_row.*").persist()
        try:
            ledger.merge(fresh, lambda old, new: ledger_merge(old, new, key, now, columns), once=(writer, number))
        finally:
            fresh.unpersist()

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def collect_all(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Drives a stream over what is there and returns the result as a table; for tests and small extracts."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
