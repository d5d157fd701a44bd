"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm._common import drop_written, written


def _least(pairs: DataFrame) -> DataFrame:
    """Per node u the least of itself and its neighbours v."""
    return pairs.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.where("v > u").join(_least(both), "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u != v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    low = _least(links)
    moved = links.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(low.select("u", F.col("low").alias("v"))).where("u != v").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has a link, component being its smallest reachable node.

    links: columns a and b of one orderable type; nulls and loops are ignored, repeated links count once, an empty
    table gives an empty one. Each round is written to the shared folder, so no state is gathered on the driver: only a
    row count and a checksum per round come back. The number of rounds grows with the logarithm of the longest chain.
    """
    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    links = written(links.where("a is not null and b is not null and a != b").select(u, v).distinct(), "links")
    state = None
    for _ in range(max_rounds):
        after = written(_small_star(_large_star(links)), "stars")
        now = tuple(after.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
        drop_written(links)
        links = after
        if now == state or now[0] == 0:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    lows = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(lows)
