"""WF-03, WF-05, WF-08: reachability in a state graph, leases from their requests, edits of segments."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.sequence import fold_sorted


def lease_log(requests: DataFrame, seconds: float) -> DataFrame:
    """WF-05: resource, at, worker, action, granted, holder and expires after each request, in the order of time.

    requests has resource, at (seconds, double), worker and action: acquire takes a free or expired lease, or renews one's
    own; heartbeat renews one's own, also an expired one that nobody took; release gives it up; reap (any worker) clears an
    expired one. What isn't granted changes nothing. Requests at one time go by worker and action. A resource's requests
    stream through one task, which holds its lease alone.
    """

    def step(state: list, row: tuple) -> Iterator[tuple]:
        resource, holder, expires = state
        at, worker, action = row
        expired = holder is not None and expires <= at
        granted = {"acquire": holder is None or holder == worker or expired, "heartbeat": holder == worker, "release": holder == worker, "reap": expired}.get(action, False)
        if granted:
            state[1:] = [None, None] if action in ("release", "reap") else [worker, at + seconds]
        yield resource, at, worker, action, granted, state[1], state[2]

    clean = requests.where("at is not null and worker is not null").select("resource", F.col("at").cast("double").alias("at"), "worker", "action")
    schema = "resource string, at double, worker string, action string, granted boolean, holder string, expires double"
    return fold_sorted(clean, "resource", ["at", "worker", "action"], ["at", "worker", "action"], lambda resource: [resource, None, None], step, lambda state: [], schema)


def reachable(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """WF-03: from_state and to_state of all pairs that the edges (a, b) lead to, over any number of steps.

    Paths double each round, and rounds end once none is new, whatever the graph's depth. The result has a row per pair:
    meant for state graphs, not for large ones.
    """
    paths = edges.where("a is not null and b is not null").select("a", "b").distinct()
    size = paths.count()
    for _ in range(max_rounds):
        longer = paths.alias("x").join(paths.alias("y"), F.col("x.b") == F.col("y.a")).select("x.a", "y.b")
        paths = paths.unionByName(longer).distinct()
        now = paths.count()
        if now == size:
            return paths.select(F.col("a").alias("from_state"), F.col("b").alias("to_state"))
        size = now
    raise RuntimeError(f"paths did not settle in {max_rounds} rounds")


def edited(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """WF-08: segments (id, start, end, status) after the edits, with origin: the id of what a new segment came from.

    edits has number, id, action and value, note. The last edit (by number) of a segment counts: approve and reject set
    its status; start and end move a bound, if the segment stays one; split makes two pending ones on both sides of value
    within it and keeps the old one as split; merge joins all segments of one value into a pending one from the least
    start to the largest end and keeps them as merged. Edits that can't be done leave the segment as it is, with the note
    `refused`. New ids are text: the old one and a part, or merge and the value.
    """
    last = edits.groupBy("id").agg(F.max_by(F.struct("action", "value", "note"), "number").alias("e"))
    rows = segments.select(F.col("id").cast("string").alias("id"), "start", "end", "status").join(last.withColumn("id", F.col("id").cast("string")), "id", "left")
    action, value = F.col("e.action"), F.col("e.value")
    inside = (value > F.col("start")) & (value < F.col("end"))
    done = F.coalesce(
        F.when(action.isin("approve", "reject", "merge"), True).when(action == "start", value < F.col("end")).when(action == "end", value > F.col("start")).when(action == "split", inside), F.lit(False)
    )
    rows = rows.withColumn("done", done)
    if_done = lambda name, new, old: F.when(F.col("done") & (action == name), new).otherwise(old)
    status = F.when(~F.col("done"), F.col("status")).when(action == "approve", "approved").when(action == "reject", "rejected").when(action == "split", "split").when(action == "merge", "merged").otherwise(F.col("status"))
    note = F.when(F.col("e").isNotNull() & ~F.col("done"), "refused").otherwise(F.col("e.note"))
    kept = rows.select("id", if_done("start", value, F.col("start")).alias("start"), if_done("end", value, F.col("end")).alias("end"), status.alias("status"), note.alias("note"), F.lit(None).cast("string").alias("origin"))
    halves = F.explode(F.array(F.struct(F.lit("a").alias("part"), F.col("start").alias("start"), value.alias("end")), F.struct(F.lit("b").alias("part"), value.alias("start"), F.col("end").alias("end"))))
    split = rows.where(F.col("done") & (action == "split")).select("id", halves.alias("h"))
    split = split.select(F.concat("id", F.lit("-"), "h.part").alias("id"), "h.start", "h.end", F.lit("pending").alias("status"), F.lit(None).cast("string").alias("note"), F.col("id").alias("origin"))
    joined = rows.where(action == "merge").groupBy(value.alias("v")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("id").alias("origin"))
    merged = joined.select(F.concat(F.lit("merge-"), F.col("v").cast("long").cast("string")).alias("id"), "start", "end", F.lit("pending").alias("status"), F.lit(None).cast("string").alias("note"), "origin")
    return kept.unionByName(split).unionByName(merged)
