"""ARR-02: the best legal line-up of several slots from what each slot may be, by branch and bound."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# How many of each role a line-up has, candidates of a slot and role, the score from which a slot without a read
# may be filled, and from which a read that is overruled is an anomaly.
TARGET, LIMIT, INFER_FLOOR, STRONG_READ = {"Tank": 1, "Damage": 2, "Support": 2}, 4, 0.30, 0.55

#: Keys of a batch that are Python objects at a time; the rest of it stays in Arrow's buffers.
KEYS = 256

_OUT = "slot int, value string, role string, score double, source string, valid boolean, confidence double, anomaly string"


def best_line_up(slots: list[list[tuple[str, str, float]]], target: dict[str, int]) -> list[tuple[str, str, float]] | None:
    """The choice of one (value, role, score) a slot, values distinct and roles as in target, of the largest sum; of
    sums equal to nine digits the smallest values. None if there is no legal one.

    Depth-first over the slots; what the best candidates of the slots to come could add bounds every branch.
    """
    after = [0.0]
    for own in reversed(slots):
        if not own:
            return None
        after.append(after[-1] + max(s for *_, s in own))
    after.reverse()
    ordered = [sorted(own, key=lambda x: (-x[2], x[0])) for own in slots]
    best: list = [None, float("-inf"), ()]
    left, used, chosen = dict(target), set(), []

    def descend(i: int, total: float) -> None:
        if i == len(slots):
            values, total = tuple(v for v, *_ in chosen), round(total, 9)
            if total > best[1] or total == best[1] and values < best[2]:
                best[:] = [list(chosen), total, values]
            return
        for value, role, score in ordered[i]:
            if total + score + after[i + 1] < best[1] - 1e-8:
                return  # the candidates after this one are no better
            if value not in used and left.get(role, 0):
                left[role] -= 1
                used.add(value)
                chosen.append((value, role, score))
                descend(i + 1, total + score)
                chosen.pop()
                used.remove(value)
                left[role] += 1

    descend(0, 0.0)
    return best[0]


def _resolve(reads: dict[int, tuple[str | None, float | None]], candidates: dict[int, list], target: dict[str, int]) -> list[tuple]:
    order = sorted(reads)
    if len(order) != sum(target.values()):
        picks, anomaly = None, "slots"
    else:
        picks, anomaly = best_line_up([candidates.get(s, []) for s in order], target), "no assignment"
    if picks is None:
        known = [score for value, score in reads.values() if value is not None]
        mean = sum(known) / len(known) if known else None
        return [(s, v or "UNKNOWN", None, x, "direct" if v else "unresolved", False, mean, anomaly) for s in order for v, x in (reads[s],)]
    rows, overruled = [], False
    for s, (value, role, score) in zip(order, picks, strict=True):
        read, seen = reads[s]
        source = "direct" if value == read else "role-corrected" if read is not None else "role-inferred" if score >= INFER_FLOOR else "unresolved"
        overruled |= source == "role-corrected" and seen is not None and seen >= STRONG_READ
        rows.append((s, "UNKNOWN" if source == "unresolved" else value, role, score, source))
    sure = [score for (_, _, score), row in zip(picks, rows, strict=True) if row[4] != "unresolved"]
    anomaly = "overruled" if overruled else "incomplete" if len(sure) < len(rows) else None
    mean = sum(sure) / len(sure) if sure else None
    return [(*row, anomaly is None, mean, anomaly) for row in rows]


def line_ups(reads: DataFrame, candidates: DataFrame, key: str, target: dict[str, int] | None = None, limit: int = LIMIT) -> DataFrame:
    """`key`, slot, value, role, score, source, valid, confidence and anomaly of every slot of every line-up.

    reads has key, slot, value and score: what a slot was read as, null if nothing was; candidates has key, slot, value,
    role and score, of which a slot's `limit` best of each role count (ties to the smaller value). source is direct,
    role-inferred (no read), role-corrected (another read) or unresolved (no read and below INFER_FLOOR: UNKNOWN). anomaly
    is `slots` (not as many as target has), `no assignment`, `overruled` (a strong read gave way), `incomplete` or null.
    Rows with a null key or slot are left out, a slot that repeats counts with its largest read. A key's rows, a few dozen,
    meet in one task.
    """
    target = target or TARGET
    w = Window.partitionBy(key, "slot", "role").orderBy(F.desc("score"), "value")
    able = candidates.where(F.col("role").isin(*target) & F.col("value").isNotNull() & F.col("score").isNotNull()).dropna(subset=[key, "slot"])
    able = able.groupBy(key, "slot", "value", "role").agg(F.max("score").alias("score")).withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)
    part = lambda df, role: df.select(key, F.col("slot").cast("int").alias("slot"), F.col("value").cast("string").alias("value"), role.alias("role"), F.col("score").cast("double").alias("score"))
    rows = part(able, F.col("role")).unionByName(part(reads.dropna(subset=[key, "slot"]), F.lit(None).cast("string")))
    packed = rows.groupBy(key).agg(F.collect_list(F.struct("slot", "value", "role", "score")).alias("rows"))
    schema = f"{key} {reads.schema[key].dataType.simpleString()}, {_OUT}"
    text = pa.string()
    kinds = [("slot", pa.int32()), ("value", text), ("role", text), ("score", pa.float64()), ("source", text), ("valid", pa.bool_()), ("confidence", pa.float64()), ("anomaly", text)]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shape = pa.schema([pa.field(key, batch.schema.field(key).type), *kinds])
            for at in range(0, batch.num_rows, KEYS):
                some, out = batch.slice(at, KEYS), []
                for own, packed_rows in zip(some.column(key).to_pylist(), some.column("rows").to_pylist(), strict=True):
                    seen: dict[int, tuple] = {}
                    able: dict[int, list] = {}
                    for slot, value, role, score in (tuple(r.values()) for r in packed_rows):
                        if role is not None:
                            able.setdefault(slot, []).append((value, role, score))
                        else:
                            seen[slot] = max(seen.get(slot, (None, None)), (value, score), key=lambda x: (x[0] is not None, x[1] if x[1] is not None else -1.0, x[0] or ""))
                    if seen:
                        out += [(own, *x) for x in _resolve(seen, able, target)]
                columns = list(zip(*out, strict=True)) or [()] * len(shape)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)

    return packed.mapInArrow(solve, schema)
