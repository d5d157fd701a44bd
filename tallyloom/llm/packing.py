"""Variable-capacity best-fit packing.

A document's words fill whole pieces of the largest permitted length and one rest. Pieces are dealt by hash into shares of
bounded size, and every share is packed on its own: longest piece first, into the open bin that it fills best; where none
has room, a bin opens of the length that the share's plan holds for pieces of that size. The plan is optimised jointly:
one opening length for each class of pieces, changed one at a time as long as the cost of the whole packing falls. At the
end each bin shrinks to the least permitted length that holds its contents.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm._common import n_words, table, written

#: Permitted lengths in words, and pieces in a share.
CAPACITIES, SHARE_ROWS = (256, 512, 1024, 2048, 4096), 50_000
#: The cost of a bin: that of opening it, of its length, and of its length's square (attention) by this many words.
BIN_COST, ATTENTION = 64, 8192


def bin_cost(capacity: np.ndarray) -> np.ndarray:
    c = np.asarray(capacity, float)
    return BIN_COST + c + c * c / ATTENTION


def pack_lengths(lengths: np.ndarray, plan: tuple[int, ...], capacities: tuple[int, ...] = CAPACITIES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and start of each piece, and every bin's final capacity; the lengths descend and are positive.

    plan has the opening length for pieces that fit each capacity but not the one before, in rising order.
    """
    ladder = np.array(sorted(capacities))
    opening = np.array(plan)[np.searchsorted(ladder, lengths)].tolist()
    bins, starts = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    rooms: dict[int, list[int]] = defaultdict(list)  # open bins by the room that is left
    present = 0  # bit r is set if a bin has room r
    used: list[int] = []
    for i, length in enumerate(lengths.tolist()):
        fits = present >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            own = rooms[room].pop()
            if not rooms[room]:
                present ^= 1 << room
        else:
            room, own = opening[i], len(used)
            used.append(0)
        bins[i], starts[i] = own, used[own]
        used[own] += length
        room -= length
        if room:
            rooms[room].append(own)
            present |= 1 << room
    return bins, starts, ladder[np.searchsorted(ladder, np.array(used, np.int64))]


def best_plan(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES) -> tuple[int, ...]:
    """The opening lengths of least total cost that single changes lead to from the largest length for all pieces.

    Every trial packs all the lengths. So the cost is never above that of packing into bins of the largest length.
    """
    ladder = sorted(capacities)
    plan = [ladder[-1]] * len(ladder)
    here = np.bincount(np.searchsorted(ladder, lengths), minlength=len(ladder))
    best = bin_cost(pack_lengths(lengths, tuple(plan), capacities)[2]).sum()
    better = True
    while better:
        better = False
        for kind in np.flatnonzero(here).tolist():
            for size in ladder[kind:]:
                trial = plan[:kind] + [size] + plan[kind + 1 :]
                cost = best if trial == plan else bin_cost(pack_lengths(lengths, tuple(trial), capacities)[2]).sum()
                if cost < best:
                    plan, best, better = trial, cost, True
    return tuple(plan)


def _pack(capacities: tuple[int, ...]):
    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "tie", "copy"], ascending=[False, True, True, True, True], kind="stable")
        lengths = pdf["length"].to_numpy()
        bins, starts, sizes = pack_lengths(lengths, best_plan(lengths, capacities), capacities)
        return pd.DataFrame({"doc_id": pdf["doc_id"], "piece": pdf["piece"], "first_word": pdf["first_word"], "length": lengths, "bin_id": bins * int(key[1]) + int(key[0]), "start": starts, "capacity": sizes[bins]})

    return pack


def best_fit(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """doc_id, piece, first_word, length, bin_id, start and capacity of every piece of every row of docs (doc_id, text).

    A piece is the words from first_word on and lies in its bin from start on; capacity is the bin's final length. Each
    word lies in one piece. A null or empty text, or one of white space, has one piece of length 0 without a bin. Rows
    that repeat an id, or lack one, are packed like others; rows that are wholly alike are told apart by a number, so a
    share stays bounded whatever repeats. Ties of the length go by id, piece and text hash. An empty table gives an empty
    result. Only ids and lengths are shuffled.
    """
    largest = max(capacities)
    sizes = docs.select("doc_id", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
    pieces = sizes.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"cast((size - 1) div {largest} as int)")))))
    pieces = pieces.select("doc_id", "tie", "piece", (F.col("piece") * F.lit(largest).cast("long")).alias("first_word"), F.least(F.lit(largest).cast("long"), F.col("size") - F.col("piece") * largest).alias("length"))
    pieces = written(pieces.groupBy(*pieces.columns).agg(F.count("*").alias("n")), "pieces")
    many = 4096  # numbers of one array
    counted = pieces.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {many}"))))
    counted = counted.withColumn("copy", F.explode(F.sequence(F.col("at") * many, F.least(F.col("n"), (F.col("at") + 1) * many) - 1))).drop("at", "n")
    full = counted.where("length > 0")
    shares = max(1, -(-(pieces.where("length > 0").agg(F.sum("n")).first()[0] or 0) // SHARE_ROWS))
    kind = pieces.schema["doc_id"].dataType.simpleString()
    # Ids pass as text: pandas has no whole numbers beside nulls.
    dealt = full.withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("share", F.pmod(F.xxhash64("doc_id", "piece", "tie", "copy"), F.lit(shares)).cast("int"))
    packed = dealt.groupBy("share", F.lit(shares).alias("shares")).applyInPandas(_pack(tuple(capacities)), "doc_id string, piece int, first_word long, length long, bin_id long, start long, capacity long").withColumn("doc_id", F.col("doc_id").cast(kind))
    return packed.unionByName(counted.where("length = 0").drop("tie", "copy"), allowMissingColumns=True)


def op3_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(table(spark, sf_dir, "documents"))
