"""Exact top-k search by vector-approximation files.

Every vector becomes a row of one-byte cells, 256 per dimension between the dimension's least and largest value over all
rows. Blocks of queries meet blocks of these cells alone in a grid: the cells bound each score from both sides, and what
stays of a block is what may still be among the k best by its bounds. The k-th largest lower bound over all blocks cuts
once more; only for the rest are exact vectors read, in the order of their upper bounds, until the k-th exact score is
certain.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm._common import table, written

#: Rows in a block of the grid, queries in one, and cells per dimension.
ROW_BLOCK, QUERY_BLOCK, CELLS = 16_384, 4_096, 256
#: Binary digits of a component's size that one approximation file covers; larger vectors have further files.
FILE_BITS = 24
_LONG = (1 << 63) - 1
#: Components of this size and more, which no float holds, could leave double precision in a product.
TOO_LARGE = float(1 << 480)
#: Bytes that hold any inner product, offset so that the order of the bytes is that of the numbers.
_WIDE = 160


def whole_vectors(df: DataFrame, id_column: str, vector: str, factor: int) -> DataFrame:
    """id and v, the components as floor(factor * x) in doubles, which hold them exactly if factor is a power of two.

    Takes rows with an id and a vector whose components are all finite, and after the multiplication below TOO_LARGE.
    """
    x = F.col(vector)
    usable = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double") * factor) < TOO_LARGE)), F.lit(False))
    # Spark's floor gives a long; beyond 2**52 a double has no fraction.
    whole = F.transform(x, lambda c: F.when(F.abs(c.cast("double") * factor) < float(1 << 52), F.floor(c.cast("double") * factor).cast("double")).otherwise(c.cast("double") * factor))
    return df.where(x.isNotNull() & F.col(id_column).isNotNull() & usable).select(F.col(id_column).cast("long").alias("id"), whole.alias("v"))


def _cells(low: np.ndarray, width: np.ndarray):
    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The approximation of each vector, and a 128-bit digest by which equal vectors are known."""
        for pdf in batches:
            if len(pdf):
                v = np.stack(pdf["v"].to_list())
                yield pd.DataFrame({"id": pdf["id"], "block": pdf["block"], "same": pdf["same"], "cells": [x.tobytes() for x in np.clip((v - low) // width, 0, CELLS - 1).astype(np.uint8)]})

    return cells


def _kth_largest(lower: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Per row the k-th largest of the columns' values, columns of one id (from each of `first` on) counting once."""
    each = np.maximum.reduceat(lower, first, axis=1)
    return np.partition(each, -k, axis=1)[:, -k] if each.shape[1] >= k else np.full(len(each), -np.inf)


def _scan(k: int, low: np.ndarray, width: np.ndarray):
    def scan(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        """For each query the rows of the block whose upper bound reaches the block's k-th largest lower bound."""
        out = [pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "same": pd.Series(dtype="str"), "lower": pd.Series(dtype="float64"), "upper": pd.Series(dtype="float64")})]
        if len(queries) and len(rows):
            rows = rows.drop_duplicates(["id", "same"]).sort_values(["same", "id"], kind="stable")
            rows = rows[rows.groupby("same", sort=False).cumcount() <= k].sort_values("id", kind="stable")  # of equal vectors only the k + 1 smallest ids can count
            rid, same = rows["id"].to_numpy(), rows["same"].to_numpy()
            first = np.flatnonzero(np.concatenate(([True], rid[1:] != rid[:-1])))
            cells = np.frombuffer(b"".join(rows["cells"]), np.uint8).reshape(len(rows), -1)
            middle = low + (cells + 0.5) * width
            qid, q = queries["id"].to_numpy(), np.stack(queries["v"].to_list())
            # Half a cell, and what double precision may lose.
            slack = np.abs(q) @ (width / 2) + np.abs(q) @ (np.abs(low) + CELLS * width) * 1e-12
            for start in range(0, len(q), 256):
                part = slice(start, start + 256)
                guess = q[part] @ middle.T
                guess[qid[part][:, None] == rid[None, :]] = -np.inf  # a query's own rows are no candidates
                kth = _kth_largest(guess - slack[part][:, None], first, k)
                a, b = np.nonzero(np.isfinite(guess) & (guess + slack[part][:, None] >= kth[:, None]))
                out.append(pd.DataFrame({"query_id": qid[part][a], "vec_id": rid[b], "same": same[b], "lower": guess[a, b] - slack[part][a], "upper": guess[a, b] + slack[part][a]}))
        return pd.concat(out)

    return scan


def _certain(k: int):
    def certain(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """The k best of a query's remaining candidates, read in the order of their upper bounds."""
        pdf = pdf.sort_values(["upper", "vec_id"], ascending=[False, True], kind="stable")
        best: dict[int, int] = {}
        kth = None
        for other, upper, q, v in zip(pdf["vec_id"], pdf["upper"], pdf["q"], pdf["v"], strict=True):
            if kth is not None and upper < float(kth):
                break
            q, v = np.asarray(q), np.asarray(v)
            if np.abs(q) @ np.abs(v) < 1 << 52:  # every partial sum is a whole number that a double holds
                score = int(q @ v)
            else:
                score = sum(int(a) * int(b) for a, b in zip(q.tolist(), v.tolist(), strict=True))
            if other not in best or score > best[other]:
                best[other] = score
                if len(best) >= k:
                    kth = sorted(best.values(), reverse=True)[k - 1]
        top = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
        wide = [(s + (1 << (8 * _WIDE - 2))).to_bytes(_WIDE, "big") if abs(s) >= _LONG else None for _, s in top]
        return pd.DataFrame({"query_id": key[0], "vec_id": [i for i, _ in top], "score": [max(-_LONG - 1, min(_LONG, s)) for _, s in top], "wide": wide})

    return certain


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product of every query, ties to smaller ids.

    Both tables have id (long) and v (array<double> of whole numbers), as whole_vectors() gives them. A query's candidates
    are all rows of another id and as many dimensions; fewer than k are returned whole. Rows that repeat an id are one
    candidate or query, whose score is the best of its rows. Scores are exact at any size: ranks follow the true numbers,
    and only the returned long stops at its limits. Vectors that are null or hold something null, non-finite or of TOO_LARGE or
    more never reach here, empty ones take no part; empty tables give an empty result.
    """
    spark = vectors.sparkSession
    size = F.greatest(F.lit(0), F.floor(F.log2(F.array_max(F.transform("v", lambda c: F.greatest(F.abs(c), F.lit(1.0))))) / FILE_BITS)).cast("int")
    vectors = vectors.where(F.size("v") > 0).withColumn("dims", F.size("v")).withColumn("file", size)
    queries = queries.where(F.size("v") > 0).withColumn("dims", F.size("v"))
    asked_of = {r["dims"]: r["count"] for r in queries.groupBy("dims").count().collect()}  # one number per number of dimensions
    parts = []
    for dims, file, count, low, high in _files(vectors):
        if dims not in asked_of:
            continue
        width = np.maximum((high - low) / CELLS, np.maximum(np.abs(low), 1) * 1e-9) * (1 + 1e-9)
        row_blocks = max(1, -(-count // ROW_BLOCK), min(spark.sparkContext.defaultParallelism, -(-count // 512)))
        query_blocks = max(1, -(-asked_of[dims] // QUERY_BLOCK))
        rows = (
            vectors.where((F.col("dims") == dims) & (F.col("file") == file))
            .select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(row_blocks)).cast("int").alias("block"), _digest("v").alias("same"))
            .mapInPandas(_cells(low, width), "id long, block int, same string, cells binary")
            .withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
        )
        asked = (
            queries.where(F.col("dims") == dims)
            .select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(query_blocks)).cast("int").alias("query_block"))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
        )
        cell = ["query_block", "block"]
        parts.append(asked.groupBy(*cell).cogroup(rows.groupBy(*cell)).applyInPandas(_scan(k, low, width), "query_id long, vec_id long, same string, lower double, upper double"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = written(reduce(DataFrame.unionByName, parts), "bounded")
    # A row is named by its id and digest; of equal vectors the k + 1 smallest ids stay, as within a block.
    bounds = found.groupBy("query_id", "vec_id", "same").agg(F.max("lower").alias("lower"), F.max("upper").alias("upper"))
    few = bounds.withColumn("copy", F.row_number().over(Window.partitionBy("query_id", "same").orderBy("vec_id"))).where(F.col("copy") <= k + 1).drop("copy")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("lower"), "vec_id"))
    kth = few.groupBy("query_id", "vec_id").agg(F.max("lower").alias("lower")).withColumn("place", place).where(F.col("place") <= k)
    kth = kth.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("lower")).otherwise(float("-inf")).alias("kth"))
    left = few.join(kth, "query_id").where(F.col("upper") >= F.col("kth")).select("query_id", "vec_id", "same", "upper")
    exact = vectors.select(F.col("id").alias("vec_id"), "v", "dims", _digest("v").alias("same")).dropDuplicates(["vec_id", "same"])
    asked = queries.select(F.col("id").alias("query_id"), F.col("v").alias("q"), "dims").dropDuplicates(["query_id", "q"])
    read = left.join(exact, ["vec_id", "same"]).join(asked, ["query_id", "dims"]).select("query_id", "vec_id", "upper", "q", "v")
    best = read.groupBy("query_id").applyInPandas(_certain(k), "query_id long, vec_id long, score long, wide binary")
    # Beyond the limits of a long the wide number decides: it is greater than any long above, and less than any below.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.when(F.col("score") > 0, F.col("wide")).desc_nulls_last(), F.when(F.col("score") < 0, F.col("wide")).desc_nulls_first(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _digest(v: str):
    """Two independent 64-bit hashes of a vector."""
    return F.concat_ws(",", F.xxhash64(v).cast("string"), F.xxhash64(F.lit(1), F.reverse(v)).cast("string"))


def _files(vectors: DataFrame) -> list[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """Of each approximation file: dimensions, size class, rows, and the least and largest component of each dimension."""
    each = vectors.select("dims", "file", F.posexplode("v").alias("at", "x")).groupBy("dims", "file", "at").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n")).collect()
    by: dict[tuple[int, int], list] = {}
    for r in sorted(each, key=lambda r: (r["dims"], r["file"], r["at"])):
        by.setdefault((r["dims"], r["file"]), []).append(r)
    return [(*key, rs[0]["n"], np.array([r["low"] for r in rs]), np.array([r["high"] for r in rs])) for key, rs in by.items()]


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = written(whole_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 256), "vectors")
    return exact_top_k(vectors, vectors.where("id % 50 = 0"), 5)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""
