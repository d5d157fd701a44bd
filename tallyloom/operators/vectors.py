"""SIM-01 to SIM-05: vectors compared in a grid of blocks, clusters by leaders, picks by distance."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.sequence import fold_sorted
from tallyloom.sources.scratch import written

#: Rows of a block: two of them and their products are what a task holds.
BLOCK = 2048


def doubles(column: str) -> Column:
    return F.transform(column, lambda x: x.cast("double"))


def in_blocks(left: DataFrame, right: DataFrame, compare: Callable, schema: str) -> DataFrame:
    """compare(left rows, right rows, products) of every block of left with every block of right, as one table.

    Both sides have id, label and v (array<double>), all of one length; null vectors take no part. A block is a hash of the
    id, so a label of any size spreads out. compare gets pandas rows and the matrix of inner products and must return only
    what may still count, never all pairs. half: the sides are one table, and each pair of blocks meets once.
    """
    sides = []
    for df in (left, right):
        clean = df.where("id is not null and v is not null").select("id", "label", "v")
        n = max(1, -(-clean.count() // BLOCK))
        sides.append((clean.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")), n))
    (a, n_a), (b, n_b) = sides
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = a.withColumn("lb", F.col("own")).withColumn("rb", every(n_b))
    b = b.withColumn("rb", F.col("own")).withColumn("lb", every(n_a))

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({c.split()[0]: pd.Series(dtype="float64") for c in schema.split(", ")})
        return compare(x, y, np.stack(x["v"].to_list()) @ np.stack(y["v"].to_list()).T)

    return a.groupBy("lb", "rb").cogroup(b.groupBy("lb", "rb")).applyInPandas(meet, schema)


def _units(pdf: pd.DataFrame) -> np.ndarray:
    v = np.stack(pdf["v"].to_list())
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def top_k(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """SIM-02: query_id, rank, id, label and score (9 digits) of the k largest inner products of each query, its own id apart; ties to smaller ids."""

    def best(x: pd.DataFrame, y: pd.DataFrame, s: np.ndarray) -> pd.DataFrame:
        s = np.where(x["id"].to_numpy()[:, None] == y["id"].to_numpy()[None, :], -np.inf, np.round(s, 9))
        cut = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
        i, j = np.nonzero(np.isfinite(s) & (s >= cut[:, None]))
        order = np.lexsort((y["id"].to_numpy()[j], -s[i, j], i))
        i, j = i[order], j[order]
        top = np.arange(len(i)) - np.searchsorted(i, i) < k
        i, j = i[top], j[top]
        return pd.DataFrame({"query_id": x["id"].to_numpy()[i], "id": y["id"].to_numpy()[j], "label": y["label"].to_numpy()[j], "score": s[i, j]})

    found = in_blocks(queries, rows, best, "query_id long, id long, label int, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def best_per_class(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """SIM-02: query_id, label and best: the largest inner product with a vector of each label, the query's own id apart."""

    def best(x: pd.DataFrame, y: pd.DataFrame, s: np.ndarray) -> pd.DataFrame:
        s = np.where(x["id"].to_numpy()[:, None] == y["id"].to_numpy()[None, :], -np.inf, s)
        labels = y["label"].to_numpy()
        parts = [pd.DataFrame({"query_id": x["id"].to_numpy(), "label": label, "best": s[:, labels == label].max(1)}) for label in np.unique(labels)]
        return pd.concat(parts).query("best > -inf")

    return in_blocks(queries, rows, best, "query_id long, label int, best double").groupBy("query_id", "label").agg(F.round(F.max("best"), 6).alias("best"))


#: Pivots of a group at most, expected: its vectors are dealt to the nearest, and blocks of far pivots never meet.
PIVOTS = 512
#: Bundles that a group's blocks are dealt to, if it has as many, and blocks of a bundle at most.
BUNDLES, BUNDLE = 16, 32
#: What rounding to six digits and the sums of products may add to an angle.
_SLACK = 1e-5


def _dealt(rows: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """The unit vectors with the pivot that is nearest, and of each pivot (group, cell) its vector, radius and blocks.

    A group has a pivot for BLOCK rows, up to about PIVOTS of them: rows whose hash says so, of which there are as many as
    the group is large, however large it is. Vectors without a direction take no part.
    """
    finite = F.forall("v", lambda x: F.abs(x) < float("inf")) & F.exists("v", lambda x: x != 0)
    clean = rows.where(F.col("id").isNotNull() & finite & F.col(group).isNotNull()).select("id", "label", F.col(group).alias("grp"), "v")
    sizes = clean.groupBy("grp").agg(F.count("*").alias("n"))
    every = F.greatest(F.lit(BLOCK), F.ceil(F.col("n") / PIVOTS)).cast("long")
    sized = written(clean.join(sizes, "grp").withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.ceil(F.col("n") / (16 * BLOCK)).cast("int")).cast("int")), "units")
    # The vector of the least hash stands in where no other is a pivot.
    draw = F.pmod(F.xxhash64("id", F.lit(2)), every)
    drawn = sized.where(draw == 0).select("grp", "id", "v")
    first = sized.groupBy("grp").agg(F.min_by(F.struct("id", "v"), F.struct(F.xxhash64("id", F.lit(2)), "id")).alias("p")).select("grp", "p.id", "p.v")
    pivots = drawn.unionByName(first).dropDuplicates(["grp", "id"])
    parts = sizes.select("grp", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / (16 * BLOCK)).cast("int") - 1)).alias("part"))

    def assign(x: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(x):
            return pd.DataFrame({c: pd.Series(dtype="float64") for c in ("grp", "id", "label", "v", "cell", "angle")})
        p, u = p.sort_values("id"), _units(x)
        s = u @ _units(p).T
        at = s.argmax(1)
        angle = np.arccos(np.clip(s[np.arange(len(s)), at], -1, 1))
        return x[["grp", "id", "label"]].assign(v=list(u), cell=p["id"].to_numpy()[at], angle=angle)

    kind = rows.schema[group].dataType.simpleString()
    beside = pivots.join(parts, "grp").select(*(F.col(c).alias(c) for c in ("grp", "part", "id", "v")))
    left, right = sized.groupBy("grp", "part"), beside.groupBy("grp", "part")
    dealt = written(left.cogroup(right).applyInPandas(assign, f"grp {kind}, id long, label int, v array<double>, cell long, angle double"), "cells")
    cells = dealt.groupBy("grp", "cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n"))
    cells = cells.join(pivots.select("grp", F.col("id").alias("cell"), "v"), ["grp", "cell"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    return dealt, cells


def _meeting(cells: DataFrame, least: float) -> DataFrame:
    """grp and the cells (a, b) whose vectors can reach a cosine of `least`, each pair once, with their numbers of blocks."""
    reach = float(np.arccos(np.clip(least - 1e-6, -1, 1))) + _SLACK
    kind = cells.schema["grp"].dataType.simpleString()

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell", ignore_index=True)
        v, r = _units(pdf), pdf["radius"].to_numpy()
        angle = np.arccos(np.clip(v @ v.T, -1, 1))
        i, j = np.nonzero(np.triu(angle - r[:, None] - r <= reach))
        cell, blocks = pdf["cell"].to_numpy(), pdf["blocks"].to_numpy()
        return pd.DataFrame({"grp": pdf["grp"].iloc[0], "a": cell[i], "b": cell[j], "na": blocks[i], "nb": blocks[j]})

    return cells.groupBy("grp").applyInPandas(pairs, f"grp {kind}, a long, b long, na int, nb int")


def block_pairs(rows: DataFrame, least: float, group: str) -> tuple[int, int]:
    """How many pairs of blocks similar_pairs() compares, and how many there are."""
    _, cells = _dealt(rows, group)
    met = _meeting(cells, least).agg(F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("na") * (F.col("na") + 1) / 2).otherwise(F.col("na") * F.col("nb"))), F.lit(0))).first()[0]
    of = cells.groupBy("grp").agg(F.sum("blocks").alias("k")).agg(F.coalesce(F.sum(F.col("k") * (F.col("k") + 1) / 2), F.lit(0))).first()[0]
    return int(met), int(of)


def _near_blocks(rows: DataFrame, least: float, group: str, compare: Callable, schema: str, reduce: Callable = lambda found: found) -> DataFrame:
    """compare() of all blocks of each group that can hold a pair of `least`: rows of both sides and their cosines.

    Each pair of blocks meets once. A group's blocks are dealt to bundles and a task compares the blocks of two of them, one
    pair after the other, so a vector is copied once for each bundle that it meets, and not for each block: BUNDLES times at
    most up to BUNDLES * BUNDLE blocks (a million vectors). What a task found goes through reduce().
    """
    dealt, cells = _dealt(rows, group)
    met = _meeting(cells, least)
    ks = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    met = met.withColumn("ka", ks("na")).withColumn("kb", ks("nb")).where("a <> b or ka <= kb").select("grp", "a", "b", "ka", "kb")
    # Blocks are as many as there are vectors for each: numbering them is small.
    w = Window.partitionBy("grp")
    bundles = F.greatest(F.least(F.col("of"), F.lit(BUNDLES)), F.ceil(F.col("of") / BUNDLE))
    blocks = cells.select("grp", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k")).withColumns({"u": F.row_number().over(w.orderBy("cell", "k")), "of": F.count("*").over(w)})
    blocks = written(blocks.select("grp", "cell", "k", "u", F.pmod("u", bundles).cast("int").alias("g")), "blocks")
    end = lambda cell, k, side: blocks.select("grp", F.col("cell").alias(cell), F.col("k").alias(k), F.struct("g", "u").alias(side))
    ends = met.join(end("a", "ka", "one"), ["grp", "a", "ka"]).join(end("b", "kb", "two"), ["grp", "b", "kb"])
    ends = written(ends.select("grp", F.least("one", "two").alias("l"), F.greatest("one", "two").alias("r")).select("grp", F.col("l.g").alias("ga"), F.col("r.g").alias("gb"), F.col("l.u").alias("ua"), F.col("r.u").alias("ub")), "met")
    placed = dealt.join(cells.select("grp", "cell", "blocks"), ["grp", "cell"]).withColumn("k", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int"))
    placed = placed.join(blocks, ["grp", "cell", "k"]).select("grp", "u", "id", "label", "v")
    keys = ["grp", "ga", "gb"]
    side = lambda u: placed.join(ends.select(*keys, F.col(u).alias("u")).distinct(), ["grp", "u"]).select(*(F.col(c).alias(c) for c in (*keys, "u", "id", "label", "v")))
    # A row without a vector tells which blocks of the other side one of these meets.
    empty = {c: F.lit(None).cast(placed.schema[c].dataType) for c in ("id", "label", "v")}
    tells = ends.groupBy(*keys, F.col("ua").alias("u")).agg(F.collect_list("ub").alias("meets")).withColumns(empty)
    left = side("ua").withColumn("meets", F.lit(None).cast("array<int>")).unionByName(tells)

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        parts, told = [pd.DataFrame({c.split()[0]: pd.Series(dtype="float64") for c in schema.split(", ")})], x["meets"].notna()
        units = lambda df: {u: (own, np.stack(own["v"].to_list())) for u, own in df.groupby("u")}
        own, others = units(x[~told]), units(y)
        for u, meets in zip(x["u"][told], x["meets"][told], strict=True):
            for other in meets:
                if u in own and other in others:
                    (a, va), (b, vb) = own[u], others[other]
                    parts.append(compare(a, b, va @ vb.T))
        return reduce(pd.concat([p for p in parts if len(p)] or parts))

    return left.groupBy(*keys).cogroup(side("ub").groupBy(*keys)).applyInPandas(meet, schema)


def similar_pairs(rows: DataFrame, least: float) -> DataFrame:
    """SIM-05: id, other (id < other) and sim (cosine, 6 digits) of all pairs of one label that reach `least`.

    Labels are compared within themselves. A label's vectors are dealt to the nearest of its pivots; two pivots' blocks meet
    only if their angle less both radii allows the similarity, so that clustered vectors meet few others. Rows without an
    id, label, vector or direction take no part.
    """

    def near(x: pd.DataFrame, y: pd.DataFrame, s: np.ndarray) -> pd.DataFrame:
        s, a, b = np.round(s, 6), x["id"].to_numpy(), y["id"].to_numpy()
        i, j = np.nonzero(s >= least)
        out = pd.DataFrame({"id": np.minimum(a[i], b[j]), "other": np.maximum(a[i], b[j]), "sim": s[i, j]})
        return out[out["id"] != out["other"]].drop_duplicates(["id", "other"])

    return _near_blocks(rows, least, "label", near, "id long, other long, sim double")


def nearest_of_other_classes(rows: DataFrame, least: float) -> DataFrame:
    """SIM-05: id, other and sim of each vector's most similar one of another label, if it reaches `least`; ties to larger ids.

    As similar_pairs(), over the vectors of all labels at once.
    """

    def best(x: pd.DataFrame, y: pd.DataFrame, s: np.ndarray) -> pd.DataFrame:
        s = np.where(x["label"].to_numpy()[:, None] == y["label"].to_numpy()[None, :], -np.inf, np.round(s, 6))
        parts = []
        for one, other, t in ((x, y, s), (y, x, s.T)):
            ids = other["id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            t = t[:, order]
            at = t.shape[1] - 1 - np.argmax(t[:, ::-1], axis=1)
            parts.append(pd.DataFrame({"id": one["id"].to_numpy(), "other": ids[order][at], "sim": t[np.arange(len(t)), at]}))
        out = pd.concat(parts)
        return out[out["sim"] >= least]

    labelled = rows.where("label is not null").withColumn("all", F.lit(0))
    most = lambda found: found.sort_values(["sim", "other"]).drop_duplicates("id", keep="last")
    found = _near_blocks(labelled, least, "all", best, "id long, other long, sim double", most)
    return found.groupBy("id").agg(F.max(F.struct("sim", "other")).alias("m")).select("id", "m.other", "m.sim")


def centroids(rows: DataFrame) -> DataFrame:
    """label and centre (array<double>): the mean vector of each label, summed in parts before the shuffle."""
    parts = rows.select("label", F.posexplode("v").alias("at", "x")).groupBy("label", "at").agg(F.avg("x").alias("x"))
    return parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("centre"))


def leaders(rows: DataFrame, similarity: float) -> DataFrame:
    """SIM-03: id and leader: per label, in the order of the ids, the first leader of `similarity` or more takes a vector, else it leads.

    A label's rows stream through one task in order, since each decision rests on all before it; it holds the leaders.
    """

    def step(state: dict, row: tuple) -> Iterator[tuple]:
        own, v = row
        v = np.asarray(v, float)
        n = len(state["ids"])
        near = np.flatnonzero(state["x"][:n] @ v >= similarity) if n else []
        if len(near):
            yield own, state["ids"][near[0]]
            return
        if n == len(state["x"]):
            state["x"] = np.concatenate((state["x"].reshape(-1, len(v)), np.zeros((max(16, n), len(v)))))
        state["x"][n] = v
        state["ids"].append(own)
        yield own, own

    clean = rows.where("id is not null and v is not null")
    return fold_sorted(clean, "label", ["id"], ["id", "v"], lambda label: {"ids": [], "x": np.zeros((0, 1))}, step, lambda state: [], "id long, leader long")


def farthest_first(rows: DataFrame, picks: int) -> DataFrame:
    """SIM-04: label, id and rank of `picks` vectors of each label: the smallest id, then each time that farthest from all before.

    Each pick is one aggregation over all rows, which carry their distance to the picks so far; only a label's last pick
    is joined back. Ties go to smaller ids.
    """
    state = rows.where("id is not null and v is not null").select("label", "id", "v", F.lit(float("inf")).alias("far"))
    chosen = state.groupBy("label").agg(F.min_by(F.struct("id", "v"), "id").alias("p")).select("label", "p.id", "p.v")
    out = chosen.select("label", "id", F.lit(1).alias("rank"))
    for rank in range(2, picks + 1):
        last = chosen.select(F.col("label").alias("_l"), F.col("v").alias("_v"))
        distance = F.aggregate(F.zip_with("v", "_v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        state = state.join(last, F.col("label").eqNullSafe(F.col("_l"))).select("label", "id", "v", F.least("far", F.round(distance, 9)).alias("far"))
        chosen = state.groupBy("label").agg(F.max_by(F.struct("id", "v", "far"), F.struct("far", -F.col("id"))).alias("p")).where("p.far > 0").select("label", "p.id", "p.v")
        out = out.unionByName(chosen.select("label", "id", F.lit(rank).alias("rank")))
    return out
