"""Approximate nearest neighbours by balanced posting lists.

Inner product becomes distance by one more dimension, sqrt(M^2 - |x|^2) with M the largest norm. Centroids are fitted on a
bounded sample by balanced splitting, as many as a list then has rows; every row goes to its nearest centroid's list and,
near a boundary, to those of further centroids within a distance ratio. Centroids are searched through an in-memory
neighbour graph, by rows and by queries, at every size. A query reads the lists within a distance ratio of its nearest one; both ratios are tuned on the
sample for a recall of TUNE_RECALL at the fewest rows met. It reads its nearest list first; the k-th score found there goes along to its other
lists, which return only rows that reach it. Lists and their queries are dealt out in blocks of bounded size, so a list of
any length fits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm._common import table, written

#: Rows that the centroids are fitted on: LIST_SAMPLE of them a list, LEAST_SAMPLE at least (or all) and SAMPLE at most.
SAMPLE, LEAST_SAMPLE, LIST_SAMPLE = 65_536, 16_384, 8
#: Lists of a row at most, distance ratios up to which a row may be replicated: the sample says which is best.
REPLICAS, REPLICA_RATIOS = 4, (1.005, 1.02, 1.05, 1.15)
#: Share of the true neighbours within the sample that a query's lists must hold there.
TUNE_RECALL = 0.965
#: Rows and queries that meet in one block.
ROW_BLOCK, QUERY_BLOCK = 4_096, 2_048
#: Nodes of the graph that a search opens at once, and nodes beyond the wanted ones that it must find no nearer way from.
WIDTH, BEAM = 4, 16


def usable_vectors(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """id and v (array<double>): rows with an id and a vector that isn't zero and whose components are all finite."""
    x = F.col(vector)
    finite = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))), F.lit(False))
    return df.where(x.isNotNull() & F.col(id_column).isNotNull() & finite & F.exists(x, lambda c: c != 0)).select(F.col(id_column).cast("long").alias("id"), F.transform(x, lambda c: c.cast("double")).alias("v"))


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None, :], 0))


def balanced_centroids(x: np.ndarray, lists: int, seed: int = 5) -> np.ndarray:
    """Splits the largest group in two halves by a balanced two-means until there are `lists` groups; their means."""
    rng = np.random.default_rng(seed)
    groups = [(-len(x), 0, np.arange(len(x)))]  # a heap, the largest group first
    born = 1
    while len(groups) < lists and len(groups[0][2]) > 1:
        own = heapq.heappop(groups)[2]
        a, b = x[rng.choice(own, 2, replace=False)]
        for _ in range(4):
            side = np.argsort(x[own] @ (b - a), kind="stable")
            left, right = own[side[: len(own) // 2]], own[side[len(own) // 2 :]]
            a, b = x[left].mean(0), x[right].mean(0)
        for part in (left, right):
            heapq.heappush(groups, (-len(part), born, part))
            born += 1
    return np.stack([x[g].mean(0) for *_, g in sorted(groups, key=lambda g: g[1])])


class Graph:
    """A neighbour graph over centroids with long links, searched best-first for many points at once.

    One long link of each node leads to the next node of a random cycle, so every node can be reached.
    """

    def __init__(self, centroids: np.ndarray, degree: int = 24):
        self.c = centroids
        n = len(centroids)
        rng = np.random.default_rng(11)
        near = np.empty((n, min(degree, n - 1)), np.int32)
        for start in range(0, n, 1024):
            d = _distances(centroids[start : start + 1024], centroids)
            d[np.arange(len(d)), np.arange(start, start + len(d))] = np.inf
            near[start : start + len(d)] = np.argpartition(d, near.shape[1] - 1, axis=1)[:, : near.shape[1]]
        cycle = rng.permutation(n).astype(np.int32)
        after = np.empty((n, 1), np.int32)
        after[cycle, 0] = np.roll(cycle, -1)
        links = np.sort(np.concatenate((near, after, rng.integers(0, n, (n, min(7, n)), dtype=np.int32)), axis=1), axis=1)
        again = np.zeros(links.shape, bool)
        again[:, 1:] = links[:, 1:] == links[:, :-1]
        self.links = np.where(again, np.arange(n)[:, None], links)  # a link to itself leads nowhere: each other one is there once
        self.entries = cycle[: min(n, 32)]
        self.sizes = (centroids**2).sum(1)

    def search(self, x: np.ndarray, least: int, ratio: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Centroids of each point within `ratio` of its nearest one's distance and at least the `least` nearest, with
        their distances, nearest first; -1 and inf where a point has fewer than others.

        The search goes on while an unopened node lies within the ratio or among the least + BEAM nearest known ones.
        """
        n, rows = len(self.c), np.arange(len(x))
        least = min(least, n)
        seen = np.zeros((len(x), n), bool)
        seen[:, self.entries] = True
        ids = np.tile(self.entries, (len(x), 1))
        dist = _distances(x, self.c[self.entries])
        opened = np.zeros(ids.shape, bool)
        own = (x**2).sum(1)
        while True:
            order = np.argsort(dist, axis=1, kind="stable")
            ids, dist, opened = (np.take_along_axis(a, order, 1) for a in (ids, dist, opened))
            within = dist <= dist[:, :1] * ratio + 1e-12
            reach = within | (np.arange(dist.shape[1]) < least + BEAM)
            width = max(1, int((reach & np.isfinite(dist)).sum(1).max()))
            ids, dist, opened, within, reach = (a[:, :width] for a in (ids, dist, opened, within, reach))
            waiting = ~opened & np.isfinite(dist) & reach
            live = np.flatnonzero(waiting.any(1))
            if not len(live):
                break
            opened = opened.copy()
            more_ids, more_dist = [], []
            for _ in range(WIDTH):
                at = np.argmax(waiting, axis=1)  # a point without a waiting node opens its nearest again, which adds nothing
                opened[rows, at] |= waiting[rows, at]
                waiting[rows, at] = False
                nxt = self.links[ids[rows, at]]
                new = ~np.take_along_axis(seen, nxt, 1)
                new[~opened[rows, at]] = False
                row, to = np.nonzero(new)
                seen[row, nxt[row, to]] = True
                d = np.full(nxt.shape, np.inf)
                d[row, to] = np.sqrt(np.maximum(own[row] - 2 * np.einsum("ij,ij->i", x[row], self.c[nxt[row, to]]) + self.sizes[nxt[row, to]], 0))
                more_ids.append(nxt)
                more_dist.append(d)
            ids, dist = np.concatenate((ids, *more_ids), 1), np.concatenate((dist, *more_dist), 1)
            opened = np.concatenate((opened, *(np.isinf(d) for d in more_dist)), 1)
        keep = np.isfinite(dist) & (within | (np.arange(dist.shape[1]) < least))
        width = max(1, int(keep.sum(1).max()))
        return np.where(keep, ids, -1)[:, :width], np.where(keep, dist, np.inf)[:, :width]


def _chosen(dist: np.ndarray, ratio: float) -> np.ndarray:
    return np.isfinite(dist) & (dist <= dist[:, :1] * ratio + 1e-12)


def _lists_of(graph: Graph, x: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, list, distance against the nearest) of every list that each point is filed under, up to REPLICAS of a point."""
    rows, lists, against = [], [], []
    for start in range(0, len(x), 1024):
        found, dist = (a[:, :REPLICAS] for a in graph.search(x[start : start + 1024], REPLICAS))
        row, at = np.nonzero(_chosen(dist, ratio))
        rows.append(row + start)
        lists.append(found[row, at])
        against.append(dist[row, at] / np.maximum(dist[row, 0], 1e-300))
    return np.concatenate(rows), np.concatenate(lists), np.concatenate(against)


def _tuned(graph: Graph, sample: np.ndarray, plain: np.ndarray, k: int) -> tuple[float, float]:
    """The ratio up to which a row is filed again and that up to which a query reads lists: of those at which the sample's
    lists hold TUNE_RECALL of its true neighbours, the ones by which a query meets the fewest rows."""
    ask = np.arange(0, len(sample), max(1, len(sample) // 400))
    k = min(k, len(sample) - 1)
    truth = np.zeros((len(ask), k), np.int64)
    for start in range(0, len(ask), 64):
        part = ask[start : start + 64]
        score = plain[part] @ plain.T
        score[np.arange(len(part)), part] = -np.inf
        truth[start : start + 64] = np.argsort(-score, axis=1, kind="stable")[:, :k]
    row, own, against = _lists_of(graph, sample, max(REPLICA_RATIOS))
    dist = _distances(np.concatenate((plain[ask], np.zeros((len(ask), 1))), 1), graph.c)
    best = (float("inf"), min(REPLICA_RATIOS), float("inf"))
    for replica in REPLICA_RATIOS:
        kept = against <= replica
        some, lists = row[kept], own[kept]
        sizes = np.bincount(lists, minlength=len(graph.c))
        # Each row's lists, its nearest again in place of those it hasn't.
        begin = np.searchsorted(some, np.arange(len(sample)))
        filed = np.repeat(lists[begin][:, None], REPLICAS, axis=1)
        filed[some, np.arange(len(some)) - begin[some]] = lists
        for ratio in (1.0, 1.02, 1.04, 1.06, 1.08, 1.1, 1.12, 1.14, 1.16, 1.18, 1.2, 1.25, 1.3, 1.4, 1.6, 2.0, 4.0, float("inf")):
            got = dist <= dist.min(1, keepdims=True) * ratio + 1e-12
            if not truth.size or np.mean([g[filed[t]].any(1).mean() for t, g in zip(truth, got, strict=True)]) >= TUNE_RECALL:
                best = min(best, (float((got @ sizes).mean()), replica, ratio))
                break
    return best[1:]


def _assign(graph: Graph, largest: float, replica: float):
    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), 1024):
                part = pdf.iloc[start : start + 1024]
                v = np.stack(part["v"].to_list())
                row, lists, _ = _lists_of(graph, np.concatenate((v, np.sqrt(np.maximum(largest**2 - (v**2).sum(1), 0))[:, None]), 1), replica)
                yield pd.DataFrame({"list": lists.astype(np.int32), "id": part["id"].to_numpy()[row], "v": [x.tobytes() for x in v[row]]})

    return assign


def _ask(graph: Graph, ratio: float, sizes: np.ndarray, enough: int):
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The lists that each query reads, place 0 for its nearest; lists with too few rows are joined by the next ones."""
        for pdf in batches:
            for start in range(0, len(pdf), 256):
                part = pdf.iloc[start : start + 256]
                v = np.stack(part["v"].to_list())
                points, left, least = np.concatenate((v, np.zeros((len(v), 1))), 1), np.arange(len(v)), 1
                while len(left):
                    lists, _ = graph.search(points[left], least, ratio)
                    held = np.where(lists >= 0, sizes[lists], 0).sum(1)
                    done = (held >= enough) | (least >= len(graph.c))
                    row, at = np.nonzero((lists >= 0) & done[:, None])
                    own = left[row]
                    yield pd.DataFrame({"list": lists[row, at].astype(np.int32), "place": at.astype(np.int32), "id": part["id"].to_numpy()[own], "v": [x.tobytes() for x in v[own]]})
                    left, least = left[~done], least * 4

    return ask


def _compare(k: int):
    def compare(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        """Each query's best k ids of the block whose scores reach the query's `least`."""
        out = []
        if len(queries) and len(rows):
            rows = rows.sort_values(["v", "id"], kind="stable").drop_duplicates(["v", "id"])
            rows = rows[rows.groupby("v", sort=False).cumcount() <= k]  # of equal vectors only the k + 1 smallest ids can count
            rows = rows.sort_values("id", kind="stable")
            rid, first, copies = np.unique(rows["id"].to_numpy(), return_index=True, return_counts=True)
            qid, least = queries["id"].to_numpy(), queries["least"].to_numpy()
            q = np.frombuffer(b"".join(queries["v"]), np.float64).reshape(len(queries), -1)
            r = np.frombuffer(b"".join(rows["v"]), np.float64).reshape(len(rows), -1)
            for start in range(0, len(q), 512):
                part = slice(start, start + 512)
                score = np.maximum.reduceat(q[part] @ r.T, first, axis=1)  # an id's rows are one candidate
                score[qid[part][:, None] == rid[None, :]] = -np.inf
                cut = least[part] if len(rid) <= k else np.maximum(least[part], np.partition(score, -k, axis=1)[:, -k])
                # What may reach the cut, in double precision and with all that may tie there.
                slack = 1e-9 * (1 + np.where(np.isfinite(cut), np.abs(cut), 0))
                a, b = np.nonzero(np.isfinite(score) & (score >= (cut - slack)[:, None]))
                if not len(a):
                    continue
                pair = np.repeat(np.arange(len(a)), copies[b])
                row = first[b][pair] + np.arange(len(pair)) - np.searchsorted(pair, pair)
                exact = np.maximum.reduceat(np.einsum("ij,ij->i", q[part][a[pair]], r[row]), np.searchsorted(pair, np.arange(len(a))))
                keep = exact >= least[part][a]
                a, b, exact = a[keep], b[keep], exact[keep]
                order = np.lexsort((rid[b], -exact, a))
                a, b, exact = a[order], b[order], exact[order]
                top = np.arange(len(a)) - np.searchsorted(a, a) < k
                out.append(pd.DataFrame({"query_id": qid[part][a[top]], "vec_id": rid[b[top]], "score": exact[top]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    return compare


def _counts(df: DataFrame, lists: int) -> np.ndarray:
    out = np.zeros(lists, np.int64)
    for r in df.groupBy("list").count().collect():  # one number per list
        out[r["list"]] = r["count"]
    return out


def _met(asked: DataFrame, postings: DataFrame, sizes: np.ndarray, k: int) -> DataFrame:
    """query_id, vec_id, score of the best of every block of a list for every query of (list, id, v, least)."""
    asks = _counts(asked, len(sizes))
    n_blocks, n_queues = (F.get(F.lit(np.maximum(1, -(-n // block)).tolist()).cast("array<int>"), F.col("list")) for n, block in ((sizes, ROW_BLOCK), (asks, QUERY_BLOCK)))
    rows = postings.withColumn("block", F.pmod(F.xxhash64("id"), n_blocks).cast("int")).withColumn("queue", F.explode(F.sequence(F.lit(0), n_queues - 1)))
    asked = asked.withColumn("queue", F.pmod(F.xxhash64("id"), n_queues).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    cell = ["list", "block", "queue"]
    found = asked.groupBy(*cell).cogroup(rows.groupBy(*cell)).applyInPandas(_compare(k), "query_id long, vec_id long, score double")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def lists_for(rows: int) -> int:
    """As many lists as a list has rows, so that centroids and rows cost a query alike; the sample limits them to 8,192."""
    return isqrt(rows)


def _within(vectors: DataFrame, queries: DataFrame, k: int, count: int, largest: float) -> DataFrame:
    """nearest() for vectors and queries of one number of dimensions; count rows of norm up to largest."""
    size = min(SAMPLE, max(LEAST_SAMPLE, LIST_SAMPLE * lists_for(count)))
    picked = vectors.orderBy(F.xxhash64("id", F.lit(3)), "id", "v").select("v").limit(size).toArrow()["v"].combine_chunks()
    plain = picked.flatten().to_numpy().reshape(len(picked), -1)
    sample = np.concatenate((plain, np.sqrt(np.maximum(largest**2 - (plain**2).sum(1), 0))[:, None]), 1)
    graph = Graph(balanced_centroids(sample, max(1, min(lists_for(count), len(sample) // LIST_SAMPLE))))
    replica, ratio = _tuned(graph, sample, plain, k)
    postings = written(vectors.mapInPandas(_assign(graph, largest, replica), "list int, id long, v binary"), "postings")
    sizes = _counts(postings, len(graph.c))
    asked = written(queries.mapInPandas(_ask(graph, ratio, sizes, REPLICAS * (k + 1)), "list int, place int, id long, v binary"), "asked")
    first = written(_best(_met(asked.where("place = 0").withColumn("least", F.lit(float("-inf"))), postings, sizes, k), k), "nearest-lists")
    least = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
    others = asked.where("place > 0").join(least, "id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    rest = _met(others, postings, sizes, k)
    return _best(first.select("query_id", "vec_id", "score").unionByName(rest).groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products found for every query, ties to smaller ids.

    Both tables have id and v as usable_vectors() gives them (vectors that are null, empty or zero or hold something null
    or non-finite never reach here). A query's candidates are the rows of another id and as many dimensions; each number
    of dimensions has lists of its own. With up to k candidates all are returned. Rows that repeat an id are one candidate
    or query with the best of their scores. Empty tables give an empty result.
    """
    shapes = vectors.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)).alias("norm")).orderBy("dims").collect()
    parts = [_within(*(df.where(F.size("v") == s["dims"]) for df in (vectors, queries)), k, s["n"], float(np.sqrt(s["norm"]))) for s in shapes]
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, parts).select("query_id", "rank", "vec_id", "score")


def op7_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = written(usable_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "vectors")
    return nearest(vectors, vectors.where("id % 20 = 0"), 20)
