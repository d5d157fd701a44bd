"""MinHash near-duplicates by an LSH forest.

Every text becomes the set of its distinct five-word shingles; equal sets are one class. A class has one MinHash
signature; a tree of the forest is a sorted order of the classes by some permutation of the signature's places.
Candidates are neighbours in an order, that is those with the longest common prefix, if they share at least the first
DEPTH places; in a crowded region neighbours share a longer prefix, so the depth follows the density. A second pass
compares, within each region of three or more, all members that the links found so far leave in different components;
a crowded region is dealt as a grid of cells, each a block of members against another. Candidates are confirmed on the
full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm._common import drop_written, table, written
from tallyloom.llm._text import U, mix, shingle_sets
from tallyloom.llm.components import components

#: Places of a signature, trees, places that a region shares, further places that a tree's order sorts by.
PLACES, TREES, DEPTH, FURTHER = 72, 24, 3, 6
#: Equal places that a candidate needs: at a similarity of 0.75 the mean is 54 and 36 lies five deviations below.
AGREE = 36
#: Places of the finer signature that the second pass compares, and how many must agree (mean 192, five deviations below).
FINE, FINE_AGREE = 256, 158
#: Members up to which a region is compared row by row; members of a block and of a piece of it in the grid of a larger one.
CROWD, BLOCK, PIECE = 128, 2048, 256
#: Bits of the filter that spares texts without candidates a shuffle: 4 MB.
FILTER_BITS = 1 << 25

_SEEDS = mix(np.arange(1, 2 * FINE + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
_ORDERS = [np.concatenate((np.arange(t * DEPTH, (t + 1) * DEPTH), np.random.default_rng(t).permutation([p for p in range(PLACES) if not t * DEPTH <= p < (t + 1) * DEPTH])[:FURTHER])) for t in range(TREES)]


def signatures(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """As many minima of each non-empty set of 64-bit hashes as places under multiply-add permutations, one row a set."""
    out = np.empty((len(sets), places), np.uint32)
    begin = 0
    while begin < len(sets):  # so many sets at once as stay in a core's cache, a larger one alone
        end, size = begin + 1, len(sets[begin])
        while end < len(sets) and size + len(sets[end]) <= 60_000:
            size += len(sets[end])
            end += 1
        values = np.concatenate(sets[begin:end])
        starts = np.concatenate(([0], np.cumsum([len(x) for x in sets[begin : end - 1]]))).astype(np.int64)
        for at in range(places):
            out[begin:end, at] = np.minimum.reduceat((values * (_SEEDS[2 * at] | U(1)) + _SEEDS[2 * at + 1]) >> U(32), starts)
        begin = end
    return out


def _describe(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        sizes, digests, signs = [], [], []
        held: list[np.ndarray] = []

        def flush():
            signs.extend(x.tobytes() for x in signatures(held).astype(">u4"))
            held.clear()

        waiting = 0
        for _, values in shingle_sets(list(texts)):
            sizes.append(len(values))
            spread = mix(values)
            digests.append((spread.sum(dtype=np.uint64).astype(np.int64), np.bitwise_xor.reduce(spread * U(0x5851F42D4C957F2D)).astype(np.int64)))
            if len(values):
                held.append(values)
                waiting += len(values)
            if waiting > 500_000:
                flush()
                waiting = 0
        flush()
        each = iter(signs)
        low, high = zip(*digests, strict=True) if digests else ((), ())
        yield pd.DataFrame({"n_shingles": sizes, "low": np.array(low, np.int64), "high": np.array(high, np.int64), "signature": [next(each) if n else None for n in sizes]})


def described(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a digest of the set (low, high) and its signature (null: empty set), one row per document."""
    describe = F.pandas_udf(_describe, "n_shingles long, low long, high long, signature binary").asNondeterministic()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), describe(F.col("text").cast("string")).alias("set")).select("doc_id", "set.*")


def _slack(x, y):
    """How many members two sets may seem to share or miss by collisions of 32 bits: six deviations over the mean, and two."""
    mean = (x.astype(float) ** 2 / 2 + y.astype(float) ** 2 / 2 + x.astype(float) * y) / (1 << 32)
    return 2 + np.ceil(mean + 6 * np.sqrt(mean)).astype(np.int64)


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ids, members = [], []
        for i, values in shingle_sets(list(pdf["text"])):
            if len(values):
                ids.append(pdf["doc_id"].iloc[i])
                members.append(values)
        fine = signatures(members, FINE).astype(np.uint8)
        yield pd.DataFrame({"id": pd.Series(ids, dtype="int64"), "members": [x.astype(np.int64) for x in members], "packed": [np.unique((x >> U(32)).astype(np.uint32)).tobytes() for x in members], "fine": [x.tobytes() for x in fine]})


def _plant(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of a class in every tree: region key of the first places, the further places, the class."""
    for pdf in batches:
        if not len(pdf):
            continue
        signs = np.frombuffer(b"".join(pdf["signature"]), ">u4").reshape(len(pdf), PLACES)
        wide = signs.astype(np.uint64)
        for t, order in enumerate(_ORDERS):
            key = np.full(len(pdf), mix(np.array([t + 1], np.uint64))[0])
            for p in order[:DEPTH]:
                key = mix(key ^ (wide[:, p] + U(0x9E3779B97F4A7C15)))
            rest = np.ascontiguousarray(signs[:, order[DEPTH:]])
            yield pd.DataFrame({"region": key.astype(np.int64), "further": [x.tobytes() for x in rest], "id": pdf["id"].to_numpy()})


_FOUND = "kind string, region long, further binary, id long, other long"


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Neighbour pairs ('pair'), the members of regions of three or more ('member') and both ends of the rows ('edge').

    Streams over one sorted partition and holds only the current batch and the two rows before it.
    """
    tail: pd.DataFrame | None = None
    first = True
    pending: list[pd.DataFrame] = []  # rows of the open region that are not known to be of three or more
    for pdf in batches:
        if not len(pdf):
            continue
        if first:
            yield pdf.head(2).assign(kind="edge", other=None)
            first = False
        region, ids = pdf["region"].to_numpy(), pdf["id"].to_numpy()
        if tail is not None:
            region, ids = np.concatenate((tail["region"].to_numpy(), region)), np.concatenate((tail["id"].to_numpy(), ids))
        same = region[1:] == region[:-1]
        fresh = len(region) - len(pdf)  # pairs among the carried rows are known
        at = np.flatnonzero(same)
        at = at[at + 1 >= max(fresh, 1)]
        if len(at):
            a, b = ids[at], ids[at + 1]
            yield pd.DataFrame({"kind": "pair", "region": region[at], "further": None, "id": np.minimum(a, b), "other": np.maximum(a, b)}).query("id != other")
        both = np.flatnonzero(same[1:] & same[:-1])  # middle rows of three in a region
        three = np.unique(np.concatenate((both, both + 1, both + 2)))
        if len(three):
            yield pd.DataFrame({"kind": "member", "region": region[three], "further": None, "id": ids[three], "other": None})
        tail = pdf.tail(2) if len(pdf) >= 2 or tail is None else pd.concat((tail.tail(1), pdf))
    if tail is not None:
        yield tail.assign(kind="edge", other=None)


def _forest(classes: DataFrame, tasks: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidate pairs (a, b) and the members (region, id) of regions of three or more, and the written table of both."""
    rows = classes.select("id", "signature").mapInPandas(_plant, "region long, further binary, id long")
    ordered = rows.repartitionByRange(tasks, "region", "further", "id").sortWithinPartitions("region", "further", "id")
    found = written(ordered.mapInPandas(_walk, _FOUND), "forest")
    # A region that a partition's end cuts: the outer rows of all partitions, at most four of each, in one more order.
    edges = found.where("kind = 'edge'").select("region", "further", "id").distinct()
    cut = edges.coalesce(1).sortWithinPartitions("region", "further", "id").mapInPandas(_walk, _FOUND)
    all_found = found.where("kind != 'edge'").unionByName(cut.where("kind != 'edge'"))
    pairs = all_found.where("kind = 'pair'").select(F.col("id").alias("a"), F.col("other").alias("b")).distinct()
    members = all_found.where("kind = 'member'").select("region", "id").distinct()
    return pairs, members, found


def _score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Equal places of the signatures of each pair."""
    for pdf in batches:
        if len(pdf):
            left, right = (np.frombuffer(b"".join(pdf[c]), np.uint32).reshape(len(pdf), PLACES) for c in ("sa", "sb"))
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "agree": (left == right).sum(1).astype(np.int32)})


def _meet(percent: int):
    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Links between different components of regions of up to CROWD members: each row with all before it.

        A pair whose fine signatures agree in enough places is compared on sets of 32 bits a shingle, unless links of this
        task have joined its components already; what reaches the similarity but for collisions (_slack) leaves the task,
        to be confirmed on the full sets.
        """
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        tail: pd.DataFrame | None = None
        for pdf in batches:
            if not len(pdf):
                continue
            known = 0 if tail is None else len(tail)
            pdf = pdf if tail is None else pd.concat((tail, pdf), ignore_index=True)
            key, part, ids, members = (pdf[c].to_numpy() for c in ("region", "component", "id", "members"))
            fine = np.frombuffer(b"".join(pdf["fine"]), np.uint8).reshape(len(pdf), FINE)
            links = []
            for back in range(1, min(CROWD, len(pdf) - 1) + 1):
                at = np.flatnonzero((key[back:] == key[:-back]) & (part[back:] != part[:-back]))
                at = at[at + back >= known]
                at = at[(fine[at] == fine[at + back]).sum(1) >= FINE_AGREE]
                for i in at.tolist():
                    a, b = root(int(part[i])), root(int(part[i + back]))
                    if a != b:
                        x, y = np.frombuffer(members[i], np.uint32), np.frombuffer(members[i + back], np.uint32)
                        both, off = len(np.intersect1d(x, y, assume_unique=True)), int(_slack(np.int64(len(x)), np.int64(len(y))))
                        if (both + off) * 100 >= (len(x) + len(y) - both - off) * percent:
                            links.append((int(ids[i]), int(ids[i + back])))
                        if (both - off) * 100 >= (len(x) + len(y) - both + off) * percent:
                            parent[max(a, b)] = min(a, b)
            yield pd.DataFrame(links, columns=["a", "b"]).astype("int64")
            tail = pdf.tail(CROWD)

    return meet


class _Piece:
    """Up to PIECE members of a crowded region."""

    def __init__(self, pdf: pd.DataFrame):
        self.ids, self.parts = pdf["id"].to_numpy(), pdf["component"].to_numpy()
        self.fine = np.frombuffer(b"".join(pdf["fine"]), np.uint8).reshape(len(pdf), FINE)
        self.sets = [np.frombuffer(x, np.uint32) for x in pdf["members"]]
        self.sizes = np.array([len(x) for x in self.sets], np.int64)


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each of the left sets with each of the right ones, by products of 0-1 matrices."""
    sides = [(np.concatenate(x), np.repeat(np.arange(len(x)), [len(v) for v in x])) for x in (left, right)]
    both = np.intersect1d(np.unique(sides[0][0]), np.unique(sides[1][0]), assume_unique=True)
    out = np.zeros((len(left), len(right)))
    if not len(both):
        return out
    placed = []
    for values, row in sides:
        at = np.minimum(np.searchsorted(both, values), len(both) - 1)
        on = both[at] == values
        order = np.argsort(at[on], kind="stable")
        placed.append((at[on][order], row[on][order]))
    for first in range(0, len(both), 8192):
        ones = []
        for (at, row), n in zip(placed, out.shape, strict=True):
            begin, end = np.searchsorted(at, (first, first + 8192))
            one = np.zeros((n, min(8192, len(both) - first)), np.float32)
            one[row[begin:end], at[begin:end] - first] = 1
            ones.append(one)
        out += ones[0] @ ones[1].T
    return out


def _cross(percent: int):
    def cross(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Links between different components of each cell of a crowded region: every row of one block with every row of
        the other. The tests are those of _meet. Holds one block; the other passes by."""
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        def compare(x: _Piece, y: _Piece, links: list[tuple[int, int]]) -> None:
            roots = [np.array([root(int(c)) for c in p.parts]) for p in (x, y)]
            small, large = np.minimum.outer(x.sizes, y.sizes), np.maximum.outer(x.sizes, y.sizes)
            off = _slack(small, large)
            open_ = (roots[0][:, None] != roots[1]) & ((small + off) * 100 >= (large - off) * percent)
            if x is y:
                open_ = np.triu(open_, 1)
            i, j = np.nonzero(open_)
            if not len(i):
                return
            on = (x.fine[i] == y.fine[j]).sum(1) >= FINE_AGREE
            i, j = i[on], j[on]
            if not len(i):
                return
            if len(i) <= 64:
                both = np.array([len(np.intersect1d(x.sets[a], y.sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)])
            else:
                (rows, i_at), (columns, j_at) = np.unique(i, return_inverse=True), np.unique(j, return_inverse=True)
                both = _shared([x.sets[a] for a in rows], [y.sets[b] for b in columns])[i_at, j_at].astype(np.int64)
            union = x.sizes[i] + y.sizes[j] - both
            off = off[i, j]
            near, sure = (both + off) * 100 >= (union - off) * percent, (both - off) * 100 >= (union + off) * percent
            for k in np.flatnonzero(near).tolist():
                a, b = root(int(x.parts[i[k]])), root(int(y.parts[j[k]]))
                if a != b:
                    links.append((int(x.ids[i[k]]), int(y.ids[j[k]])))
                    if sure[k]:
                        parent[max(a, b)] = min(a, b)

        cell, held = None, []
        for pdf in batches:
            if not len(pdf):
                continue
            places = pdf[["region", "low", "high", "side"]].to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero((places[1:] != places[:-1]).any(1)) + 1, [len(pdf)]))
            links: list[tuple[int, int]] = []
            for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                now, side = tuple(places[begin, :3].tolist()), places[begin, 3]
                if now != cell:
                    cell, held = now, []
                for at in range(begin, end, PIECE):
                    piece = _Piece(pdf.iloc[at : min(at + PIECE, end)])
                    if side == 0:
                        held.append(piece)
                    if side == 1 or cell[1] == cell[2]:
                        for other in held:
                            compare(other, piece, links)
            yield pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return cross


def _cells(crowded: DataFrame) -> DataFrame:
    """The rows of crowded regions once per cell (low, high, side) that they meet others in.

    The members of a region's largest component, which are not compared with each other, form blocks after those of the
    other members; a cell is a block of the latter against a block not before it. So a member of the largest component
    is in as many cells as the others have blocks.
    """
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    few = F.col("component") != F.col("largest")
    sized = crowded.withColumn("p", blocks(F.col("n") - F.col("most"))).withColumn("q", blocks(F.col("most")))
    own = F.when(few, F.pmod(F.xxhash64("id"), F.col("p"))).otherwise(F.col("p") + F.pmod(F.xxhash64("id"), F.col("q"))).cast("int")
    met = F.explode(F.sequence(F.lit(0), F.when(few, F.col("p") + F.col("q")).otherwise(F.col("p")) - 1))
    dealt = sized.withColumn("own", own).withColumn("met", met)
    low, high = F.least("own", "met").cast("long"), F.greatest("own", "met").cast("long")
    return dealt.select("region", low.alias("low"), high.alias("high"), (F.col("own") != low).cast("long").alias("side"), "fine", "members", "id", "component")


def _across(rows: DataFrame, tasks: int, percent: int) -> DataFrame:
    """Likely links (a, b) of all pairs of rows that are in a region together and in different components.

    rows: region, its n members, the largest component and its members (largest, most); id, component, fine, members.
    """
    plain = rows.where(F.col("n") <= CROWD).select("region", "fine", "members", "id", "component")
    near = plain.repartition(tasks, "region").sortWithinPartitions("region", "id").mapInPandas(_meet(percent), "a long, b long")
    cells = _cells(rows.where(F.col("n") > CROWD)).repartition(tasks, "region", "low", "high").sortWithinPartitions("region", "low", "high", "side")
    return near.unionByName(cells.mapInPandas(_cross(percent), "a long, b long"))


def _with_signs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    signs = classes.select("id", "signature")
    both = pairs.join(signs.withColumnsRenamed({"id": "a", "signature": "sa"}), "a").join(signs.withColumnsRenamed({"id": "b", "signature": "sb"}), "b")
    return both.mapInPandas(_score, "a long, b long, agree int").where(F.col("agree") >= AGREE)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    both = F.size(F.array_intersect("ma", "mb")).cast("long")
    union = F.size("ma") + F.size("mb") - both
    return (
        pairs.select("a", "b")
        .join(sets.select(F.col("id").alias("a"), F.col("members").alias("ma")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("members").alias("mb")), "b")
        .where(both * 100 >= union * percent)
        .select("a", "b")
        .distinct()
    )


def _filtered(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """texts without most rows that ids lacks, before any shuffle: a Bloom filter of one hash in FILTER_BITS bits.

    The filter is a table of at most FILTER_BITS / 32768 rows of 4 kB, whatever the number of ids, and so may be broadcast.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    bits = ids.select(place("id").alias("p")).groupBy(F.expr("cast(p div 32768 as int)").alias("bucket")).agg(F.bitmap_construct_agg(F.col("p") % 32768).alias("bits"))
    placed = texts.withColumn("p", place("doc_id")).withColumn("bucket", F.expr("cast(p div 32768 as int)")).join(F.broadcast(bits), "bucket")
    byte = F.conv(F.hex(F.substring("bits", F.expr("cast((p % 32768) div 8 as int) + 1"), F.lit(1))), 16, 10).cast("int")
    return placed.where((byte.bitwiseAND(F.expr("cast(shiftleft(1, cast(p % 8 as int)) as int)")) != 0)).drop("p", "bucket", "bits")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs (columns doc_id and text; others are ignored).

    Texts are linked if their sets of five-word shingles have a Jaccard similarity of percent / 100 or more; a
    component's id is its smallest doc_id, whose rows are kept. An empty or null text has an empty set and is linked
    with nothing. A row without a doc_id can't be named by others: it is linked with nothing, its component_id is null
    and it is kept. Rows that repeat a doc_id are one node that has all their texts; each of them is returned. Equal sets
    meet by a 128-bit digest, so a group of exact copies of any size costs one row. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    all_docs = written(described(docs), "described")
    whole = all_docs.where("n_shingles > 0 and doc_id is not null")
    by_set = whole.groupBy("n_shingles", "low", "high").agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature"))
    classes = written(by_set, "classes")
    candidates, members, forest = _forest(classes, tasks)
    scored = written(_with_signs(candidates, classes), "candidates")
    members = written(members, "members")

    needed = written(scored.select(F.col("a").alias("id")).unionByName(scored.select(F.col("b").alias("id"))).unionByName(members.select("id")).distinct(), "needed")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    sets = written(_filtered(texts, needed).join(needed.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).mapInPandas(_sets, "id long, members array<long>, packed binary, fine binary"), "sets")

    # A doc_id whose rows have different sets joins their classes without a comparison.
    ids = whole.select("n_shingles", "low", "high", "doc_id").distinct()
    several = ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    given = ids.join(several, "doc_id").join(classes, ["n_shingles", "low", "high"]).select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    # First each text with its likeliest smaller neighbour, then only what still lies in different components.
    likeliest = scored.groupBy("b").agg(F.max_by("a", F.struct("agree", -F.col("a"))).alias("a"))
    links = written(_confirmed(likeliest, sets, percent), "links")
    parts = written(components(links), "parts")

    def labelled(df: DataFrame, column: str) -> DataFrame:
        named = parts.select(F.col("node").alias(column), F.col("component").alias(f"c{column}"))
        return df.join(named, column, "left").withColumn(f"c{column}", F.coalesce(f"c{column}", column))

    open_pairs = labelled(labelled(scored.select("a", "b"), "a"), "b").where("ca != cb").select("a", "b")
    parted = members.withColumnRenamed("id", "a")
    parted = labelled(parted, "a").select("region", F.col("a").alias("id"), F.col("ca").alias("component"))
    sizes = parted.groupBy("region", "component").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("region").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("component", F.struct("n", "component")).alias("largest")).where("parts > 1")
    mixed = written(mixed, "regions")  # a table of its own, so that the join with it can be split where a region is hot
    mixed_rows = parted.join(mixed.select("region", "n", "most", "largest"), "region").join(sets.select("id", "fine", F.col("packed").alias("members")), "id")
    meeting = written(mixed_rows, "mixed")
    across = written(open_pairs.unionByName(_across(meeting, tasks, percent)).distinct(), "across")
    more = _confirmed(across, sets, percent)
    final = written(components(links.unionByName(more).unionByName(given)), "components")
    for done in (forest, scored, members, needed, sets, links, parts, mixed, meeting, across):
        drop_written(done)

    out = all_docs.select("doc_id", "n_shingles", "low", "high")
    # Equal sets meet in their class, then classes in their component; both tables have one row per key.
    own = classes.select("n_shingles", "low", "high", "id").join(final.select(F.col("node").alias("id"), "component"), "id", "left").select("n_shingles", "low", "high", F.coalesce("component", "id").alias("component"))
    empty = out.where("n_shingles = 0 or doc_id is null").withColumn("component_id", F.col("doc_id"))
    rest = out.where("n_shingles > 0 and doc_id is not null").join(own, ["n_shingles", "low", "high"]).withColumn("component_id", F.col("component"))
    result = rest.select("doc_id", "n_shingles", "component_id").unionByName(empty.select("doc_id", "n_shingles", "component_id"))
    return result.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op4_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, counted exactly, and what is reachable from each document.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4])) END AS g FROM w
), s AS (SELECT doc_id, unnest(g) AS g FROM g),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL)
  JOIN g p ON p.doc_id = a JOIN g q ON q.doc_id = b WHERE 100 * n >= 75 * (len(p.g) + len(q.g) - n)
), r(a, b) AS (
  SELECT a, b FROM (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) UNION SELECT r.a, l.b FROM r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON l.a = r.b
), c AS (SELECT a AS doc_id, min(b) AS low FROM r GROUP BY a)
SELECT doc_id, len(g)::BIGINT AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, doc_id <= coalesce(low, doc_id) AS kept FROM g LEFT JOIN c USING (doc_id)
"""
