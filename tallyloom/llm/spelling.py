"""Spelling variants of a corpus: words at an edit distance of one, by Levenshtein automata over trie shards.

The distinct words are sorted and cut into shards; each becomes a compact trie. The automaton of a word at distance one runs
depth-first through every shard: along the word's own path without an error, and off it wherever one insertion, deletion or
replacement still leads to a word of the shard. Counts and the best form are reduced over the shards. The shards are
broadcast if they are small enough in all; else blocks of words meet groups of shards in a grid.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm._common import drop_written, table, written

#: A run of letters; code points and occurrences of a word; by how much more frequent its form is.
LETTERS, LEAST_CHARS, LEAST_N, TIMES = r"[A-Za-zÀ-ÿ]", 6, 5, 5
#: One of so many occurrences, drawn by a hash, loses a letter.
SLIP = 199
#: Words of a shard; bytes of all shards up to which they are broadcast; words of a block of the grid beyond.
SHARD_WORDS, MOST_BYTES, BLOCK_WORDS = 65_536, 64 << 20, 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Trie:
    """Sorted words as arrays: the children of node k are the nodes first[k] to first[k + 1] - 1, ordered by their labels."""

    def __init__(self, labels: str, first: array, counts: array):
        self.labels, self.first, self.counts = labels, first, counts  # counts: of the word that ends in a node, else 0

    @staticmethod
    def of(words: list[str], counts: list[int]) -> Trie:
        """The trie of sorted distinct words and their counts (from 1 on)."""
        labels, first, ends = ["\0"], array("I"), array("q")
        level = [(0, len(words))]
        depth, nodes = 0, 1
        while level:
            below = []
            for low, high in level:
                own = len(words[low]) == depth if low < high else False
                ends.append(counts[low] if own else 0)
                first.append(nodes)
                at = low + own
                while at < high:
                    c, begin = words[at][depth], at
                    while at < high and words[at][depth] == c:
                        at += 1
                    labels.append(c)
                    below.append((begin, at))
                    nodes += 1
            level, depth = below, depth + 1
        first.append(nodes)
        return Trie("".join(labels), first, ends)

    def dump(self) -> tuple[bytes, bytes, bytes]:
        return self.labels.encode("utf-8", "surrogatepass"), self.first.tobytes(), self.counts.tobytes()

    @staticmethod
    def load(labels: bytes, first: bytes, counts: bytes) -> Trie:
        nodes, ends = array("I"), array("q")
        nodes.frombytes(first)
        ends.frombytes(counts)
        return Trie(labels.decode("utf-8", "surrogatepass"), nodes, ends)

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """The words of the trie at a distance of exactly one from `word`, each once, with their counts.

        Of edits that give the same word one is followed: in a run of equal letters the last is deleted, and a letter is
        inserted after a run of its own.
        """
        find, first, labels, counts = self.labels.find, self.first, self.labels, self.counts
        size, node = len(word), 0

        def end(node: int, i: int) -> int:
            """The node that the rest of the word from i on leads to without an error, or -1."""
            while i < size and node >= 0:
                node = find(word[i], first[node], first[node + 1])
                i += 1
            return node

        for i in range(size + 1):
            low, high = first[node], first[node + 1]
            c = word[i] if i < size else ""
            if c and word[i + 1 : i + 2] != c:
                at = end(node, i + 1)
                if at >= 0 and counts[at]:
                    yield word[:i] + word[i + 1 :], counts[at]
            for k in range(low, high):
                d = labels[k]
                if d == c:
                    continue
                if not c:
                    if counts[k]:
                        yield word + d, counts[k]
                    continue
                below, past = first[k], first[k + 1]
                if below < past:
                    at = find(c, below, past)  # d was inserted
                    if at >= 0 and (at := end(at, i + 1)) >= 0 and counts[at]:
                        yield word[:i] + d + word[i:], counts[at]
                    if i + 1 < size:
                        at = find(word[i + 1], below, past)  # d was put in the place of c
                        if at >= 0 and (at := end(at, i + 2)) >= 0 and counts[at]:
                            yield word[:i] + d + word[i + 1 :], counts[at]
                if i + 1 == size and counts[k]:
                    yield word[:i] + d, counts[k]
            node = find(c, low, high) if c else -1
            if node < 0:
                return


def _lowered(run: Column) -> Column:
    """A-Z lower-cased, other letters as they are; the fast function wherever all letters are ASCII."""
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, _UPPER, _LOWER))


def counted(docs: DataFrame, slip: int | None = SLIP, least_chars: int = LEAST_CHARS, least_n: int = LEAST_N) -> DataFrame:
    """word and n of the words of docs (doc_id, text) that have least_chars code points and occur least_n times.

    A word is a run of letters, A-Z lower-cased. With slip, an occurrence whose hash of id and word is divisible by slip
    loses the letter that the hash points at. Null texts have no words, a null id hashes as the empty one.
    """
    # Shorter runs can't become words: they are not extracted.
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"{LETTERS}{{{int(least_chars)},}}"), F.lit(0))
    rows = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.select("id", _lowered(F.col("run")).alias("word"))
    if slip:
        h = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
        at = (F.col("h") % F.length("word")).cast("int")
        shorter = F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2))
        rows = rows.withColumn("h", h).select(F.when(F.col("h") % slip == 0, shorter).otherwise(F.col("word")).alias("word")).where(F.length("word") >= least_chars)
    return rows.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def _plant(most: int):
    def plant(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The tries of one sorted partition, of `most` words each."""
        words, counts = [], []
        for pdf in batches:
            words += pdf["word"].tolist()
            counts += pdf["n"].tolist()
            while len(words) >= most:
                yield _row(words[:most], counts[:most])
                del words[:most], counts[:most]
        if words:
            yield _row(words, counts)

    def _row(words: list[str], counts: list[int]) -> pd.DataFrame:
        labels, first, ends = Trie.of(words, counts).dump()
        return pd.DataFrame({"labels": [labels], "first": [first], "counts": [ends], "bytes": [len(labels) + len(first) + len(ends)]})

    return plant


_NEAR = "word string, n long, n_near long, best_n long, best string"


def _near(words: list[str], counts: list[int], tries: list[Trie]) -> pd.DataFrame:
    """Of each word: how many words of the tries are near it, and the most frequent, ties to the smaller."""
    near, best_n, best = [], [], []
    for word in words:
        k, top, form = 0, 0, None
        for trie in tries:
            for other, n in trie.near(word):
                k += 1
                if n > top or n == top and other < form:
                    top, form = n, other
        near.append(k)
        best_n.append(top)
        best.append(form)
    return pd.DataFrame({"word": pd.Series(words, dtype=object), "n": counts, "n_near": near, "best_n": best_n, "best": pd.Series(best, dtype=object)})


def _neighbours(words: DataFrame, shards: DataFrame, total: int, bytes_: int, n_words: int, tasks: int) -> DataFrame:
    """_NEAR of every word over all shards."""
    spark = words.sparkSession
    if bytes_ <= MOST_BYTES:
        shared = spark.sparkContext.broadcast([tuple(map(bytes, r)) for r in shards.select("labels", "first", "counts").collect()])

        def all_shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tries = [Trie.load(*x) for x in shared.value]
            for pdf in batches:
                yield _near(pdf["word"].tolist(), pdf["n"].tolist(), tries)

        return words.repartition(max(tasks, -(-n_words // BLOCK_WORDS)), "word").mapInPandas(all_shards, _NEAR)
    groups, blocks = -(-2 * bytes_ // MOST_BYTES), -(-n_words // BLOCK_WORDS)
    left = words.withColumn("block", F.pmod(F.xxhash64("word"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    part = F.pmod(F.xxhash64("labels", "first"), F.lit(groups)).cast("int")
    right = shards.select("labels", "first", "counts", part.alias("part")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def cell(words: pd.DataFrame, shards: pd.DataFrame) -> pd.DataFrame:
        tries = [Trie.load(*map(bytes, x)) for x in shards[["labels", "first", "counts"]].itertuples(index=False, name=None)]
        return _near(words["word"].tolist(), words["n"].tolist(), tries)

    cells = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(cell, _NEAR)
    least = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))))
    reduced = cells.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), least.alias("b"))
    return reduced.select("word", "n", "n_near", F.coalesce(-F.col("b")["m"], F.lit(0)).alias("best_n"), F.col("b")["w"].alias("best"))


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near and form_n of words (word, n), distinct and of a count of 1 at least.

    form is the near word of the largest n (ties: the smallest) if that is at least `times` the word's, else null with
    form_n; root is where the forms end that begin with the word. Rows without a word or count are left out, a word that
    repeats counts as the sum. An empty table gives an empty result. A task holds the shards, or a block and a group of
    them. The words are written once; times must be 2 or more, so that forms have no circles.
    """
    if times < 2:
        raise ValueError("times must be 2 or more")
    spark = words.sparkSession
    clean = words.where("word is not null and n > 0").groupBy(F.col("word").cast("string").alias("word")).agg(F.sum("n").cast("long").alias("n"))
    clean = written(clean, "words")
    size = clean.agg(F.count("*").alias("words"), F.max("n").alias("most"), F.min("n").alias("least")).first()
    n_words = size["words"]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = clean.repartitionByRange(max(1, -(-n_words // SHARD_WORDS)), "word").sortWithinPartitions("word")
    shards = written(ordered.mapInPandas(_plant(SHARD_WORDS), "labels binary, first binary, counts binary, bytes long"), "shards")
    held = shards.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    near = _neighbours(clean, shards, held["n"], held["bytes"], n_words, tasks)
    formed = F.col("best_n") >= times * F.col("n")
    found = near.select("word", "n", "n_near", F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n"))
    found = written(found, "forms")
    drop_written(shards)
    drop_written(clean)
    # A chain of k forms multiplies the count by times^k; each round doubles the steps that are followed.
    chain, n = 0, size["least"] or 1
    while n * times <= (size["most"] or 0):
        chain, n = chain + 1, n * times
    roots = found.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(max(chain - 1, 0).bit_length()):
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        before, roots = roots, written(roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        drop_written(before)
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(counted(table(spark, sf_dir, "documents")))


def _crc_table() -> str:
    """The table of the CRC-32 of reversed bits, by its rule, as an SQL list."""
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        out.append(f"{x}::UBIGINT")
    return f"[{', '.join(out)}]"


ORACLE_SQL = rf"""
WITH RECURSIVE r AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{_UPPER}', '{_LOWER}') AS w FROM documents
), o AS (SELECT doc_id, w, count(*) AS n FROM r WHERE length(w) >= {LEAST_CHARS} GROUP BY doc_id, w),
b AS (SELECT w, n, [4294967295::UBIGINT] || list_transform(regexp_extract_all(hex(encode(doc_id || ':' || w)), '..'), lambda x: ('0x' || x)::UBIGINT) AS b FROM o),
h AS (SELECT w, n, xor(list_reduce(b, lambda c, x: xor(c >> 8, {_crc_table()}[((xor(c, x) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT AS h FROM b),
s AS (SELECT CASE WHEN h % {SLIP} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, n FROM h),
v AS (SELECT w, sum(n)::BIGINT AS n FROM s WHERE length(w) >= {LEAST_CHARS} GROUP BY w HAVING sum(n) >= {LEAST_N}),
d AS (SELECT w, n, length(w) AS size, p, substr(w, 1, p - 1) || substr(w, p + 1) AS less FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS p FROM v)),
-- Replaced at p: alike without it. Deleted: one word is the other without a letter.
e AS (
  SELECT x.w, y.w AS o, y.n FROM d x JOIN d y ON x.size = y.size AND x.p = y.p AND x.less = y.less AND x.w <> y.w
  UNION SELECT x.w, y.w, y.n FROM d x JOIN v y ON x.less = y.w
  UNION SELECT y.w, x.w, x.n FROM d x JOIN v y ON x.less = y.w
), f AS (
  SELECT v.w, v.n, count(e.o) AS n_near, max(e.n) AS form_n, arg_min(e.o, (-e.n, hex(encode(e.o)))) AS form FROM v LEFT JOIN e ON v.w = e.w GROUP BY v.w, v.n
), g AS (SELECT w, n, n_near, CASE WHEN form_n >= {TIMES} * n THEN form END AS form, CASE WHEN form_n >= {TIMES} * n THEN form_n END AS form_n FROM f),
c AS (
  SELECT w, w AS root, 0 AS steps FROM g
  UNION ALL SELECT c.w, g.form, steps + 1 FROM c JOIN g ON c.root = g.w WHERE g.form IS NOT NULL
), z AS (SELECT w, arg_max(root, steps) AS root FROM c GROUP BY w)
SELECT g.w AS word, form, root, n, n_near, form_n FROM g JOIN z ON g.w = z.w
"""
