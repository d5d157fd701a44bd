"""Benchmark decontamination by normalised word windows.

The windows of the benchmark's items (WINDOW words, or a shorter item whole) form a hash set that is broadcast if the items
are few enough; one pass over the texts looks every window up and compares the words of each hit with the item's. A larger
benchmark stays distributed: its windows' filter of fixed size is broadcast instead, and what passes it is joined with the
windows. Hits become spans of words, which are cut from the texts or cost the document its place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm import _text
from tallyloom.llm._common import table, written
from tallyloom.llm._text import U, mix

#: Words of a window.
WINDOW = 10
#: Words and bytes of all items up to which their windows are broadcast: some 80 MB.
MOST_WORDS, MOST_BYTES = 1_000_000, 32 << 20
#: Bits of the filter of a larger benchmark: 32 MB, whatever its size.
FILTER_BITS = 1 << 28

# Words are runs of a-z, 0-9 and bytes of other than ASCII characters; all else parts them.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SPANS = "array<struct<first:long,last:long>>"
_FOUND = f"n_words long, spans {_SPANS}, items array<string>"


def _encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL)


def _pieces(data: bytes) -> Iterator[tuple[int, bytes]]:
    """A normalised text in pieces of about _text.PIECE bytes, cut between words; a longer word is a piece of its own."""
    at = 0
    while at < len(data):
        end = at + _text.PIECE
        if end < len(data):
            cut = data.rfind(b" ", at, end)
            if cut < 0:
                cut = data.find(b" ", end)
            end = len(data) if cut < 0 else cut + 1
        yield at, data[at:end]
        at = end


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and length of each word of a piece."""
    if len(data) > _text.PIECE:  # one word
        at = len(data) - len(data.lstrip(b" "))
        return _text._hash_long(data), np.array([at]), np.array([len(data.strip(b" "))])
    sums, lengths, starts = _text._word_sums(data)
    return _text._finished(sums, lengths), starts, lengths.astype(np.int64)


def _windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of every n words in a row."""
    steps = mix(np.arange(1, n + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)
    total = np.full(max(len(hashes) - n + 1, 0), n, np.uint64)
    for k in range(n):
        total += hashes[k : k + len(total)] * steps[k]
    return mix(total)


@dataclass
class _Set:
    """The windows of a bounded benchmark: a sorted run of hashes for each number of words, and where each one stands."""

    ids: list[str]
    words: list[list[bytes]]
    runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # n: mask over the top bits, hash, item, first word

    @staticmethod
    def of(items: list[tuple[str, bytes]], window: int) -> _Set:
        ids, words = [i for i, _ in items], [data.split() for _, data in items]
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for at, (_, data) in enumerate(items):
            hashes = np.concatenate([_words(piece)[0] for _, piece in _pieces(data)] or [np.zeros(0, np.uint64)])
            n = min(window, len(hashes))
            if n:
                own = _windows(hashes, n)
                found.setdefault(n, []).append((own, np.full(len(own), at), np.arange(len(own))))
        runs = {}
        for n, parts in found.items():
            hashes, item, first = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(hashes, kind="stable")
            bits = max(16, int(len(hashes) * 16).bit_length())
            mask = np.zeros(1 << bits, bool)
            mask[hashes >> U(64 - bits)] = True
            runs[n] = mask, hashes[order], item[order].astype(np.int32), first[order].astype(np.int32)
        return _Set(ids, words, runs)

    def hits(self, hashes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(position, n, first and last entry) of every window of a row of word hashes whose hash the set has."""
        for n, (mask, known, _, _) in self.runs.items():
            own = _windows(hashes, n)
            at = np.flatnonzero(mask[own >> U(64 - (len(mask).bit_length() - 1))])
            low, high = np.searchsorted(known, own[at], "left"), np.searchsorted(known, own[at], "right")
            for p, a, b in zip(at.tolist(), low.tolist(), high.tolist(), strict=True):
                if a < b:
                    yield p, n, a, b


class _Text:
    """What is found in one text: its words, its items and the stretches of words that windows hit."""

    def __init__(self) -> None:
        self.n, self.hits, self.items = 0, [], set()

    def add(self, first: int, past: int) -> None:
        """A window; one that overlaps the stretch before lengthens it, so a copied passage takes one entry."""
        if self.hits and self.hits[-1][0] <= first <= self.hits[-1][1]:
            self.hits[-1][1] = max(self.hits[-1][1], past)
        else:
            self.hits.append([first, past])

    def spans(self) -> list[tuple[int, int]]:
        out: list[list[int]] = []
        for first, last in sorted(self.hits):
            if out and first <= out[-1][1]:
                out[-1][1] = max(out[-1][1], last)
            else:
                out.append([first, last])
        return [(a, b - 1) for a, b in out]


def _texts(texts: list[str | None], window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes, np.ndarray]]:
    """Stretches of words: text and place of each, hash, first byte, buffer and length.

    Short texts share a buffer; of a long one each stretch begins with the last window - 1 words of the one before.
    """
    waiting: list[tuple[int, bytes]] = []

    def flush():
        if waiting:
            buffer = b" ".join(x for _, x in waiting)
            hashes, starts, lengths = _words(buffer)
            ends = np.cumsum([len(x) + 1 for _, x in waiting])
            cuts = np.concatenate(([0], np.searchsorted(starts, ends)))
            counts = np.diff(cuts)
            place = np.arange(len(starts)) - np.repeat(cuts[:-1], counts)
            yield np.repeat([i for i, _ in waiting], counts), place, hashes, starts, buffer, lengths
            waiting.clear()

    size = 0
    for i, text in enumerate(texts):
        data = _encoded(text)
        if len(data) > _text.PIECE:
            yield from flush()
            size, known = 0, 0
            tail = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
            for at, piece in _pieces(data):
                hashes, starts, lengths = _words(piece)
                own = tuple(np.concatenate(x) for x in zip(tail, (hashes, starts + at, lengths), strict=True))
                yield np.full(len(own[0]), i), np.arange(len(own[0])) + known - len(tail[0]), own[0], own[1], data, own[2]
                known += len(hashes)
                keep = min(window - 1, len(own[0]))
                tail = tuple(x[len(x) - keep :] for x in own)
            continue
        if size + len(data) > _text.PIECE:
            yield from flush()
            size = 0
        waiting.append((i, data))
        size += len(data) + 1
    yield from flush()


def _scan(shared, window: int):
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        """Words, spans and items of each text, by the broadcast set; every hit is compared word by word."""
        known: _Set = shared.value
        for texts in batches:
            found = [_Text() for _ in range(len(texts))]
            for text, place, hashes, starts, buffer, lengths in _texts(list(texts), window):
                for i, last in zip(*_last_places(text, place), strict=True):
                    found[i].n = max(found[i].n, last + 1)
                for p, n, low, high in known.hits(hashes):
                    if text[p] != text[p + n - 1]:
                        continue
                    own = buffer[starts[p] : starts[p + n - 1] + lengths[p + n - 1]].split()
                    _, _, item, first = known.runs[n]
                    for e in range(low, high):
                        k, at = int(item[e]), int(first[e])
                        if known.words[k][at : at + n] == own:
                            one = found[int(text[p])]
                            one.items.add(known.ids[k])
                            one.add(int(place[p]), int(place[p]) + n)
            yield pd.DataFrame({"n_words": [x.n for x in found], "spans": [[{"first": a, "last": b} for a, b in x.spans()] for x in found], "items": [sorted(x.items) for x in found]})

    return scan


def _last_places(text: np.ndarray, place: np.ndarray) -> tuple[list[int], list[int]]:
    """The texts of a stretch with the place of the last word of each."""
    if not len(text):
        return [], []
    last = np.append(np.flatnonzero(text[1:] != text[:-1]), len(text) - 1)
    return text[last].tolist(), place[last].tolist()


def _item_windows(window: int):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The windows of each item: hash, number of words, words and item."""
        for pdf in batches:
            for item, text in zip(pdf["item"], pdf["text"], strict=True):
                words = _encoded(text).split()
                n = min(window, len(words))
                hashes = np.concatenate([_words(piece)[0] for _, piece in _pieces(b" ".join(words))] or [np.zeros(0, np.uint64)])
                for at in range(0, len(words) - n + 1 if n else 0, 10_000):
                    own = _windows(hashes[at : at + 10_000 + n - 1], n).astype(np.int64)
                    grams = [b" ".join(words[at + j : at + j + n]).decode("utf-8", "surrogatepass") for j in range(len(own))]
                    yield pd.DataFrame({"h": own, "n": n, "gram": pd.Series(grams, dtype=object), "item": pd.Series([item] * len(own), dtype=object)})

    return cut


def _passing(bits, sizes: list[int], window: int):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each text's number of words (n 0), and its windows that pass the filter, with their words."""
        mask = bits.value
        for pdf in batches:
            keys = pdf[["k", "l"]].to_numpy()
            counts = np.zeros(len(pdf), np.int64)
            for text, place, hashes, starts, buffer, lengths in _texts(list(pdf["text"]), window):
                for i, last in zip(*_last_places(text, place), strict=True):
                    counts[i] = max(counts[i], last + 1)
                for n in sizes:
                    own = _windows(hashes, n)
                    spot = own % U(len(mask) * 8)
                    at = np.flatnonzero((mask[spot >> U(3)] >> (spot & U(7)).astype(np.uint8)) & 1)
                    at = at[text[at] == text[at + n - 1]]
                    grams = [b" ".join(buffer[starts[p] : starts[p + n - 1] + lengths[p + n - 1]].split()).decode("utf-8", "surrogatepass") for p in at.tolist()]
                    yield pd.DataFrame({"k": keys[text[at], 0], "l": keys[text[at], 1], "h": own[at].astype(np.int64), "n": n, "gram": pd.Series(grams, dtype=object), "first": place[at]})
            yield pd.DataFrame({"k": keys[:, 0], "l": keys[:, 1], "h": 0, "n": 0, "gram": pd.Series([""] * len(pdf), dtype=object), "first": counts})

    return scan


def _joined(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """hits() by a join: docs with k and l; windows are dealt by their hash, the hits of a text by its key."""
    spark = docs.sparkSession
    windows = written(items.mapInPandas(_item_windows(window), "h long, n int, gram string, item string").distinct(), "windows")
    sizes = sorted(r["n"] for r in windows.select("n").distinct().collect())  # at most `window` numbers
    spot = F.pmod(F.col("h"), F.lit(FILTER_BITS))  # FILTER_BITS divides 2^64, so signs don't matter
    parts = windows.select(spot.alias("p")).groupBy(F.expr("cast(p div 32768 as int)").alias("bucket")).agg(F.bitmap_construct_agg(F.col("p") % 32768).alias("bits"))
    mask = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts.toLocalIterator():  # at most FILTER_BITS / 32768 rows of 4 kB
        mask[r["bucket"] * 4096 : r["bucket"] * 4096 + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    bits = spark.sparkContext.broadcast(mask)
    found = written(docs.select("k", "l", "text").mapInPandas(_passing(bits, sizes, window), "k long, l long, h long, n int, gram string, first long"), "passing")
    hits = found.where("n > 0").join(windows, ["h", "n", "gram"]).select("k", "l", "first", (F.col("first") + F.col("n")).alias("past"), "item")
    order = Window.partitionBy("k", "l").orderBy("first", "past")
    spots = hits.groupBy("k", "l", "first", "past").agg(F.collect_set("item").alias("items"))
    reach = F.max("past").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spots.withColumn("fresh", F.coalesce(F.col("first") > reach, F.lit(True)).cast("int"))
    marked = marked.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = marked.groupBy("k", "l", "island").agg(F.struct(F.min("first").alias("first"), (F.max("past") - 1).alias("last")).alias("span"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    spans = spans.groupBy("k", "l").agg(F.sort_array(F.collect_list("span")).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    words = found.where("n = 0").groupBy("k", "l").agg(F.max("first").alias("n_words"))
    none = F.expr(f"cast(array() as {_SPANS})")
    return words.join(spans, ["k", "l"], "left").select("k", "l", F.struct("n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items")).alias("found"))


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with a column `found`: n_words, spans (first and last word of each run of hit words) and items (ids as strings).

    docs and items have a text, items an item_id. Items without an id or without words have no windows; null or empty texts
    have no words and no hits; rows that repeat an id are rows of their own, items that repeat one are one item of several
    texts. A column `found` of docs is replaced. An empty table on either side gives no hits. Whole texts are scanned, in
    stretches of bounded size.
    """
    spark = docs.sparkSession
    named = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    # An upper bound of the words: a word is at least one character and all but the last are followed by another.
    size = named.agg(F.coalesce(F.sum(F.length("text") / 2 + 1), F.lit(0)).alias("words"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    if size["words"] <= MOST_WORDS and size["bytes"] <= MOST_BYTES:
        rows = sorted((r["item"], _encoded(r["text"])) for r in named.collect())
        shared = spark.sparkContext.broadcast(_Set.of(rows, window))
        scan = F.pandas_udf(_scan(shared, window), _FOUND).asNondeterministic()  # so that a plan runs it once
        return docs.drop("found").withColumn("found", scan(F.col("text").cast("string")))
    text = F.col("text").cast("string")
    # Rows are known by two hashes of their text; equal texts have one result.
    k, l = (next(x for x in (f"_{name}{i}" for i in range(len(docs.columns) + 1)) if x not in docs.columns) for name in ("k", "l"))  # noqa: E741
    keyed = docs.withColumn(k, F.xxhash64(text)).withColumn(l, F.xxhash64(F.lit(1), text))
    found = _joined(keyed.select(F.col(k).alias("k"), F.col(l).alias("l"), text.alias("text")), named, window)
    joined = keyed.drop("found").join(found.select(F.col("k").alias(k), F.col("l").alias(l), "found"), [k, l])
    return joined.select(*(c for c in docs.columns if c != "found"), "found")


def n_hit(found: Column) -> Column:
    return F.aggregate(found["spans"], F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)


def _cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The texts without the bytes from each span's first word to the end of its last."""
    for texts, spans in batches:
        out = []
        for text, own in zip(texts, spans, strict=True):
            if text is None or own is None or not len(own):
                out.append(text)
                continue
            raw = text.encode("utf-8", "surrogatepass")
            places = [(at + s, n) for at, piece in _pieces(raw.translate(_NORMAL)) for _, s, n in (_words(piece),)]
            starts, lengths = np.concatenate([s for s, _ in places]), np.concatenate([n for _, n in places])
            kept, at = [], 0
            for span in own:
                kept.append(raw[at : starts[span["first"]]])
                at = int(starts[span["last"]] + lengths[span["last"]])
            out.append(b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass"))
        yield pd.Series(out)


def decontaminate(docs: DataFrame, items: DataFrame, remove: str = "spans", most_share: float = 0.0, window: int = WINDOW) -> DataFrame:
    """docs cleaned of the benchmark: with remove "spans" every row, hit words cut from its text with what stands between
    them; with "documents" only the rows whose share of hit words is at most most_share, texts untouched. Null, empty and
    repeated rows as in hits(); rows without words stay."""
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove is {remove!r}, not spans or documents")
    rows = hits(docs, items, window)
    if remove == "documents":
        return rows.where(n_hit(F.col("found")) <= most_share * F.col("found.n_words")).drop("found")
    cut = F.pandas_udf(_cut, "string").asNondeterministic()
    return rows.withColumn("text", cut(F.col("text").cast("string"), F.col("found.spans"))).drop("found")


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).select("doc_id", "found")
    n = n_hit(F.col("found"))
    listed = F.sha2(F.array_join("found.items", ",").cast("binary"), 256)
    return rows.select("doc_id", F.col("found.n_words").alias("n_words"), n.alias("n_hit"), F.size("found.items").cast("long").alias("n_items"), listed.alias("items_sha256"), (n > 0).alias("contaminated"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
w AS (
  SELECT r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d
), i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), g AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM i WHERE len(w) > 0),
t AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS gram FROM g),
s AS (SELECT DISTINCT n FROM t),
x AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM w, s WHERE len(w) >= n),
h AS (SELECT r, p, x.n, item_id FROM x JOIN t ON x.n = t.n AND array_to_string(w[p:p + x.n - 1], ' ') = gram),
c AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT r, p, n FROM h)) GROUP BY r),
l AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (r) LEFT JOIN l USING (r)
"""
