"""ER-02/03: the most similar of many names for each of many texts, exactly, by bounds on the ratio of matching blocks.

The ratio of two strings is twice their matched letters over the sum of their lengths. Matched letters are at most the
shorter length, the letters in common however they stand, and the longest common subsequence; so a pair whose bound lies
below what counts is never measured. Texts meet names of lengths that can match, in cells of blocks; a cell's names are
indexed by their letters, and only those that share enough of a text's letters are looked at one by one.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.sources.scratch import written

#: Names and texts of a block; classes of lengths per doubling.
BLOCK_NAMES, BLOCK_TEXTS, CLASSES = 16_384, 4_096, 4
#: Letters are counted in so many places by their code points; letters that share a place only loosen the bound.
_PLACES = 64


def _class(length: Column) -> Column:
    return F.floor(F.log2(length) * CLASSES).cast("int")


def _codes(strings: list[str]) -> np.ndarray:
    """The code points of strings, one row each, 0 after the end."""
    wide = np.array(strings, dtype=f"<U{max(1, max(map(len, strings), default=1))}")
    return wide.view(np.uint32).reshape(len(strings), -1)


def _counts(codes: np.ndarray) -> np.ndarray:
    """How often each row has letters of each place."""
    out = np.zeros((len(codes), _PLACES), np.uint16)
    rows = np.arange(len(codes))
    for column in codes.T:
        on = column > 0
        np.add.at(out, (rows[on], column[on] % _PLACES), 1)
    return out


class Names:
    """A block of names (name, id), indexed by their letters: for each place how often every name has it."""

    def __init__(self, names: list[str], ids: list):
        self.names, self.ids = names, ids
        codes = _codes(names)
        self.letters = np.ascontiguousarray(_counts(codes).T)
        self.lengths = np.array([len(x) for x in names], np.int64)
        self.known, dense = np.unique(codes, return_inverse=True)
        self.dense = dense.reshape(len(names), -1)

    def _shared(self, text: str, least: float) -> tuple[np.ndarray, np.ndarray]:
        """The names whose letters in common with the text allow a ratio of `least`, with that bound."""
        shared = np.zeros(len(self.names), np.uint16)
        own = _counts(_codes([text]))[0]
        for place in np.flatnonzero(own).tolist():  # the text's letters alone: all others share nothing
            shared += np.minimum(self.letters[place], own[place])
        bound = 2 * shared / (len(text) + self.lengths)
        at = np.flatnonzero(bound >= least)
        return at, bound[at]

    def _subsequence(self, text: str, at: np.ndarray) -> np.ndarray:
        """The bound by the longest common subsequence with some names, 64 letters of the text as the bits of a word."""
        masks = np.zeros(len(self.known), np.uint64)
        for i, c in enumerate(text):
            k = np.searchsorted(self.known, ord(c))
            if k < len(self.known) and self.known[k] == ord(c):
                masks[k] |= np.uint64(1) << np.uint64(i)
        v = np.full(len(at), ~np.uint64(0))
        for column in self.dense[at].T:
            m = masks[column]
            v = (v + (v & m)) | (v & ~m)
        inside = np.uint64((1 << len(text)) - 1)
        return 2 * np.bitwise_count(~v & inside).astype(np.int64) / (len(text) + self.lengths[at])

    def best_two(self, text: str, least: float) -> tuple[list[tuple[object, float]], int]:
        """The two most similar ids with their ratios from `least` on, and how many names were measured."""
        n = len(text)
        at, bound = self._shared(text, least - 1e-9)
        if n <= 64 and len(at):
            bound = np.minimum(bound, self._subsequence(text, at))
            on = bound >= least - 1e-9
            at, bound = at[on], bound[on]
        found: dict = {}
        second, measured = least, 0
        for k in np.argsort(-bound, kind="stable").tolist():
            if bound[k] < second - 1e-9:
                break
            name, own = self.names[at[k]], self.ids[at[k]]
            # The ratio isn't symmetric: the text is the first of the two.
            ratio = SequenceMatcher(None, text, name).ratio()
            measured += 1
            if ratio >= least and ratio > found.get(own, -1.0):
                found[own] = ratio
                if len(found) > 1:
                    second = sorted(found.values())[-2]
        return sorted(found.items(), key=lambda x: (-x[1], str(x[0])))[:2], measured


def fuzzy_best(texts: DataFrame, names: DataFrame, cutoff: float, margin: float) -> DataFrame:
    """text, id, quality and reason of every distinct text of texts: the most similar name of names (name, id), if it has a
    ratio of `cutoff` and every other id's is by `margin` less; else id and quality are null and reason is `far` or `close`.

    An id may have several names. Null or empty texts and names match nothing. All pairs whose bounds allow a ratio of
    cutoff - margin are measured, so the result is that of measuring all pairs. Neither side passes through the driver.
    """
    least = cutoff - margin
    shorter = least / (2 - least)  # of two lengths that can match
    kind = names.schema["id"].dataType.simpleString()
    asked = written(texts.select("text").where(F.length("text") > 0).distinct(), "asked")
    named = names.select("name", "id").where(F.length("name") > 0).distinct()
    span = F.sequence(_class(F.ceil(F.length("text") * shorter - 1e-9)), _class(F.floor(F.length("text") / shorter + 1e-9)))
    spread = asked.withColumn("class", F.explode(span))
    named = named.withColumn("class", _class(F.length("name")))
    # A few classes each: their number grows with the logarithm of the longest name.
    per = lambda df: {r["class"]: r["count"] for r in df.groupBy("class").count().collect()}
    n_names, n_texts = per(named), per(spread)
    both = sorted(set(n_names) & set(n_texts))
    none = asked.select("text", F.lit(None).cast(kind).alias("id"), F.lit(None).cast("double").alias("quality"), F.lit("far").alias("reason"))
    if not both:
        return none
    blocks = lambda n, most: F.create_map(*(F.lit(x) for c in both for x in (c, -(-n[c] // most))))[F.col("class")]
    of_names, of_texts = blocks(n_names, BLOCK_NAMES), blocks(n_texts, BLOCK_TEXTS)
    place = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = spread.where(F.col("class").isin(both)).withColumn("tb", place("text", of_texts)).withColumn("nb", copies(of_names))
    right = named.where(F.col("class").isin(both)).withColumn("nb", place("name", of_names)).withColumn("tb", copies(of_texts))

    def cell(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(asked) and len(known):
            block = Names(known["name"].tolist(), known["id"].tolist())
            for text in asked["text"].tolist():
                rows += [(text, own, ratio, round(ratio, 3)) for own, ratio in block.best_two(text, least)[0]]
        out = pd.DataFrame(rows, columns=["text", "id", "ratio", "quality"])
        return out.astype({"text": object, "id": object, "ratio": "float64", "quality": "float64"})

    keys = ["class", "nb", "tb"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(cell, f"text string, id {kind}, ratio double, quality double")
    each = near.groupBy("text", "id").agg(F.max("ratio").alias("ratio"), F.max("quality").alias("quality"))
    # Two ids a cell at most: a text's list is as long as its cells are many.
    ranked = each.groupBy("text").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("ratio")).alias("far"), F.col("id").cast("string").alias("name"), "id", "quality"))), 1, 2).alias("top"))
    first, second = F.get("top", F.lit(0)), F.get("top", F.lit(1))
    reason = F.when(-first["far"] < cutoff, "far").when(second["far"] - first["far"] < margin, "close")
    judged = ranked.select("text", first["id"].alias("id"), first["quality"].alias("quality"), reason.alias("reason"))
    out = asked.join(judged, "text", "left")
    sure = F.col("quality").isNotNull() & F.col("reason").isNull()
    return out.select("text", F.when(sure, F.col("id")).alias("id"), F.when(sure, F.col("quality")).alias("quality"), F.when(~sure, F.coalesce("reason", F.lit("far"))).alias("reason"))
