"""ER-01 to ER-07: names in free text against a catalog, and scores whose every part is named."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.scalar import norm_text, normal_contains
from tallyloom.operators.fuzzy import fuzzy_best
from tallyloom.sources.scratch import written

# Similarity from which a name may match, by how much the next name must be worse, quality of each way.
FUZZY, MARGIN = 0.72, 0.08
EXACT, CODE, WORD_CODE, CONTAINED = 1.0, 0.97, 0.9, 0.93


def _unique(df: DataFrame, key: str) -> DataFrame:
    """Of entries that share a key the one of the largest id, as later ones replace earlier ones."""
    return df.where(F.length(key) > 0).groupBy(key).agg(F.max("id").alias("id"))


def _contained(texts: DataFrame, names: DataFrame) -> DataFrame:
    """text and the names (id) that it contains: both meet by the name's first three characters, then as a whole."""
    starts = names.withColumn("start", F.substring("name", 1, 3)).where(F.length("name") >= 3)
    short = names.where((F.length("name") > 0) & (F.length("name") < 3)).withColumn("start", F.col("name"))
    pieces = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text") - (n - 1))), lambda i: F.substring(F.col("text"), i, F.lit(n)))
    grams = texts.select("text", F.explode(F.array_distinct(F.concat(pieces(1), pieces(2), pieces(3)))).alias("start"))
    return grams.join(starts.unionByName(short), "start").where(F.contains("text", F.col("name"))).select("text", "id").distinct()


def match_names(rows: DataFrame, text: str, catalog: DataFrame, least_chars: int = 2, codes: bool = True, contained: bool = False, fuzzy: bool = True) -> DataFrame:
    """rows with id, quality, method (exact, code, contains, fuzzy, none) and reason of the catalog entry that `text` names.

    catalog has id, name and, with codes, code; both sides are normalised (upper case, A-Z and 0-9). The first way that
    finds an entry counts: the whole name; the whole text as a code, then its first word that is one; the one name that
    the text contains (several: none, `ambiguous`); the most similar name by a margin. Shorter texts are `short`; an empty
    catalog is `empty`. Every step but the last is an equi-join on distinct texts; the last is fuzzy_best().
    """
    normal = rows.withColumn("_text", norm_text(F.col(text)))
    # Every step reads the distinct texts and the catalog: both are written once.
    texts = written(normal.select(F.col("_text").alias("text")).where(F.length("_text") >= least_chars).distinct(), "texts")
    named = written(catalog.select("id", norm_text(F.col("name")).alias("name"), *([norm_text(F.col("code")).alias("code")] if codes else [])), "catalog")
    names = _unique(named, "name")
    steps = [texts.join(names.withColumnRenamed("name", "text"), "text").select("text", "id", F.lit(EXACT).alias("quality"), F.lit("exact").alias("method"), F.lit(1).alias("place"), F.lit(None).cast("string").alias("reason"))]
    if codes:
        code = _unique(named, "code")
        steps.append(texts.join(code.withColumnRenamed("code", "text"), "text").select("text", "id", F.lit(CODE), F.lit("code"), F.lit(2), F.lit(None).cast("string")))
        words = texts.select("text", F.posexplode(F.split("text", " ")).alias("at", "word")).where(F.length("word") >= 2)
        first = words.join(code.withColumnRenamed("code", "word"), "word").groupBy("text").agg(F.min_by("id", "at").alias("id"))
        steps.append(first.select("text", "id", F.lit(WORD_CODE), F.lit("code"), F.lit(3), F.lit("word")))
    if contained:
        inside = _contained(texts, names).groupBy("text").agg(F.min("id").alias("id"), F.count("*").alias("n"))
        steps.append(inside.select("text", F.when(F.col("n") == 1, F.col("id")).alias("id"), F.when(F.col("n") == 1, CONTAINED), F.when(F.col("n") == 1, "contains").otherwise("none"), F.lit(4), F.when(F.col("n") > 1, "ambiguous")))
    found = reduce(DataFrame.union, steps)
    if fuzzy:
        found = written(found, "found")
        rest = texts.join(found.select("text").distinct(), "text", "left_anti")
        near = fuzzy_best(rest, names, FUZZY, MARGIN)
        found = found.union(near.select("text", "id", "quality", F.when(F.col("id").isNotNull(), "fuzzy").otherwise("none"), F.lit(5), "reason"))
    best = found.groupBy("text").agg(F.min_by(F.struct("id", "quality", "method", "reason"), "place").alias("m"))
    empty = names.limit(1).count() == 0
    out = normal.join(best.withColumnRenamed("text", "_text"), "_text", "left")
    reason = F.when(F.coalesce(F.length("_text"), F.lit(0)) < least_chars, "short").otherwise(F.lit("empty") if empty else F.coalesce(F.col("m.reason"), F.when(F.col("m").isNull(), "far")))
    return out.select(*rows.columns, F.col("m.id").alias("id"), F.coalesce("m.quality", F.lit(0.0)).alias("quality"), F.coalesce("m.method", F.lit("none")).alias("method"), reason.alias("reason"))


def additive_score(rules: list[tuple[str, Column, int]]) -> tuple[Column, Column]:
    """ER-07: (score, reasons): the sum of the weights of the rules that hold, and each as `+w name`, in their order."""
    score = reduce(Column.__add__, (F.when(holds, w).otherwise(0) for _, holds, w in rules), F.lit(0))
    return score, F.array_compact(F.array(*(F.when(holds, f"{w:+d} {name}") for name, holds, w in rules)))


#: Weights of the signals that a video shows a match, their limits in hours and seconds, and the bands.
SIGNALS = {
    "official": 40, "unofficial": -30, "team a": 15, "team b": 15, "competition": 15, "title": 10, "region": 10, "language": 5,
    "room": 10, "time close": 20, "same day": 8, "time conflict": -25, "both live": 15, "long enough": 5, "too short": -15,
}
CLOSE_HOURS, DAY_HOURS, CONFLICT_HOURS, LEAST_SECONDS = 0.5, 12, 48, 1200
HIGH_SCORE, MEDIUM_SCORE = 70, 35


def broadcast_rules(text: Column, title: tuple[str, ...], hours: Column, c: dict[str, Column]) -> list[tuple[str, Column, int]]:
    """The rules of a video against a match: text is its title and description as `norm_text` gives them, a column of the
    rows and no expression, as every rule on names reads it; c has official, team_a, team_b, competition, same_region,
    same_language, room, both_live and seconds; hours lie between both starts (null: unknown)."""
    has = lambda name: normal_contains(text, c[name])
    on = {
        "official": F.coalesce(c["official"], F.lit(False)),
        "unofficial": ~F.coalesce(c["official"], F.lit(False)),
        "team a": has("team_a"),
        "team b": has("team_b"),
        "competition": has("competition"),
        "title": reduce(Column.__or__, (normal_contains(text, F.lit(x)) for x in title)),
        "region": c["same_region"],
        "language": c["same_language"],
        "room": has("room"),
        "time close": hours <= CLOSE_HOURS,
        "same day": (hours > CLOSE_HOURS) & (hours <= DAY_HOURS),
        "time conflict": hours > CONFLICT_HOURS,
        "both live": c["both_live"],
        "long enough": c["seconds"] >= LEAST_SECONDS,
        "too short": c["seconds"] < LEAST_SECONDS,
    }
    return [(name, on[name], weight) for name, weight in SIGNALS.items()]
