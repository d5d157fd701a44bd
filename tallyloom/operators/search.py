"""ER-11: the best entries for each of many search texts, by lists of token profiles and a bound that leaves out frequent ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.sources.scratch import written

# What a token counts in an entry's label, terms and sub line, and how many entries a search shows.
WEIGHTS, SHOWN = {"label": 6, "terms": 3, "sub": 1}, 14
#: Profiles that a query's rarest lists hold together, at least, before a bound is taken; pairs that one share of a list makes.
LOOKED, PAIRS = 1000, 200_000


def tokens(text: Column) -> Column:
    """The distinct runs of a-z and 0-9 of a text, lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def _profiles(entries: DataFrame, asked: DataFrame, k: int, fields: list[str]) -> DataFrame:
    """The distinct sets of asked tokens that entries hold: a column per field, keys (field:token) and the k smallest members."""
    own = [F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("tokens")) for f in fields]
    held = entries.select("kind", "id", F.explode(F.array(*own)).alias("f")).select("kind", "id", "f.field", F.explode("f.tokens").alias("token"))
    held = held.join(asked.select(F.explode("tokens").alias("token")).distinct(), "token", "left_semi")
    keys = F.array_sort(F.collect_set(F.concat("field", F.lit(":"), "token")))
    each = held.groupBy("kind", "id").agg(keys.alias("keys"))
    n = F.row_number().over(Window.partitionBy("keys").orderBy("kind", "id"))
    least = each.withColumn("n", n).where(F.col("n") <= k).groupBy("keys").agg(F.array_sort(F.collect_list(F.struct("kind", "id"))).alias("members"))
    of = lambda f: F.transform(F.filter("keys", lambda x: x.startswith(f"{f}:")), lambda x: F.substring(x, F.lit(len(f) + 2), F.length(x)))
    return written(least.select("keys", "members", F.col("members")[0].alias("first"), *(of(f).alias(f"_{f}") for f in fields)), "profiles")


def _met(lists: DataFrame, profiles: DataFrame, weights: dict[str, int], k: int) -> DataFrame:
    """The k best profiles of each set of tokens over its lists: tokens, first, held and the full score.

    A list that makes many pairs is dealt in shares of its askers. A profile counts in the first of the lists that hold it.
    """
    spread = int(profiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = lists.groupBy("key").agg(F.count("*").alias("a"), F.max("n").alias("n")).select("key", F.least("a", F.ceil(F.col("a") * F.col("n") / PAIRS)).alias("shares"))
    left = lists.join(shares, "key").withColumn("share", F.pmod(F.xxhash64("tokens"), "shares")).drop("n", "shares")
    right = profiles.withColumn("key", F.explode("keys")).join(shares, "key").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
    pairs = left.repartition(spread, "key", "share").join(right.repartition(spread, "key", "share"), ["key", "share"]).where(~F.arrays_overlap("keys", "earlier"))
    score = sum(F.lit(w) * F.size(F.array_intersect(f"_{f}", "tokens")) for f, w in weights.items())
    return _best(pairs.select("tokens", "first", F.size("members").alias("held"), score.cast("long").alias("score")), k)


def _best(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("tokens").orderBy(F.desc("score"), "first"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def top_entries(entries: DataFrame, queries: DataFrame, k: int = SHOWN, weights: dict[str, int] | None = None) -> DataFrame:
    """query, rank, kind, id and score of the k best entries of each query, ties to the smaller kind and id.

    entries has kind, id and a column for each field of weights; queries has query and text. The score is the sum of the
    fields' weights over the query's tokens that a field has; entries without any are no results. Queries without tokens
    have no row. A row of entries is one entry; kind and id must tell them apart.

    Entries that hold the same of the asked tokens in the same fields score alike in every query: they are one profile, of
    which only the k smallest can be shown; queries of the same tokens are answered once. So work grows with the pairs of
    distinct texts, not with those of rows. Each query's lists of profiles are taken rarest first until they hold LOOKED,
    and scored in full; the k-th best score is a bound from below. The most frequent lists whose weights together stay
    under it can't bring in an entry by themselves: only the other lists give further candidates.
    """
    weights = weights or WEIGHTS
    cut = queries.where(F.col("query").isNotNull()).select("query", tokens(F.col("text")).alias("tokens"))
    each = cut.groupBy("query").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tokens")))).alias("tokens"))
    each = written(each.where(F.size("tokens") > 0), "queries")
    asked = each.select("tokens").distinct()
    profiles = _profiles(entries, asked, k, list(weights))
    sizes = profiles.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    field = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.lit(w).alias("weight")) for f, w in weights.items())))
    lists = asked.select("tokens", F.explode("tokens").alias("token")).select("tokens", "token", field.alias("f"))
    lists = lists.select("tokens", "f.weight", F.concat("f.field", F.lit(":"), "token").alias("key")).join(sizes, "key")
    rare = Window.partitionBy("tokens").orderBy("n", "key").rowsBetween(Window.unboundedPreceding, -1)
    above = F.sum("weight").over(Window.partitionBy("tokens").orderBy(F.desc("n"), F.desc("key")).rowsBetween(Window.unboundedPreceding, 0))
    # Of a query, lists are as many as its tokens and the fields: windows over them are small.
    lists = lists.withColumns({"looked": F.coalesce(F.sum("n").over(rare), F.lit(0)) < LOOKED, "earlier": F.collect_list("key").over(rare), "above": above})
    lists = written(lists, "lists")
    take = lambda df: df.select("tokens", "key", "n", "earlier")
    looked = written(_met(take(lists.where("looked")), profiles, weights, k), "looked")
    order = Window.partitionBy("tokens").orderBy(F.desc("score"), "first").rowsBetween(Window.unboundedPreceding, 0)
    bound = looked.withColumn("so_far", F.sum("held").over(order)).where(F.col("so_far") >= k).groupBy("tokens").agg(F.max("score").alias("bound"))
    essential = lists.where("not looked").join(bound, "tokens", "left").where(F.col("above") >= F.coalesce("bound", F.lit(0)))
    more = _met(written(take(essential), "essential"), profiles, weights, k)
    found = _best(looked.unionByName(more), k).join(profiles.select("first", "members"), "first")
    shown = found.select("tokens", "score", F.explode("members").alias("m")).select("tokens", "score", "m.kind", "m.id")
    rank = F.row_number().over(Window.partitionBy("tokens").orderBy(F.desc("score"), "kind", "id"))
    shown = shown.withColumn("rank", rank).where(F.col("rank") <= k)
    return each.join(shown, "tokens").select("query", "rank", "kind", "id", "score")
