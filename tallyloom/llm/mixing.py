"""Mixing sources to target weights, by DataFrame functions alone.

Every document gets a hash-random key; a source's key range is cut into even buckets of bounded size, so the documents lie
in key order without a sampled range partitioning and a source of any size spreads over many tasks. Sums of words run
within a bucket; the buckets' totals, added up per source, give each its offset. A source's budget cuts the order at an
exact word, after as many whole epochs as it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm._common import n_words, table, written

#: Weights of the sources in code-point order, repeating; epochs that no source exceeds; documents in a bucket.
WEIGHTS, MOST_EPOCHS, BUCKET_ROWS = (5, 2, 1), 3, 4_000
#: Mixed into the hash that gives a document its random key.
SEED = "mix-1"


def random_key(doc_id: Column, text: Column) -> Column:
    """A hash-random key as 32 hex digits, the same in every engine that has MD5; rows that repeat an id differ by their text."""
    own = F.coalesce(F.md5(text.cast("string").cast("binary")), F.lit(""))
    return F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), own).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size, documents, target of a table with one row per source (source, source_size, documents).

    The sources by code point, null last, weigh `weights` in turn and share all words; a target stops at `epochs` times
    its source's words and the excess is shared anew by weight. In the order of cap by weight the capped sources come
    first, so one pass finds the level: the first source whose fair share lies below its cap.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    named = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1).withColumn("w", w)
    named = named.withColumn("cap", F.col("source_size") * epochs)
    rising = Window.orderBy((F.col("cap") / F.col("w")), "place")
    before, rest = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(rest)
    at = named.withColumn("level", level.cast("double"))
    fits = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("place_in_order", "level"))).over(everything)["level"]
    at = at.withColumn("place_in_order", F.row_number().over(rising)).withColumn("level", fits)
    return at.select("source", "source_size", "documents", F.coalesce(F.least(F.col("cap").cast("double"), F.col("w") * F.col("level")), F.col("cap").cast("double")).alias("target"))


def mix(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every row of docs (doc_id, text, source), with `carry`.

    size counts a text's words (null: 0). taken is what the mix takes of a document, repeats counted: the source's
    budget is its target rounded down, its documents are taken whole in the order of their random keys, again from the
    start after the last, and the document at the cut gives its first words. No document gives more than MOST_EPOCHS times
    its size. The key is a hash of id and text; its ties go by id and size, and rows that repeat each other wholly are interchangeable. A null
    source is a source of its own; a row without an id takes part under an empty id. An empty table gives an empty result.
    """
    # The words are counted once; sums and cuts then read this table, which is narrow unless more is carried.
    rows = docs.select("doc_id", "source", *carry, n_words(F.col("text")).alias("size"), random_key(F.col("doc_id"), F.col("text")).alias("key"))
    rows = written(rows, "sizes")
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    budgets = targets(per_source).withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("documents") / BUCKET_ROWS)).cast("int"))
    # One row per source; its size isn't bounded in general, so Spark chooses how to join it.
    keyed = rows.join(budgets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    fraction = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / float(1 << 32)
    keyed = keyed.withColumn("bucket", F.floor(fraction * F.col("buckets")).cast("int"))
    totals = keyed.groupBy(F.col("source").alias("of"), F.col("bucket").alias("b")).agg(F.sum("size").alias("words"))
    offsets = totals.withColumn("offset", F.coalesce(F.sum("words").over(Window.partitionBy("of").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    summed = keyed.withColumn("until", F.sum("size").over(within))
    placed = summed.join(offsets.select("of", "b", "offset"), F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("b")))
    start = F.col("offset") + F.col("until") - F.col("size")
    budget = F.floor(F.col("target")).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(0)
    left = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left - start))
    return placed.select("doc_id", "source", *carry, "size", "source_size", "target", taken.cast("long").alias("taken"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(md5(text), '')) AS key FROM documents
), s AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)
), w AS (
  SELECT *, [5, 2, 1][(place % 3 + 1)::INTEGER] AS w, 3 * source_size AS cap FROM s
), o AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
       / sum(w) OVER (ORDER BY cap / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
       row_number() OVER (ORDER BY cap / w, place) AS i FROM w
), t AS (
  SELECT source, source_size, least(cap::DOUBLE, w * (SELECT level FROM o WHERE level * w <= cap ORDER BY i LIMIT 1)) AS target FROM o
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS start,
         CASE WHEN t.source_size > 0 THEN floor(t.target)::BIGINT // t.source_size ELSE 0 END AS epochs
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - start)))::BIGINT AS taken
FROM r
"""
