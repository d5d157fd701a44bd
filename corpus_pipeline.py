"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame, which run()
writes as Parquet and rereads as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm._common import WORD, table, written
from tallyloom.llm.mixing import mix
from tallyloom.llm.near_dedup import near_duplicates
from tallyloom.llm.packing import best_fit
from tallyloom.llm.quality import score_quality
from tallyloom.llm.toxicity import score_toxicity

#: SQL can't express the trained stages; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


#: What a stage's operator reads; all other columns travel in one, so that no name of theirs clashes with an operator's.
READ, OTHERS = ("doc_id", "text", "source", "n_chars"), "_others"


def _bundled(docs: DataFrame) -> DataFrame:
    others = [c for c in docs.columns if c not in READ]
    return docs.select(*READ, (F.struct(*others) if others else F.lit(None).cast("string")).alias(OTHERS))


def _unbundled(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*(c if c in READ else F.col(f"{OTHERS}.{c}").alias(c) for c in docs.columns))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar predicts to be toxic go.

    Null and empty texts and rows without an id are scored like others (no clause scores, so they stay); rows that repeat
    an id are judged each by its text. An empty table gives an empty one.
    """
    scored = score_toxicity(_bundled(docs), table(spark, sf_dir, "labels"), ("text", "source", "n_chars", OTHERS))
    return _unbundled(scored.where("predicted = 0"), docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field predicts to be bad go.

    Null and empty texts count as one line without features and are judged by its score; rows without an id or with a
    repeated one are judged each by its text. An empty table gives an empty one.
    """
    scored = score_quality(_bundled(docs), table(spark, sf_dir, "labels"), ("text", "source", "n_chars", OTHERS))
    return _unbundled(scored.where("predicted = 1"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id.

    Rows that repeat an id are one document: of those with equal texts one stays (the least in the order of its other
    columns), and different texts of an id that stays all stay. Null and empty texts and rows without an id are in no
    group and stay. An empty table gives an empty one.
    """
    kept = near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct(*rest)
    named = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min_by(row, F.to_json(row)).alias(OTHERS))
    named = named.select(*(F.col(f"{OTHERS}.{c}").alias(c) if c in rest else F.col(c) for c in docs.columns))
    return named.unionByName(docs.where("doc_id is null"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document appears once for each time that its source's budget takes it whole, and once more cut to its first
    words, joined by blanks, where the budget ends within it; a document that the mix doesn't take goes.

    Null and empty texts have no words to take and go; a null source is a source of its own; rows without an id or with a
    repeated one are documents of their own. n_chars is that of the new text. An empty table gives an empty one.
    """
    taken = mix(_bundled(docs), ("text", OTHERS)).where("taken > 0")
    size, words = F.col("size"), F.filter(F.split("text", WORD_BREAK), lambda w: w != "")
    whole = taken.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / size).cast("int"))))
    rest = F.least(size, F.col("taken") - (F.col("epoch") - 1) * size).cast("int")
    cut = whole.withColumn("text", F.when(rest < size, F.array_join(F.slice(words, F.lit(1), rest), " ")).otherwise(F.col("text")))
    return _unbundled(cut.withColumn("n_chars", F.length("text").cast("long")), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every word of the mix lies in the packed training sequences.

    A text without words has a row without a bin; rows that repeat an id or lack one are packed like others. An empty
    table gives an empty one.
    """
    return best_fit(docs)


#: Between words stands ASCII white space.
WORD_BREAK = WORD.replace("[^", "[")

STAGES = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each one's result written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
