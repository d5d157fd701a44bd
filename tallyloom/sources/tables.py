"""Scans: the driver tables, optional tables, JSON in several wrappings, HTML with embedded data, directory listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables:
    """The tables of one folder as attributes: Tables(spark, folder).orders."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def scan_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-02/03: a Parquet table, or no rows of the given schema where nothing is stored."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def enabled_entries(entries: DataFrame, key: str, enabled: str) -> DataFrame:
    """SRC-08: entries of a registry that have an id which is no placeholder and aren't switched off; no statement is on."""
    named = F.col(key).isNotNull() & (F.trim(key) != "") & ~F.upper(key).startswith("PLACEHOLDER")
    return entries.where(named & F.coalesce(F.col(enabled), F.lit(True)))


def read_json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-04: whole-file JSON; a corrupt file gives nulls instead of an error."""
    return spark.read.option("multiLine", True).option("mode", "PERMISSIVE").schema(schema).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-05: one JSON object per line."""
    return spark.read.schema(schema).json(path)


def parse_lines(df: DataFrame, key: str, text: str, schema: str) -> DataFrame:
    """SRC-05: `key`, line and the fields of each line of a text of one JSON object per line; blank and broken lines give no row."""
    lines = df.select(key, F.posexplode(F.split(text, "\r?\n")).alias("line", "raw")).where(F.trim("raw") != "")
    good = lines.where(F.try_parse_json("raw").isNotNull())
    return good.select(key, "line", F.from_json("raw", schema).alias("r")).select(key, "line", "r.*")


def parse_feed(df: DataFrame, key: str, text: str, schema: str) -> DataFrame:
    """SRC-09: `key` and the fields of each entry of a feed held as text; a feed that isn't XML gives no row."""
    entries = F.from_xml(F.col(text), f"entry array<struct<{schema}>>", {"mode": "PERMISSIVE"})["entry"]
    return df.select(key, F.explode(entries).alias("e")).select(key, "e.*")


def unwrap_js(text: Column) -> Column:
    """SRC-06: the object between the first and the last brace of a script that assigns it."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def read_feed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-09: the entries of an XML feed; a malformed one comes as nulls."""
    return spark.read.format("xml").option("rowTag", "entry").option("mode", "PERMISSIVE").schema(schema).load(path)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """SRC-13: path and length of a folder's files, without their contents."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length")


def first_match(text: Column, *patterns: str) -> Column:
    """SRC-11: the first group of the first pattern that a text has, else null."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns))


def sample_ladder(df: DataFrame, start: str, end: str, step: int, name: str = "at") -> DataFrame:
    """SRC-14: a row for every `step` between two numeric columns, both ends included; none where end < start."""
    return df.where(F.col(end) >= F.col(start)).withColumn(name, F.explode(F.sequence(F.col(start), F.col(end), F.lit(step).cast("long"))))
