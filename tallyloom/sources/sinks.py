"""Sinks: a deterministic document export and its reproducibility check, verified versions, snapshots, pruning."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def payload(parts: dict[str, DataFrame], order: dict[str, list[str]]) -> DataFrame:
    """SNK-01: one row whose column `payload` is a JSON object with a sorted array for each part.

    Meant for publication extracts: a part's rows meet in one array, so it must be small.
    """
    out = None
    for name, df in parts.items():
        fields = order[name] + [c for c in df.columns if c not in order[name]]
        one = df.agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
        out = one if out is None else out.join(one)
    return out.select(F.to_json(F.struct(*parts)).alias("payload"))


def write_script(df: DataFrame, path: str, variable: str) -> None:
    """The payload as a script that assigns it to a variable."""
    df.select(F.concat(F.lit(f"{variable} = "), "payload", F.lit(";"))).coalesce(1).write.mode("overwrite").text(path)


def differences(left: DataFrame, right: DataFrame, volatile: dict[str, str] | None = None) -> DataFrame:
    """SNK-02: rows of one side only, with `side`; columns in `volatile` are blanked by a pattern first. Empty: the same."""
    for column, pattern in (volatile or {}).items():
        left, right = (df.withColumn(column, F.regexp_replace(column, pattern, "")) for df in (left, right))
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def prune_keep_newest(df: DataFrame, group: list[str], order: list, keep: int) -> DataFrame:
    """SNK-08: rows beyond the newest `keep` of each group."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") > keep).drop("_n")


def _files(spark: SparkSession, path: str):
    """The file system that holds path, and a maker of its paths."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def content_hash(df: DataFrame) -> tuple[int, int]:
    """Rows and a checksum of their contents that doesn't depend on their order."""
    rows = df.select(F.xxhash64(*(F.to_json(F.struct(c)) if df.schema[c].dataType.typeName() in ("map", "variant") else F.col(c) for c in df.columns)).alias("h"))
    n, x, s = rows.agg(F.count("*"), F.coalesce(F.bit_xor("h"), F.lit(0)), F.coalesce(F.sum(F.pmod("h", F.lit(1 << 31))), F.lit(0))).first()
    return n, (x ^ s) & ((1 << 63) - 1)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the published versions below path, rising; what is half written has none."""
    fs, make = _files(spark, path)
    if not fs.exists(make(path)):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(make(path))]
    return sorted(int(n[1:]) for n in names if re.fullmatch(r"v\d+", n))


def publish(df: DataFrame, path: str, keep: int = 3, number: int | None = None) -> int:
    """SNK-08: writes df as a new version below path and returns its number.

    The rows go to a temporary folder, are read back and held against what was written, get a manifest, and only then one
    rename makes them a version; the newest `keep` stay. A reader of current() never sees half a version, and a task or
    driver that is lost leaves at most a temporary folder. With `number` a version that exists is left as it is, so that
    a batch that runs twice publishes once.
    """
    spark = df.sparkSession
    fs, make = _files(spark, path)
    have = versions(spark, path)
    number = (have[-1] + 1 if have else 0) if number is None else number
    if number in have:
        return number
    draft = f"{path}/_draft-{uuid.uuid4().hex}"
    df.write.parquet(f"{draft}/rows")
    stored = spark.read.schema(df.schema).parquet(f"{draft}/rows")
    n, checksum = content_hash(stored)
    spark.createDataFrame([(n, checksum, stored.schema.json())], "n long, checksum long, schema string").coalesce(1).write.json(f"{draft}/manifest")
    verify(spark, draft)
    if not fs.rename(make(draft), make(f"{path}/v{number}")):
        raise OSError(f"version {number} of {path} could not be named")
    for old in versions(spark, path)[:-keep]:
        fs.delete(make(f"{path}/v{old}"), True)
    return number


def verify(spark: SparkSession, version_path: str) -> None:
    """Raises ValueError if a version's rows aren't those of its manifest."""
    m = spark.read.schema("n long, checksum long, schema string").json(f"{version_path}/manifest").first()
    found = content_hash(spark.read.parquet(f"{version_path}/rows"))
    if found != (m["n"], m["checksum"]):
        raise ValueError(f"{version_path}: rows and checksum {found}, manifest {(m['n'], m['checksum'])}")


def current(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The rows of the newest version below path; none of the given schema where nothing is published."""
    have = versions(spark, path)
    if have:
        return spark.read.parquet(f"{path}/v{have[-1]}/rows")
    if schema is None:
        raise ValueError(f"nothing is published below {path}")
    return spark.createDataFrame([], schema)


def append_snapshot(df: DataFrame, path: str, day: str) -> None:
    """SNK-07: df as the day's rows of a history; the same day again replaces its rows and leaves the others."""
    df.withColumn("day", F.lit(day)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def drifted(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-02: keys and `how` (added, removed, changed) and `fields` of rows that differ between two payloads."""
    others = [c for c in left.columns if c not in keys]
    here = lambda side: F.col(f"{side}._there").isNotNull()
    both = left.withColumn("_there", F.lit(1)).alias("a").join(right.withColumn("_there", F.lit(1)).alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full_outer")
    fields = F.array_join(F.array_compact(F.array(*(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in others))), ",")
    how = F.when(~here("a"), "added").when(~here("b"), "removed").when(fields != "", "changed")
    out = both.select(*(F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys), how.alias("how"), F.when(how == "changed", fields).alias("fields"))
    return out.where("how is not null")
