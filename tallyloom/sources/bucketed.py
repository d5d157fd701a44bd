"""SNK-03/05, STM-01: tables that are merged into by rewriting only the buckets that a merge touches.

A table is a folder: data/<draft>/bucket=<n> holds rows of one bucket of the keys' hash, log/v<number> is a version, a record
that names the files of every bucket. A merge reads and rewrites the buckets of its source's keys and commits a record that
takes the others over from the version before. The record gets its name by an operation that fails if the name is taken: of
two writers that read the same version one commits first; the other takes its turn after it if their buckets differ, and is
refused otherwise. Readers see whole versions only; what a lost driver leaves is named by no record.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(Exception):
    """Another writer has changed a bucket that this merge has read."""


class Refused(ValueError):
    """Rows to be written break a check; the version before stays the newest."""


class BucketedTable:
    """A table of rows with a key, below a folder that all writers and readers share.

    The store must give a rename that fails on an existing name (HDFS) or hard links (a local or mounted folder).
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # Files, by the file system that holds the path.

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("log").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _list(self, name: str) -> list[str]:
        fs = self._fs()
        return [x.getPath().getName() for x in fs.listStatus(self._at(name))] if fs.exists(self._at(name)) else []

    def _text(self, name: str) -> str:
        stream = self._fs().open(self._at(name))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put_once(self, name: str, text: str) -> bool:
        """Writes a file that appears whole under its name, or not at all where the name is taken."""
        jvm, fs = self.spark.sparkContext._jvm, self._fs()
        draft = self._at(f"draft/{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        fs.mkdirs(self._at(name).getParent())
        try:
            if fs.getScheme() == "file":
                local = lambda p: jvm.java.nio.file.Paths.get(fs.makeQualified(p).toUri().getPath(), self._none())
                jvm.java.nio.file.Files.createLink(local(self._at(name)), local(draft))
            else:
                options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
                context.rename(draft, self._at(name), options)
            return True
        except Exception as e:  # whatever the store raises: the name tells whether it was taken
            if "AlreadyExists" not in str(e) and not fs.exists(self._at(name)):
                raise
            return False
        finally:
            fs.delete(draft, False)

    def _none(self):
        return self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.java.lang.String, 0)

    # Versions.

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: str | T.StructType, keys: list[str], buckets: int) -> BucketedTable:
        """An empty table; Conflict if there is one already. buckets is fixed: take some hundred megabytes of rows a bucket."""
        table = cls(spark, path)
        kind = schema if isinstance(schema, T.StructType) else spark.createDataFrame([], schema).schema
        if "bucket" in kind.names:
            raise ValueError("a bucketed table can't have a column `bucket`")
        record = {"schema": kind.json(), "keys": keys, "n": buckets, "files": {}, "touched": [], "done": {}}
        if not table._put_once("log/v0", json.dumps(record)):
            raise Conflict(f"{path} is a table already")
        return table

    def exists(self) -> bool:
        return bool(self.versions())

    def versions(self) -> list[int]:
        return sorted(int(n[1:]) for n in self._list("log") if re.fullmatch(r"v\d+", n))

    def record(self, version: int) -> dict:
        return json.loads(self._text(f"log/v{version}"))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest if none is named."""
        have = self.versions()
        if not have or (version is not None and version not in have):
            raise ValueError(f"{self.path} has no version {'' if version is None else version}")
        return self._rows(self.record(have[-1] if version is None else version))

    def _rows(self, record: dict, buckets: list[int] | None = None) -> DataFrame:
        files = [f for b, f in record["files"].items() if buckets is None or int(b) in buckets]
        schema = T.StructType.fromJson(json.loads(record["schema"]))
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/data/{f}" for f in files)) if files else self.spark.createDataFrame([], schema)

    def merge(self, source: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], once: tuple[str, int] | None = None, checks: dict[str, Column] | None = None, strict: bool = True) -> dict:
        """Commits how(target, source) as a new version and returns what it did: version, touched buckets, violations.

        target has the table's rows of the buckets that the source's keys fall into: how() gives what these are to hold, and
        no rows of other keys. once (writer, number): a number that the writer has committed, or a smaller one, changes
        nothing, so that a batch that runs twice counts once. checks name conditions that every row must meet; rows that
        don't, or where a condition is null, are counted while the rows are written, and with strict refuse the version.
        Rows with a null key fall into a bucket of their own kind like any other.
        """
        base = self.versions()[-1]
        record = self.record(base)
        if once and record["done"].get(once[0], -1) >= once[1]:
            return {"version": base, "touched": [], "violations": {}}
        bucket = F.pmod(F.xxhash64(*record["keys"]), F.lit(record["n"])).cast("int")
        touched = sorted(r["b"] for r in source.select(bucket.alias("b")).distinct().collect())  # at most n numbers
        if not touched:
            return {"version": base, "touched": [], "violations": {}}
        schema = T.StructType.fromJson(json.loads(record["schema"]))
        rows = how(self._rows(record, touched), source).select(*(F.col(f.name).cast(f.dataType) for f in schema))
        draft, violations = self._write(rows, bucket, schema, checks or {})
        fresh = {int(n.split("=")[1]): f"{draft}/{n}" for n in self._list(f"data/{draft}") if n.startswith("bucket=")}
        strange = set(fresh) - set(touched)
        if strange or (strict and any(violations.values())):
            self._fs().delete(self._at(f"data/{draft}"), True)
            raise Refused(f"rows of other buckets: {sorted(strange)}" if strange else f"checks that rows break: {violations}")
        number = base + 1
        while True:
            files = {b: f for b, f in record["files"].items() if int(b) not in touched} | {str(b): f for b, f in fresh.items()}
            done = record["done"] | ({once[0]: once[1]} if once else {})
            if self._put_once(f"log/v{number}", json.dumps(record | {"files": files, "touched": touched, "done": done})):
                return {"version": number, "touched": touched, "violations": violations}
            record = self.record(number)  # another writer was first
            again = bool(once) and record["done"].get(once[0], -1) >= once[1]
            if again or set(record["touched"]) & set(touched):
                self._fs().delete(self._at(f"data/{draft}"), True)
                if again:
                    return {"version": number, "touched": [], "violations": {}}
                raise Conflict(f"version {number} of {self.path} has changed buckets that version {base} was read for")
            number += 1

    def _write(self, rows: DataFrame, bucket: Column, schema: T.StructType, checks: dict[str, Column]) -> tuple[str, dict[str, int]]:
        """A draft of the rows, dealt by bucket, read back and held against what was counted as it was written."""
        draft, seen = uuid.uuid4().hex, Observation()
        row = F.xxhash64(*(F.to_json(F.struct(f.name)) if f.dataType.typeName() in ("map", "variant") else F.col(f.name) for f in schema))
        counts = [F.count("*").alias("rows"), F.bit_xor(row).alias("mixed"), *(F.count_if(~F.coalesce(c, F.lit(False))).alias(f"check {n}") for n, c in checks.items())]
        dealt = rows.withColumn("bucket", bucket).repartition("bucket").observe(seen, *counts)
        dealt.write.partitionBy("bucket").parquet(f"{self.path}/data/{draft}")
        stored = [n for n in self._list(f"data/{draft}") if n.startswith("bucket=")]
        found = self.spark.read.schema(schema).parquet(*(f"{self.path}/data/{draft}/{n}" for n in stored)) if stored else self.spark.createDataFrame([], schema)
        n, mixed = found.agg(F.count("*"), F.bit_xor(row)).first()
        if (n, mixed) != (seen.get["rows"], seen.get["mixed"]):
            raise OSError(f"{self.path}/data/{draft}: {n} rows were read back where {seen.get['rows']} were written")
        return draft, {name: seen.get[f"check {name}"] for name in checks}

    def vacuum(self, keep: int = 3, idle_seconds: float = 24 * 3600) -> list[str]:
        """Deletes all but the newest `keep` records, then the drafts that none of these names and that are older than any
        writer takes; returns those drafts."""
        fs, have = self._fs(), self.versions()
        for old in have[:-keep]:
            fs.delete(self._at(f"log/v{old}"), False)
        named = {f.split("/")[0] for v in have[-keep:] for f in self.record(v)["files"].values()}
        now = self.spark.sparkContext._jvm.java.lang.System.currentTimeMillis()
        dead = [d for d in self._list("data") if d not in named and now - fs.getFileStatus(self._at(f"data/{d}")).getModificationTime() >= idle_seconds * 1000]
        for d in dead:
            fs.delete(self._at(f"data/{d}"), True)
        return dead
