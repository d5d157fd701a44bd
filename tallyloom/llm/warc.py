"""WARC archives as a chunked record table.

An archive is a table of rows (record_id, chunk, chunks, digest, data): the record's bytes in order, cut so that no row
holds more than CHUNK bytes of payload, and the SHA-1 of the payload up to there. Joined by record and chunk number the
rows are a valid WARC/1.1 file, yet no task ever builds a whole record, on writing or on reading. Digests are carried from
chunk to chunk and held against the header's on both ways. Spark's own writer stores the table, so it works on any file
system that Spark reaches.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm._common import new_path, table

#: Bytes of a payload in one row; parts that a group of equal payloads is dealt to when it looks up its response.
CHUNK, SALT = 1 << 16, 16
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNKS = "record_id string, chunk int, chunks int, digest string, data binary"


def base32_sha1(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _uri(page_id: str | None) -> str:
    return f"<urn:page:{page_id or ''}>"


def _header(row) -> bytes:
    """The WARC and HTTP header of a record; a revisit names its response and the length of the payload it leaves out."""
    revisit = row.record_type == "revisit"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row.record_type}",
        f"WARC-Record-ID: {_uri(row.page_id)}",
        f"WARC-Target-URI: {' '.join((row.url or '').split())}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base32_sha1(row.digest)}",
        f"X-Payload-Length: {row.bytes}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: {_uri(row.refers_to)}", f"WARC-Profile: {_PROFILE}"]
    lines.append(f"Content-Length: {len(_HTTP) + (0 if revisit else row.bytes)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + _HTTP


def _serialise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunk rows of records; the first has the header, the last the two line breaks that end a record.

    A record's chunks come one after the other, as they are cut from it.
    """
    sha = hashlib.sha1()
    for pdf in batches:
        out = []
        for row in pdf.itertuples():
            first, last, revisit = row.chunk == 0, row.chunk == row.chunks - 1, row.record_type == "revisit"
            part = b"" if revisit else bytes(row.part)
            if first:
                sha = hashlib.sha1()
            sha.update(part)
            if last and not revisit and sha.hexdigest() != row.digest:
                raise ValueError(f"payload digest {sha.hexdigest()}, header {row.digest}")
            data = (_header(row) if first else b"") + part + (b"\r\n\r\n" if last else b"")
            out.append((row.record_id, row.chunk, row.chunks, row.digest if revisit else sha.hexdigest(), data))
        yield pd.DataFrame(out, columns=["record_id", "chunk", "chunks", "digest", "data"]).astype({"chunk": "int32", "chunks": "int32"})


def _identified(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, url, payload, bytes, digest, record_type and refers_to of every page.

    Equal payloads meet by length and SHA-1: first each task reduces its rows to one per payload, then every page looks up
    the largest page_id under one of SALT copies of that row, so a payload that a third of all pages share spreads out.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("bytes", F.length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    held = rows.groupBy("bytes", "digest").agg(F.max("page_id").alias("of")).where(F.col("bytes") >= min_bytes)
    spread = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int")).join(spread, ["bytes", "digest", "salt"], "left")
    again = F.coalesce(~F.col("page_id").eqNullSafe(F.col("of")) & F.col("of").isNotNull(), F.lit(False))
    return rows.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("of"))).drop("salt", "of")


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Writes pages (page_id, url, html) as a chunked record table at path, one WARC record per row.

    Of records with equal payloads of at least min_bytes bytes that with the largest page_id is the response and the
    others revisit it. A null html is an empty payload. Rows that repeat a page_id are records of their own; among equal
    payloads all rows of the largest page_id are responses. A row without a page_id refers to the largest page_id if there
    is one. Columns besides the three are ignored.
    """
    records = _identified(pages, min_bytes)
    stored = F.when(F.col("record_type") == "revisit", F.lit(0)).otherwise(F.col("bytes"))
    chunks = F.greatest(F.lit(1), F.ceil(stored / CHUNK)).cast("int")
    # A record's rows share an id that no other row has, even where page ids repeat.
    rows = records.withColumn("record_id", F.expr("uuid()")).withColumn("chunks", chunks).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    # Each chunk is cut when its row is made: no row holds them all.
    part = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.substring(F.col("payload"), F.col("chunk") * CHUNK + 1, F.lit(CHUNK)))
    # Ids pass as text: pandas has no whole numbers beside nulls.
    cut = rows.select("record_id", F.col("page_id").cast("string").alias("page_id"), "url", "bytes", "digest", "record_type", F.col("refers_to").cast("string").alias("refers_to"), "chunks", "chunk", part.alias("part"))
    cut.mapInPandas(_serialise, _CHUNKS).write.parquet(path)


class Reader:
    """Parses one record from its chunks as they come; holds a digest and counts but no payload."""

    def __init__(self) -> None:
        self.head, self.fields, self.skip, self.left = b"", None, 0, 0
        self.sha, self.size = hashlib.sha1(), 0

    def feed(self, data: bytes, digest: str) -> None:
        """The next chunk; digest is that of the payload up to its end."""
        self._take(data)
        if self.fields is not None and self.fields["WARC-Type"] != "revisit" and self.sha.hexdigest() != digest:
            raise ValueError(f"chunk digest {self.sha.hexdigest()}, stated {digest}")

    def _take(self, data: bytes) -> None:
        if self.fields is None:
            self.head += data
            end = self.head.find(b"\r\n\r\n")
            http = self.head.find(b"\r\n\r\n", end + 4) if end >= 0 else -1
            if http < 0:
                return
            lines = self.head[:end].decode().split("\r\n")
            if lines[0] != "WARC/1.1":
                raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
            self.fields = dict(line.split(": ", 1) for line in lines[1:])
            self.left = int(self.fields["Content-Length"]) - (http + 4 - (end + 4))
            data, self.head = self.head[http + 4 :], b""
        part = data[: self.left]
        self.sha.update(part)
        self.size += len(part)
        self.left -= len(part)

    def row(self) -> tuple:
        """page_id, payload_bytes, payload_digest, record_type, refers_to; a digest that isn't its header's is an error."""
        if self.fields is None or self.left:
            raise ValueError("a record ends before its content does")
        number = lambda name: int(self.fields[name][len("<urn:page:") : -1]) if self.fields.get(name, "<urn:page:>") != "<urn:page:>" else None
        kind, stated = self.fields["WARC-Type"], self.fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "revisit":
            return number("WARC-Record-ID"), int(self.fields["X-Payload-Length"]), stated, kind, number("WARC-Refers-To")
        digest = base64.b32encode(self.sha.digest()).decode()
        if digest != stated:
            raise ValueError(f"payload digest {digest}, header {stated}")
        return number("WARC-Record-ID"), self.size, digest, kind, None


_RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in _RESULT.split(", ")]
    reader, current = None, None

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})

    for pdf in batches:
        rows = []
        for record, digest, data in zip(pdf["record_id"], pdf["digest"], pdf["data"], strict=True):
            if record != current:
                if reader is not None:
                    rows.append(reader.row())
                reader, current = Reader(), record
            reader.feed(bytes(data), digest)
        yield frame(rows)
    if reader is not None:
        yield frame([reader.row()])


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of an archive. Records of one chunk are parsed where they are read; only longer ones are
    brought together by record, in the order of their chunks, and stream through one parser."""
    rows = spark.read.schema(_CHUNKS).parquet(path)
    short = rows.where("chunks = 1").select("record_id", "digest", "data").mapInPandas(_parse, _RESULT)
    long = rows.where("chunks > 1").repartition("record_id").sortWithinPartitions("record_id", "chunk").select("record_id", "digest", "data").mapInPandas(_parse, _RESULT)
    return short.unionByName(long)


def op10_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path)


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha1(coalesce(html, '')) AS hex FROM pages
), r AS (SELECT *, max(page_id) OVER (PARTITION BY n, hex) AS of FROM p)
SELECT page_id, n AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((((instr('0123456789abcdef', substr(hex, (i * 5 // 4 + 1)::INTEGER, 1)) - 1) * 16 + greatest(instr('0123456789abcdef', nullif(substr(hex, (i * 5 // 4 + 2)::INTEGER, 1), '')) - 1, 0)) // (1 << (3 - (i * 5) % 4)::INTEGER)) % 32)::INTEGER, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = of THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> of THEN of END AS refers_to
FROM r
"""
