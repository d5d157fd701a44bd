"""Fill-in-the-middle transformation: DuckDB SQL over the Arrow batches of mapInArrow.

A text is cut into lines; a hash of its id draws two cuts between lines and the form. The three parts are put out as
`<P>`prefix`<S>`suffix`<M>`middle (psm) or `<S>`suffix`<P>`prefix`<M>`middle (spm); a text that is empty or holds one of
the markers stays as it is (plain), so that restored() always finds the text again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm._common import table

#: Seed of the draws; of a hundred texts so many are rearranged, and so many of these are spm.
SEED, RATE, SPM_RATE = 7, 100, 50
#: Bytes of text that DuckDB gets at once; a longer text goes alone.
CHUNK = 8 << 20
# The marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")

_RESULT = ("n", "form", "prefix_chars", "middle_chars", "output")


def _sql(keep: list[str], seed: int, rate: int, spm_rate: int) -> str:
    """The transformation of a table `batch` (_id, _text and the columns of keep)."""
    p, s, m = (f"'{x}'" for x in MARKS)
    draw = lambda k: f"('0x' || substr(_hash, {8 * k - 7}, 8))::UBIGINT"
    plain = " OR ".join(["_text = ''", *(f"contains(_text, {x})" for x in (p, s, m)), f"{draw(3)} % 100 >= {int(rate)}"])
    kept = "".join(f'"{c}", ' for c in keep)
    return rf"""
WITH _cut AS (
  SELECT {kept}_text, regexp_extract_all(_text, '[^\n]*\n|[^\n]+') AS _units, sha256('{int(seed)}:' || _id) AS _hash FROM batch
), _drawn AS (
  SELECT {kept}_text, _units, len(_units) AS _n, {draw(1)} % (len(_units) + 1) AS _a, {draw(2)} % (len(_units) + 1) AS _b,
    CASE WHEN {plain} THEN 'plain' WHEN {draw(4)} % 100 < {int(spm_rate)} THEN 'spm' ELSE 'psm' END AS _form
  FROM _cut
), _parts AS (
  SELECT {kept}_text, _n, _form, array_to_string(list_slice(_units, 1, least(_a, _b)::BIGINT), '') AS _prefix,
    array_to_string(list_slice(_units, least(_a, _b)::BIGINT + 1, greatest(_a, _b)::BIGINT), '') AS _middle,
    array_to_string(list_slice(_units, greatest(_a, _b)::BIGINT + 1, _n), '') AS _suffix
  FROM _drawn
)
SELECT {kept}_n::BIGINT AS n, _form AS form, CASE WHEN _form <> 'plain' THEN length(_prefix) END::BIGINT AS prefix_chars,
  CASE WHEN _form <> 'plain' THEN length(_middle) END::BIGINT AS middle_chars,
  CASE _form WHEN 'plain' THEN _text WHEN 'psm' THEN {p} || _prefix || {s} || _suffix || {m} || _middle
    ELSE {s} || _suffix || {p} || _prefix || {m} || _middle END AS output
FROM _parts
"""


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have CHUNK bytes at most, or of one row."""
    sizes = pc.binary_length(batch.column("_text")).to_numpy(zero_copy_only=False)
    begin, size = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and size + n > CHUNK:
            yield batch.slice(begin, i - begin)
            begin, size = i, 0
        size += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def fill_in_middle(docs: DataFrame, keep: tuple[str, ...] = (), seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row of docs (doc_id, text), with its columns `keep`.

    n counts the lines, prefix_chars and middle_chars the code points of these parts (null: plain), output is the text in
    its form. A null text counts as empty and is plain; a null id draws like the empty one; rows that repeat an id draw
    alike. Columns of docs that are not kept, or have a name of the result, are left out. An empty table gives an empty
    result. Nothing is shuffled; a task holds CHUNK bytes of texts, or one longer text, at a time.
    """
    kept = ["doc_id", *(c for c in keep if c not in ("doc_id", *_RESULT))]
    rows = docs.select(*kept, F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    sql = _sql(kept, seed, rate, spm_rate)

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        # In memory alone: nothing is spilled to a folder of this machine.
        with duckdb.connect(config={"threads": 1, "temp_directory": ""}) as con:
            for batch in batches:
                for part in _chunks(batch):
                    con.register("batch", pa.Table.from_batches([part]))
                    yield from con.sql(sql).to_arrow_table().to_batches()
                    con.unregister("batch")

    schema = T.StructType([docs.schema[c] for c in kept])
    for name in _RESULT:
        schema = schema.add(name, "string" if name in ("form", "output") else "long")
    return rows.mapInArrow(transform, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that fill_in_middle() put into this output and form."""
    p, s, m = (F.lit(x) for x in MARKS)
    # The first mark stands at the start; the other two occur once each, as no rearranged text holds one.
    inner, last = F.when(form == "psm", s).otherwise(p), F.instr(output, MARKS[2])
    at = F.locate(MARKS[1], output, 2)
    at = F.when(form == "psm", at).otherwise(F.locate(MARKS[0], output, 2))
    first = F.substr(output, F.lit(4), at - 4)
    second = F.substr(output, at + F.length(inner), last - at - 3)
    middle = F.substr(output, last + F.length(m))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    found = rows.withColumn("output_sha256", digest(F.col("output"))).withColumn("restored_sha256", digest(restored(F.col("output"), F.col("form"))))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS h FROM documents),
l AS (
  -- Every line with its break; what follows the last break is a line unless it is empty.
  SELECT *, CASE WHEN len(s) = 1 AND s[1] = '' THEN []::VARCHAR[]
    ELSE list_transform(s[:len(s) - 1], lambda x: x || chr(10)) || CASE WHEN s[len(s)] = '' THEN []::VARCHAR[] ELSE s[len(s):len(s)] END END AS u
  FROM (SELECT *, string_split(text, chr(10)) AS s FROM d)
), k AS (
  SELECT doc_id, text, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS y,
    CASE WHEN text = '' OR text LIKE '%<P>%' OR text LIKE '%<S>%' OR text LIKE '%<M>%' THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM l
), c AS (
  SELECT *, list_aggregate([''] || u[:least(x, y)], 'string_agg', '') AS p,
    list_aggregate([''] || u[least(x, y) + 1:greatest(x, y)], 'string_agg', '') AS m,
    list_aggregate([''] || u[greatest(x, y) + 1:], 'string_agg', '') AS s
  FROM k
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM c
"""
