"""Fill-in-the-middle against a plain version, and back."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import infilling

DOCS = "doc_id long, text string"
TEXTS = [
    "a\nb\n\nc", "", None, "\n", "\n\n\n", "one line", "ends\n", "<<\n<S\nS>\n<\nM>\n<P", "a <P> b\nc", "<M>", "x\n<S>\ny", "é\U0001f600\né\n z\r\nw",
    "nul\0inside\n\0\n", "<", ">\n<", "line\n" * 5000, "long " * 300_000 + "\n" + "b",
]


def plain(doc_id, text, seed=7, rate=100, spm_rate=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(x in text for x in infilling.MARKS) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm_rate:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("seed", "rate", "spm_rate"), [(7, 100, 50), (3, 60, 0), (11, 0, 50), (5, 100, 100)])
def test_equals_the_plain_version_and_back(spark, seed, rate, spm_rate):
    rng = random.Random(seed)
    texts = TEXTS + ["".join(rng.choice("ab<>PSM\n\né") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no\nid"), (None, "no\nid"), (3, "another\ntext\nof an id"), (-5, "negative\nid")]
    out = infilling.fill_in_middle(spark.createDataFrame(rows, DOCS), ("text",), seed, rate, spm_rate)
    got = out.withColumn("back", infilling.restored(F.col("output"), F.col("form"))).collect()
    want = [(i, *plain(i, t, seed, rate, spm_rate)) for i, t in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[-1], r[1])
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got), key=key) == sorted(want, key=key)
    assert all(r["back"] == (r["text"] or "") for r in got)


def test_chunks_of_any_size_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(infilling, "CHUNK", 40)
    rows = [(i, t) for i, t in enumerate(TEXTS[:-2])]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("n", "form", "output", "units", "batch", "h", "lang")})
    out = infilling.fill_in_middle(docs, ("lang", "n", "units", "h"))
    assert out.columns == ["doc_id", "lang", "units", "h", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert {r["doc_id"]: r["output"] for r in out.collect()} == {i: plain(i, t)[-1] for i, t in rows}


def test_empty_table(spark):
    assert infilling.fill_in_middle(spark.createDataFrame([], DOCS)).collect() == []
