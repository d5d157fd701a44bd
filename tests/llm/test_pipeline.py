"""The pipeline's stages and its whole result against brute-force versions of every decision."""

import corpus_pipeline
import numpy as np
import plain
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tallyloom.llm import packing, quality, toxicity

KEYS = ["doc_id", "text", "source"]


def expected(spark, rows, labels):
    """What each stage keeps of rows (doc_id, text, source): lists of such rows, and the lengths of the packed pieces.

    The learned weights are the operators'; every score, link, share and piece is worked out anew from whole texts.
    """
    out = {}
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, source string")
    grammar, curve = toxicity.learned(frame(rows), labels)
    rows = [r for r in rows if plain.logistic(float(np.dot(plain.toxic_features(grammar, r[1]), curve))) < 0.5]
    out["toxicity"] = rows
    model, curve = quality.learned(frame(rows), labels)
    logit = lambda q: np.log(min(max(q, 1e-6), 1 - 1e-6) / (1 - min(max(q, 1e-6), 1 - 1e-6)))
    score = lambda t: curve[0] if model is None else curve[0] + curve[1] * logit(plain.document_quality(model, t))
    rows = [r for r in rows if plain.logistic(float(score(r[1]))) >= 0.3]
    out["quality"] = rows
    root = plain.components({r[0]: r[1] for r in rows})
    rows = [r for r in rows if root[r[0]] == r[0]]
    out["near_dedup"] = rows
    mixed = []
    for n, k in plain.mix(rows).items():
        words = plain.WORD.findall(rows[n][1] or "")
        mixed += [(rows[n][0], rows[n][1] if m == len(words) else " ".join(words[:m]), rows[n][2]) for m in plain.repeats(words, k)]
    out["mixing"] = mixed
    return out


def key(rows):
    return sorted(map(tuple, rows), key=repr)


def test_run_equals_a_plain_version(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = expected(spark, [tuple(r) for r in docs.select(*KEYS).collect()], spark.read.parquet(f"{DATA}/labels.parquet"))
    kept = docs.withColumns({c: F.lit("x") for c in ("score", "taken", "predicted", "epoch", "component_id")})
    columns = kept.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.written(stage(spark, kept, DATA), "test")
        assert kept.columns == columns
        assert key(kept.select(*KEYS).collect()) == key(want[name]), name
    assert len(want["toxicity"]) < 200 and len(want["quality"]) < len(want["toxicity"]) and len(want["near_dedup"]) < len(want["quality"])

    packed = corpus_pipeline.run(spark, DATA).toPandas()
    pieces = sorted((i, p, min(4096, n - p)) for i, t, _ in want["mixing"] for n in [len(plain.WORD.findall(t or ""))] for p in range(0, max(n, 1), 4096))
    assert sorted(zip(packed.doc_id, packed.first_word, packed["length"], strict=True)) == pieces
    lengths = np.sort(packed["length"][packed["length"] > 0].to_numpy())[::-1]
    used = packed[packed["length"] > 0].groupby("bin_id")["length"].sum()
    assert sorted(used) == sorted(plain.best_fit(lengths.tolist(), packing.best_plan(lengths), packing.CAPACITIES).elements())
    assert (used <= packed[packed["length"] > 0].groupby("bin_id")["capacity"].first()).all()


@pytest.mark.parametrize("rows", [[], [(None, None, None)], [(1, None, "a"), (1, "", "a"), (2, "one two three four five six", None), (2, "one two three four five six", None), (3, "w " * 9000, "b"), (None, "no id at all here", "b"), (None, None, None)]])
def test_stages_take_nulls_repeats_and_empty_tables(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(1) for c in ("size", "held_out", "kept", "_x")})
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(stage(spark, docs, DATA), "test")
        if name != "packing":
            assert out.columns == docs.columns
            docs = out
        if name == "near_dedup" and len(rows) > 2:
            kept = out.select("doc_id", "text").collect()
            assert sum(r["doc_id"] is None for r in kept) == sum(r["doc_id"] is None for r in before)
            assert all(sum(r["doc_id"] == i for r in kept) <= 2 for i in (1, 2, 3))
        before = out.collect()
