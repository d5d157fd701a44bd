"""Benchmark decontamination against a plain version, by the broadcast set and by the join."""

import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import _text, decontamination

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text, items, window):
    own, hit, found = words(text), set(), set()
    for item, body in items:
        if item is None or not (w := words(body)):
            continue
        n = min(window, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for p in range(len(own) - n + 1):
            if tuple(own[p : p + n]) in grams:
                hit |= set(range(p, p + n))
                found.add(str(item))
    spans = []
    for p in sorted(hit):
        if spans and spans[-1][1] == p - 1:
            spans[-1][1] = p
        else:
            spans.append([p, p])
    return len(own), [tuple(x) for x in spans], sorted(found)


def cases(seed, window):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "É", "é", "word", "Word", "42", "ß", "日本", "x" * 50]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "--", "\0", "_"]) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, window - 1, window, window + 1, 40]))) for i in range(3, 25)]
    items += [(7, text(30)), (7, items[0][1]), (None, text(20)), (90, None), (91, ""), (92, "?!")]
    docs = [text(rng.choice([0, 1, 5, 30, 200])) for _ in range(60)]
    docs += [f"{docs[i]} {items[i % 20][1].upper()} {docs[i]}" for i in range(40)] + [None, "", "...", "Word", docs[-1], docs[-1]]
    return list(enumerate(docs)) + [(3, "a repeated id"), (None, "no id")], items


def found(rows):
    key = lambda r: (r[0] is None, r[0] or 0, repr(r[1:]))
    return sorted(((r["doc_id"], r["found"]["n_words"], [tuple(s) for s in r["found"]["spans"]], list(r["found"]["items"])) for r in rows), key=key)


@pytest.mark.parametrize("piece", [8, 64, 700])
def test_pieces_of_any_size(monkeypatch, piece):
    monkeypatch.setattr(_text, "PIECE", piece)
    docs, items = cases(1, 4)
    known = decontamination._Set.of(sorted((str(i), decontamination._encoded(t)) for i, t in items if i is not None and t is not None), 4)
    scan = decontamination._scan(type("Shared", (), {"value": known}), 4)
    (got,) = scan(iter([pd.Series([t for _, t in docs], dtype=object)]))
    rows = [(r.n_words, [(s["first"], s["last"]) for s in r.spans], r.items) for r in got.itertuples()]
    assert rows == [plain(t, items, 4) for _, t in docs]


@pytest.mark.parametrize(("most", "window"), [(10**6, 10), (10**6, 4), (0, 10), (0, 4)])
def test_equals_the_plain_version(spark, monkeypatch, most, window):
    monkeypatch.setattr(decontamination, "MOST_WORDS", most)
    monkeypatch.setattr(decontamination, "FILTER_BITS", 1 << 16)
    docs, items = cases(window, window)
    frame = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit("x") for c in ("k", "l", "_k0", "_l0", "found", "n", "item", "h", "first")})
    out = decontamination.hits(frame, spark.createDataFrame(items, ITEMS).withColumn("item", F.lit("y")), window)
    key = lambda r: (r[0] is None, r[0] or 0, repr(r[1:]))
    assert out.columns == [*(c for c in frame.columns if c != "found"), "found"]
    rows = out.collect()
    assert {r["_k0"] for r in rows} == {r["k"] for r in rows} == {"x"}
    assert found(rows) == sorted(((i, *plain(t, items, window)) for i, t in docs), key=key)


def test_spans_are_cut_and_documents_removed(spark):
    item = " ".join(f"w{i}" for i in range(12))
    docs = [(0, f"Clean start; ({item.upper()}), end."), (1, "nothing here"), (2, item), (3, None), (4, ""), (5, item.replace("w3", "v3")), (6, f"é {item}!\n{item} é")]
    frame, items = spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, item)], ITEMS)
    cut = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(frame, items).collect()}
    assert cut == {0: "Clean start; (), end.", 1: "nothing here", 2: "", 3: None, 4: "", 5: docs[5][1], 6: "é  é"}
    kept = lambda share: sorted(r["doc_id"] for r in decontamination.decontaminate(frame, items, "documents", share).collect())
    assert kept(0.0) == [1, 3, 4, 5] and kept(0.9) == [0, 1, 3, 4, 5] and kept(1.0) == list(range(7))
    with pytest.raises(ValueError):
        decontamination.decontaminate(frame, items, "nothing")


@pytest.mark.parametrize("most", [10**6, 0])
def test_empty_tables(spark, monkeypatch, most):
    monkeypatch.setattr(decontamination, "MOST_WORDS", most)
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b")], DOCS)
    items = spark.createDataFrame([(1, "a b")], ITEMS)
    assert decontamination.hits(none, items).collect() == []
    (row,) = decontamination.hits(some, spark.createDataFrame([], ITEMS)).collect()
    assert row["found"]["n_words"] == 2 and not row["found"]["spans"] and not row["found"]["items"]


def test_a_very_long_text_and_word(spark):
    item = "p q r s t u v w x y z"
    docs = [(0, "ab " * 400_000 + item + " cd" * 300_000), (1, "A" * 3_000_000 + " " + item), (2, "b" * 600_000)]
    items = [(5, item), (6, "a" * 3_000_000), (8, "b" * 599_999)]
    rows = found(decontamination.hits(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect())
    assert rows == [(0, 700_011, [(400_000, 400_010)], ["5"]), (1, 12, [(0, 11)], ["5", "6"]), (2, 1, [], [])]
