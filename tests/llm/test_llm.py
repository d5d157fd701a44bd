"""The operators of the subpackage on small cases, against brute force and against DuckDB."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import plain
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tallyloom.llm import ann, chat_format, exact_topk, licenses, mixing, near_dedup, packing, quality, queries, toxicity, warc
from tallyloom.llm import _text
from tallyloom.llm._text import shingle_sets
from tallyloom.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("score", "kept", "size", "bucket", "key", "id", "label", "rank", "piece", "words", "digest", "y")


def docs(spark, texts, sources=None, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", None if sources is None else sources[i], 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("x") for c in CLASH})


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_duckdb(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), c.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda df: sorted((tuple(None if v is None or v != v else round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in df[sorted(got.columns)].astype(object).where(df[sorted(got.columns)].notna(), None).itertuples(index=False)), key=repr)
    numbers = [c for c in got.columns if str(want[c].dtype) != "object" and str(want[c].dtype) != "str"]
    for df in (got, want):
        df[numbers] = df[numbers].astype("float64")
    assert plain(got) == plain(want)


def test_shingles_of_whole_texts():
    long = "w " * 700_000  # over the size of a hashed piece
    sets = dict(shingle_sets(["A b c d e f", "a B c d e\tF", "", None, "x y", "x  y", "x y z", long, "a b c d e f g"]))
    assert (sets[0] == sets[1]).all() and len(sets[0]) == 2
    assert len(sets[2]) == len(sets[3]) == 0
    assert (sets[4] == sets[5]).all() and len(sets[4]) == 1 and sets[4][0] != sets[6][0]
    assert len(sets[7]) == 1
    assert set(sets[0]) < set(sets[8])


def test_words_are_hashed_alike_in_pieces_of_any_size(monkeypatch):
    texts = [noise(i, n) for i, n in enumerate((3, 40, 900))] + ["x" * 999, " " * 999, "a" * 500 + " " + "b" * 500, "é" * 333]
    want = [x.tolist() for _, x in _text.word_hashes(texts)]
    for piece in (7, 64, 500):
        monkeypatch.setattr(_text, "PIECE", piece)
        assert [x.tolist() for _, x in _text.word_hashes(texts)] == want


def brute_components(texts):
    return plain.components(dict(enumerate(texts)))


def test_very_long_texts_link_at_exactly_the_threshold(spark):
    """240,000 common shingles, and 40,000 of each text's own: 0.75 exactly; one more of its own, and there is no link."""
    common = " ".join(f"c{i}" for i in range(240_004))
    long = [common + "".join(f" {name}{i}" for i in range(n)) for name, n in (("a", 40_000), ("b", 40_000), ("d", 40_002), ("e", 40_001))]
    near_dedup_rows = near_dedup.near_duplicates(docs(spark, [long[0], long[1], "x y", long[3]])).collect()
    assert {r["doc_id"]: r["component_id"] for r in near_dedup_rows} == {0: 0, 1: 0, 2: 2, 3: 3}
    assert {r["doc_id"]: r["n_shingles"] for r in near_dedup_rows} == {0: 280_000, 1: 280_000, 2: 1, 3: 280_001}


def test_a_crowd_of_one_template_loses_no_link(spark, monkeypatch):
    """700 texts of 96 common shingles of 120 (0.667 between any two); 90 pairs among them share 104 (0.765)."""
    monkeypatch.setattr(near_dedup, "CROWD", 32)
    monkeypatch.setattr(near_dedup, "BLOCK", 100)
    template = " ".join(f"t{i}" for i in range(100))
    texts = [template + "".join(f" u{i}x{k}" for k in range(24)) for i in range(700)]
    for i in range(90):
        texts[699 - i] = template + "".join(f" u{i}x{k}" if k < 8 else f" v{i}x{k}" for k in range(24))
    rows = docs(spark, texts).withColumns({c: F.lit(0) for c in ("low", "high", "region", "component")})
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(rows).collect()}
    assert got == {i: min(i, 699 - i) if i < 90 or i >= 610 else i for i in range(700)}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(25):
        base = sentence(rng, rng.choice([3, 6, 30, 120])).split()
        for _ in range(rng.choice([1, 1, 4, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 3])):
                w[rng.randrange(len(w))] = sentence(rng, 1)
            texts.append(" ".join(w))
    texts += ["", None, " \t", texts[0], texts[0].upper()]
    got = near_dedup.near_duplicates(docs(spark, texts)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(texts)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_edges(spark):
    same = "a b c d e f g h"
    got = near_dedup.near_duplicates(docs(spark, [same, same, same, None, "other words here"], ids=[5, 5, None, None, 2])).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1, r["kept"]) for r in got) == [(-1, 0, -1, True), (-1, 4, -1, True), (2, 1, 2, True), (5, 4, 5, True), (5, 4, 5, True)]
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_components_of_a_chain_and_repeats(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(3, 3), (None, 1), (100, 101), (101, 100)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(links.where("a > 1000")).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_exact_top_k_edges(spark):
    rows = [(i, [float(v) for v in np.random.default_rng(i % 40).normal(size=8)], 0) for i in range(120)]
    rows += [(200, None, 0), (201, [None] * 8, 0), (202, [float("nan")] * 8, 0), (203, [float("inf")] * 8, 0), (None, [1.0] * 8, 0), (250, [], 0), (7, rows[7][1], 0)]
    v = exact_topk.whole_vectors(vectors(spark, rows).withColumn("v", F.lit(1)), "vec_id", "embedding", 256)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in exact_topk.exact_top_k(v, v.where("id % 10 = 0"), 5).collect())
    ints = {i: np.floor(256 * np.float32(e).astype(float)).astype(int) for i, e, _ in rows[:120]}
    want = []
    for q in range(0, 120, 10):
        best = sorted(((-int(ints[q] @ ints[c]), c) for c in ints if c != q))[:5]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert got == sorted(want)
    few = vectors(spark, [(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0)])
    v = exact_topk.whole_vectors(few, "vec_id", "embedding", 256)
    assert exact_topk.exact_top_k(v, v.where("id = 0"), 5).count() == 1
    assert exact_topk.exact_top_k(v.where("id > 9"), v.where("id > 9"), 5).count() == 0


def test_exact_top_k_of_large_components_ties_and_repeats(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4) * 10.0 ** rng.integers(-2, 38 if i % 3 == 0 else 3)], 0) for i in range(200)]
    rows += [(0, [70000.0, 1.0, 0.0, 0.0], 0), (1, [70000.0, 1.0, 0.0, 0.0], 0), (7, [3e37, 1.0, 2.0, -5.0], 0), (8, [1.0, 2.0], 0), (9, [2.0, 1e30], 0)]
    rows += [(300 + i, [1.0, 1.0, 1.0, 1.0], 0) for i in range(30)]  # ties
    v = exact_topk.whole_vectors(vectors(spark, rows).withColumns({c: F.lit(1) for c in ("id", "v", "same", "file")}), "vec_id", "embedding", 256)
    got = sorted(tuple(r) for r in exact_topk.exact_top_k(v, v.where("id % 3 = 0"), 5).select("query_id", "rank", "vec_id", "score").collect())
    ints = [(i, [math.floor(256 * float(np.float32(x))) for x in e]) for i, e, _ in rows]
    want, most = [], (1 << 63) - 1
    for q in sorted({i for i, _ in ints if i % 3 == 0}):
        best = {}
        for _, a in (x for x in ints if x[0] == q):
            for j, b in ints:
                if j != q and len(a) == len(b):
                    best[j] = max(sum(x * y for x, y in zip(a, b, strict=True)), best.get(j, -(1 << 999)))
        want += [(q, r + 1, j, max(-most - 1, min(most, s))) for r, (j, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5])]
    assert got == sorted(want)


def test_nearest_with_hundreds_of_lists_a_hot_vector_and_several_sizes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 24))
    x = (centres[rng.integers(0, 60, 3000)] + 0.5 * rng.normal(size=(3000, 24))).astype(np.float32).astype(float)
    x[1500:2400] = x[0]  # almost a third of all rows are one vector
    rows = [(i, x[i].tolist(), 0) for i in range(3000)] + [(20, x[777].tolist(), 0), (4000, [1.0, 2.0], 0), (4020, [2.0, 1.0], 0), (None, x[1].tolist(), 0)]
    v = ann.usable_vectors(vectors(spark, rows).withColumns({c: F.lit(1) for c in ("id", "v", "list", "block")}), "vec_id", "embedding")
    monkeypatch.setattr(ann, "lists_for", lambda n: n // 8)
    lists = []
    graph = ann.Graph
    monkeypatch.setattr(ann, "Graph", lambda c: lists.append(len(c)) or graph(c))
    got = ann.nearest(v, v.where("id % 20 = 0"), 20).toPandas()
    assert max(lists) >= 300
    hits = asked = 0
    for q in range(0, 3000, 20):
        own = [x[q], x[777]] if q == 20 else [x[q]]
        s = np.max([x @ y for y in own], axis=0)
        s[20] = max(s[20], *(float(x[777] @ y) for y in own))
        s[q] = -np.inf
        found = got[got.query_id == q].sort_values("rank")
        assert found["rank"].tolist() == list(range(1, 21)) and np.allclose(found.score, s[found.vec_id]) and found.vec_id.is_unique
        order = np.lexsort((np.arange(3000), -np.round(s, 9)))[:20]
        hits += len(set(found.vec_id) & set(order.tolist()))
        asked += 20
    assert hits / asked >= 0.9
    assert got[got.query_id == 4000][["rank", "vec_id", "score"]].values.tolist() == [[1, 4020, 4.0]]


def test_recall_of_the_query_on_the_driver_table(spark, monkeypatch):
    got = ann.op7_posting_lists(spark, DATA).toPandas()
    e = spark.read.parquet(f"{DATA}/embeddings.parquet").toPandas().sort_values("vec_id")
    x, ids = np.stack(e.embedding.to_list()).astype(float), e.vec_id.to_numpy()
    hits = asked = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        want = ids[np.lexsort((ids, -s))[:20]]
        own = got[got.query_id == ids[i]]
        assert np.allclose(own.score, s[np.searchsorted(ids, own.vec_id)])
        hits, asked = hits + len(set(own.vec_id) & set(want)), asked + 20
    assert asked == 500 and hits / asked >= 0.9


def test_every_centroid_is_reached_through_the_graph():
    rng = np.random.default_rng(0)
    g = ann.Graph(rng.normal(size=(500, 6)))
    x = rng.normal(size=(50, 6))
    all_lists, dist = g.search(x, 500)
    assert (np.sort(all_lists, axis=1) == np.arange(500)).all() and (np.diff(dist, axis=1) >= 0).all()
    near, _ = g.search(x, 4)
    assert np.mean([len(set(a[:4]) & set(b[:4])) / 4 for a, b in zip(near, all_lists, strict=True)]) > 0.95
    within, d = g.search(x, 1, 1.2)
    want = dist <= dist[:, :1] * 1.2 + 1e-12
    assert np.mean([(within[i] >= 0).sum() / want[i].sum() for i in range(50)]) > 0.95 and (d[np.isfinite(d)] > 0).all()


def test_nearest_neighbours_recall_and_edges(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16))
    rows = [(i, x[i].astype(np.float32).tolist(), 0) for i in range(1500)] + [(5000, [0.0] * 16, 0), (5020, None, 0), (5040, [float("nan")] * 16, 0)]
    v = ann.usable_vectors(vectors(spark, rows), "vec_id", "embedding")
    got = ann.nearest(v, v.where("id % 20 = 0"), 20).toPandas()
    x = x.astype(np.float32).astype(float)
    hits = 0
    for q in range(0, 1500, 20):
        s = x @ x[q]
        s[q] = -np.inf
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and (np.diff(own.score) <= 0).all()
        assert np.allclose(own.score, s[own.vec_id])
        hits += len(set(own.vec_id) & set(np.argsort(-s)[:20]))
    assert hits / (75 * 20) >= 0.9
    few = v.where("id < 5")
    assert ann.nearest(few, few.where("id = 0"), 20).count() == 4
    assert ann.nearest(few.where("id > 9"), few, 20).count() == 0


def test_mix_takes_each_budget_exactly(spark):
    rng = random.Random(1)
    texts = [sentence(rng, rng.randint(0, 30)) for _ in range(300)] + [None, ""]
    sources = [rng.choice(["a", "b", "b", "b", "c", None]) for _ in texts]
    d = docs(spark, texts, sources)
    got = mixing.mix(d).toPandas()
    sizes = got["size"].sum()
    each = got.groupby(got["source"].fillna("~")).agg(s=("size", "sum"), t=("target", "first"), k=("taken", "sum"))
    assert (each.k == np.floor(each.t)).all() and (each.t <= 3 * each.s + 1e-6).all() and abs(each.t.sum() - sizes) < 1e-6
    assert (got.taken <= 3 * got["size"]).all()
    again = mixing.mix(d.repartition(7)).toPandas()
    assert sorted(got[["doc_id", "taken"]].itertuples(index=False)) == sorted(again[["doc_id", "taken"]].itertuples(index=False))
    assert mixing.mix(d.where("doc_id < 0")).count() == 0
    assert [r["taken"] for r in mixing.mix(docs(spark, [None, ""], ["a", "b"])).collect()] == [0, 0]


def test_mix_equals_a_plain_version(spark):
    rng = random.Random(2)
    rows = [(rng.choice([i, i, 7, None]), rng.choice([sentence(rng, rng.randint(0, 40)), None, "", " \t"]) if i % 5 == 0 else sentence(rng, rng.randint(1, 40)), rng.choice(["a", "b", "b", "b", "c", "d", None])) for i in range(250)]
    rows.append((900, "w " * 60_000, "b"))
    frame = spark.createDataFrame([(i, t, "en", s, n) for n, (i, t, s) in enumerate(rows)], DOCS).withColumns({c: F.lit("x") for c in CLASH if c != "n_chars"})
    got = {r["n_chars"]: r["taken"] for r in mixing.mix(frame, ("n_chars",)).collect()}
    want = plain.mix(rows)
    # Rows that repeat each other wholly are interchangeable.
    total = lambda taken: Counter((rows[n], k) for n, k in taken.items())
    assert total(got) == total(want)


def test_packing_equals_slow_best_fit():
    rng = np.random.default_rng(4)
    lengths = np.sort(rng.integers(1, 4097, 400))[::-1]
    for plan in ((4096,) * 5, (512, 1024, 1024, 2048, 4096), packing.best_plan(lengths)):
        bins, starts, sizes = packing.pack_lengths(lengths, plan)
        used = np.bincount(bins, lengths)
        assert Counter(used.astype(int).tolist()) == plain.best_fit(lengths.tolist(), plan, packing.CAPACITIES)
        assert (used <= sizes).all() and all(not any(u <= c < s for c in packing.CAPACITIES) for u, s in zip(used, sizes, strict=True))
        for b in range(len(sizes)):
            own = np.argsort(starts[bins == b])
            assert (np.cumsum(lengths[bins == b][own])[:-1] == starts[bins == b][own][1:]).all()


def test_several_lengths_are_planned_jointly():
    rng = np.random.default_rng(5)
    lengths = np.sort(np.clip(rng.lognormal(5.5, 1.2, 5000), 1, 4096).astype(int))[::-1]
    plan = packing.best_plan(lengths)
    sizes = packing.pack_lengths(lengths, plan)[2]
    one = packing.pack_lengths(lengths, (4096,) * 5)[2]
    assert packing.bin_cost(sizes).sum() < 0.95 * packing.bin_cost(one).sum()
    in_middle = sizes[len(sizes) // 4 : 3 * len(sizes) // 4]
    assert len(set(in_middle.tolist())) >= 2 and len(set(sizes.tolist())) >= 4
    assert packing.best_plan(np.array([5])) == (256, 4096, 4096, 4096, 4096) or packing.pack_lengths(np.array([5]), packing.best_plan(np.array([5])))[2].tolist() == [256]


def test_shares_stay_bounded_whatever_repeats(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARE_ROWS", 50)
    sizes = []
    step = packing._pack

    def watched(capacities):
        pack = step(capacities)
        return lambda key, pdf: (lambda out: out.assign(capacity=len(pdf)))(pack(key, pdf))

    monkeypatch.setattr(packing, "_pack", watched)
    rows = packing.best_fit(docs(spark, ["a b c"] * 300 + ["x " * 20] * 100, ids=[None] * 300 + [7] * 100)).toPandas()
    sizes = rows.capacity.tolist()
    assert len(rows) == 400 and rows["length"].sum() == 300 * 3 + 100 * 20 and max(sizes) < 100


def test_packing_covers_every_word_once(spark):
    texts = ["w " * 10_000, "a b c", None, " ", "a b c", "x"]
    rows = packing.best_fit(docs(spark, texts, ids=[1, 2, 3, 4, 2, None])).toPandas()
    assert rows["length"].sum() == 10_007 and len(rows) == 8
    assert rows[rows["length"] == 0].bin_id.isna().all()
    big = rows[rows.doc_id == 1].sort_values("piece")
    assert big.first_word.tolist() == [0, 4096, 8192] and big["length"].tolist() == [4096, 4096, 1808]
    assert packing.best_fit(docs(spark, [])).count() == 0


def test_chain_field_marginals_equal_enumeration():
    model = quality.ChainField(3)
    rng = np.random.default_rng(0)
    model.w, model.step = rng.normal(size=3), rng.normal(size=(2, 2))
    x = rng.normal(size=(4, 3))
    odds = x @ model.w
    weight = {}
    for path in np.ndindex(2, 2, 2, 2):
        weight[path] = np.exp(sum(odds[i] for i in range(4) if path[i]) + sum(model.step[path[i], path[i + 1]] for i in range(3)))
    length = np.array([1.0, 2.0, 3.0, 4.0])
    good = [sum(w for p, w in weight.items() if p[i]) / sum(weight.values()) for i in range(4)]
    assert np.isclose(model.quality([(x, length), (x[:2], length[:2])])[0], (np.array(good) * length).sum() / 10)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    texts, rows = [], []
    for i in range(400):
        bad, toxic = i % 4 == 0, i % 5 == 0
        lines = [sentence(rng, 9) + "." for _ in range(4)]
        if bad:
            lines = [" ".join(w + "###" for w in x.split()) for x in lines]
        if toxic:
            lines[1] = f"you {rng.choice(['zorgish', 'zorgum', 'zorgle'])} {lines[1]} zorgan"
        texts.append("\n".join(lines))
        rows.append((i, int(not bad), int(toxic)))
    texts += [None, "", "\n\n", "word"]
    return docs(spark, texts), spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("score", "column"), [(quality.score_quality, "quality"), (toxicity.score_toxicity, "toxic")])
def test_classifiers_on_held_out_rows(labelled, score, column):
    d, labels = labelled
    got = score(d, labels).join(labels, "doc_id", "left").toPandas()
    assert len(got) == 404 and got.score.between(0, 1).all()
    held = got[got.held_out & got[column].notna()]
    assert len(held) > 40 and (held.predicted == held[column]).mean() > 0.95
    assert score(d.where("doc_id < 0"), labels).count() == 0
    alone = score(d.limit(5), labels.where("doc_id < 0")).toPandas()
    assert len(alone) == 5 and alone.score.nunique() == 1


def test_held_out_labels_are_not_read(labelled):
    d, labels = labelled
    from tallyloom.llm._common import held_out

    flipped = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.score_toxicity(d, x).select("doc_id", "score").collect())) for x in (labels, flipped))
    assert a == b


def test_grammar_weighs_clauses():
    g = toxicity.Grammar(toxicity._hash_words("zorg"), np.array([3.0]))
    same, target, after, negated, reported, none = g.features(["a zorg", "you zorg", "zorg you", "not a zorg", "he said zorg", "nothing"])[:, 1]
    assert after == target > same > reported > negated > none == 0
    assert g.features(["not zorg you"])[0, 1] == negated  # what is softened isn't raised
    far = g.features(["you a b c d e f g h i zorg"])[0, 1]
    apart = g.features(["not. zorg"])[0, 1]
    assert far == same == apart
    threats = g.features(["I will kill you", "to kill time", "you said kill", "kill. you", "you kill"])[:, 5]
    assert threats.tolist() == [np.log1p(1), 0, 0, 0, np.log1p(1)]


WORDS = ["you", "zorg", "zorgish", "not", "kill", "said", "bla", "du", "x" * 300, "é" * 200, "isn't", "töten", "ZORG"]


def noise(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice(WORDS) + rng.choice([" ", "\n", ". ", ",", " ! ", " ", "", " # "]) for _ in range(n))


def test_toxic_features_equal_a_plain_version_in_pieces_of_any_size(monkeypatch):
    long = "é" * 400 + "y" * 900  # told apart by its last byte alone
    lexicon = np.concatenate((toxicity._hash_words("zorg bla"), next(iter(toxicity.Words(b"kill").beginnings()))[1], toxicity._hash_words(long + "a")))
    g = toxicity.Grammar(lexicon, np.array([3.0, 1.0, 2.0, 5.0]))
    texts = [noise(i, n) for i, n in enumerate((0, 1, 5, 50, 400, 3000))] + [None, "", "\n", "you zorg and more", "x" * 2000 + " you zorg"]
    texts += [f"you {long}a", f"you {long}b", f"{long.upper()}A you. {long}b {long}a", long + "a", f"{long}aa, you zorg"]
    assert [x > 0 for x in g.features(texts[-5:])[:, 1]] == [True, False, True, True, True]
    want = np.array([plain.toxic_features(g, t) for t in texts])
    for piece in (7, 64, 300, 1000, 5000, 1 << 18):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        assert np.allclose(g.features(texts), want, rtol=1e-12, atol=1e-12)


def test_line_features_equal_a_plain_version_in_pieces_of_any_size(monkeypatch):
    rng = random.Random(3)
    texts = ["\n".join(" ".join(rng.choice(["ab", "Ab", "x#", "1|2", "!", "é", "c."]) for _ in range(rng.randint(0, 12))) + rng.choice(["", " ", "\r", "\t"]) for _ in range(n)) for n in (0, 1, 2, 9, 60)]
    texts += [None, "", "\n\n", " \n x", "one line " * 400, "y" * 900 + "\n" + "y" * 900]
    texts += ["Y1|" * 300 + " " + "y1|" * 300 + " z\n", "a\t" + "é#" * 500 + "\r\n" + "b" * 41 + "\tb b!", " " + "w." * 77, "q" * 3000]
    for piece in (7, 40, 41, 150, 1000, 1 << 18):
        monkeypatch.setattr(quality, "_PIECE", piece)
        for (x, n), t in zip(quality.line_features(texts), texts, strict=True):
            want, length = plain.line_features(t)
            assert np.allclose(x, want, atol=1e-12) and (n == length).all()


@pytest.mark.parametrize("name", ["op5_line_quality", "op9_clause_grammar"])
def test_query_scores_equal_a_plain_version(spark, name):
    """Every score of the query from the learned model by the plain features of the whole text."""
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    docs_, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    if name.startswith("op5"):
        model, curve = quality.learned(docs_, labels)
        logit = lambda q: np.log(min(max(q, 1e-6), 1 - 1e-6) / (1 - min(max(q, 1e-6), 1 - 1e-6)))
        want = {i: plain.logistic(curve[0] + curve[1] * logit(plain.document_quality(model, t))) for i, t in rows.items()}
        least = 0.3
    else:
        grammar, curve = toxicity.learned(docs_, labels)
        want = {i: plain.logistic(float(np.dot(plain.toxic_features(grammar, t), curve))) for i, t in rows.items()}
        least = 0.5
    got = queries.QUERIES[name](spark, DATA).toPandas()
    assert set(got.doc_id) == set(want) and len(got) == len(want)
    for r in got.itertuples():
        assert abs(r.score - want[r.doc_id]) < 1e-6 and r.predicted == int(r.score >= least)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    again = queries.QUERIES[name](spark, DATA).toPandas()
    assert sorted(zip(again.doc_id, again.score, strict=True)) == sorted(zip(got.doc_id, got.score, strict=True))


@pytest.mark.parametrize(("score", "column"), [(quality.score_quality, "quality"), (toxicity.score_toxicity, "toxic")])
def test_classifiers_take_repeated_rows_and_clashing_columns(labelled, score, column):
    d, labels = labelled
    first = d.where("doc_id < 60")
    other = first.where("doc_id < 9").withColumn("text", F.lit("you zorgish\nyou zorgum zorgan of the same id"))
    twice = first.unionByName(other).unionByName(first.where("doc_id = 3")).unionByName(first.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    a, b = (sorted(map(tuple, score(x, labels).select("doc_id", "score", "predicted").collect()), key=repr) for x in (twice, twice.repartition(5)))
    assert a == b and len(a) == 60 + 9 + 1 + 1
    assert len({x for x in a if x[0] == 3}) == 2 and sum(x[0] == 3 for x in a) == 3


def test_licences(spark):
    grant = "This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation"
    texts = [
        "x\nReleased under the  mit licence.\ny", "RELEASED UNDER THE MIT LICENSE", None, "", "the license", "Licensed under the Apache License, Version 2.0.\r\nReleased under the MIT License.",
        f"/*\n * {grant} */", "All pictures on this page that we took are licensed under CC BY-NC 4.0. Thanks.", "Our tools are free. Released\nunder the\nMIT License. See the site for more.", "w " * 300_000 + "All rights\nreserved.", "und für über MIT ß",
    ]
    rows = docs(spark, texts + ["All rights reserved."] * 2, ids=[*range(len(texts)), 50, 50])
    got = {r["doc_id"]: (r["license"], r["first_word"], r["matches"]) for r in licenses.scan_licenses(rows.withColumns({c: F.lit(1) for c in ("k", "l", "w", "at", "gram", "name")})).collect()}
    none = (None, None, 0)
    assert got == {
        0: ("MIT", 1, 1), 1: ("MIT", 0, 1), 2: none, 3: none, 4: none, 5: ("Apache-2.0", 0, 2), 6: ("GPL-grant", 0, 3), 7: ("CC-BY-NC-4.0", 9, 1),
        8: ("MIT", 4, 1), 9: ("Proprietary", 300_000, 1), 10: none, 50: ("Proprietary", 0, 1),
    }
    assert licenses.scan_licenses(rows).where("doc_id = 50").count() == 2
    tie = licenses.scan_licenses(rows.where("doc_id = 1"), templates={"b": "Released under the MIT License", "a": "released under the mit license"}).first()
    assert (tie["license"], tie["dice"], tie["matches"]) == ("a", 1.0, 2)
    assert licenses.scan_licenses(docs(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_windows_equal_all_windows(spark, seed):
    """Texts of few words, so that bigrams repeat: every window of the template's length, counted by hand."""
    rng = random.Random(seed)
    templates = {"t": "a b a b c a b", "u": "c c c a", "v": "b a c b b a c b"}
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 40))) for _ in range(80)]
    want = {}
    for i, text in enumerate(texts):
        w, found = text.split(), []
        for name, template in sorted(templates.items()):
            own = Counter(licenses.bigrams_of(template))
            n = sum(own.values())
            for p in range(len(w) - 1):
                window = Counter(f"{x} {y}" for x, y in zip(w[p : p + n], w[p + 1 : p + n + 1], strict=False))
                if f"{w[p]} {w[p + 1]}" in own:
                    found.append((-2.0 * sum((window & own).values()) / (sum(window.values()) + n), name, p))
        found = [f for f in found if f[0] <= -0.7]
        want[i] = (min(found)[1], round(-min(found)[0], 9), min(found)[2], len({f[1] for f in found})) if found else (None, None, None, 0)
    got = licenses.scan_licenses(docs(spark, texts), templates=templates).collect()
    assert {r["doc_id"]: (r["license"], None if r["dice"] is None else round(r["dice"], 9), r["first_word"], r["matches"]) for r in got} == want


def test_chats_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nx", "a <\\|b <\\\\| c", None, "", "<<SYS>> \\n [\\INST]", "w " * 600]
    rows = [(1, 0, "system", "be kind")] + [(1, i + 1, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(nasty)]
    rows += [(2, None, "assistant", "x"), (2, 0, "to\nol", "y"), (2, 0, "to\nol", "y"), (None, 1, None, "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("span", "at", "words")})
    windows = chat_format.format_chats(turns)
    got = {r["conv_id"]: r for r in chat_format.read_back(windows).collect()}
    for conv in (1, 2, None):
        own = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv))
        text = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert (got[conv]["n_turns"], got[conv]["turns_sha256"]) == (len(own), hashlib.sha256(text.encode()).hexdigest())
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    many = windows.where("conv_id = 1").orderBy("window").collect()
    assert len(many) > 1 or many[0]["repeated"] == 0
    assert all(w["formatted"].startswith("<|im_start|>system") for w in many)
    assert chat_format.read_back(chat_format.format_chats(turns.where("conv_id > 9"))).count() == 0


def test_windows_keep_their_budget(spark):
    rng = random.Random(1)
    rows = []
    for c in range(40):
        if c % 2:
            rows.append((c, 0, "system", "s " * rng.choice([3, 60, 200, 400])))
        rows += [(c, k + 1, rng.choice(["user", "assistant"]), "w " * rng.choice([0, 1, 10, 40, 100, 100, 250, 600])) for k in range(rng.randint(1, 40))]
    rows += [(99, k, ("user", "assistant")[k % 2], f"turn {k} " + "x " * (k % 30)) for k in range(3000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat_format.format_chats(turns, 256, 2).toPandas()
    words, messages = windows.formatted.map(lambda x: len(plain.WORD.findall(x))), windows.formatted.map(lambda x: x.count("<|im_start|>"))
    new = messages - windows.repeated - (windows.formatted.str.startswith("<|im_start|>system") & (windows.window == 0))
    assert (new[words > 256] <= 1).all() and (words <= 256).mean() > 0.7
    over = windows[(words > 256) & windows.formatted.str.startswith("<|im_start|>system")]
    assert (over.repeated <= 1).all()  # the system turn, and no history on top
    full = windows[(windows.window > 0) & (windows.conv_id == 99)]
    assert (full.repeated >= 1).mean() > 0.9 and full.repeated.max() == 2
    long = chat_format.read_back(chat_format.format_chats(turns.where("conv_id = 99"))).first()
    assert long["n_turns"] == 3000 and long["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for c, _, r, t in rows if c == 99).encode()).hexdigest()
    alone = chat_format.format_chats(turns.where("conv_id = 1"), 256, 0).toPandas()
    assert set(alone[alone.window > 0].repeated) <= {1}


def test_warc_round_trip(spark, tmp_path):
    big = "äx" * 150_000
    rows = [(1, "http://a", "same"), (2, "http://b", "same"), (3, "u\r\nrl", None), (4, None, ""), (5, "c", big), (6, "d", "only\r\n\r\nWARC/1.1\r\n"), (7, "e", big), (8, "f", big + "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(0) for c in ("digest", "bytes", "chunk", "salt")})
    warc.write_archive(pages, str(tmp_path / "w"))
    got = {r["page_id"]: r for r in warc.read_archive(spark, str(tmp_path / "w")).collect()}
    for i, _, html in rows:
        data = (html or "").encode()
        assert got[i]["payload_bytes"] == len(data)
        assert got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items() if r["record_type"] == "revisit"} == {1: ("revisit", 2), 3: ("revisit", 4), 5: ("revisit", 7)}
    table = spark.read.parquet(str(tmp_path / "w"))
    assert table.agg(F.max(F.length("data"))).first()[0] < warc.CHUNK + 2000 and table.where("chunks > 1").count() >= 10
    warc.write_archive(pages, str(tmp_path / "all"), min_bytes=1 << 40)
    assert {r["record_type"] for r in warc.read_archive(spark, str(tmp_path / "all")).collect()} == {"response"}
    again = spark.createDataFrame([(1, "a", "p"), (1, "b", "p"), (None, "c", "p"), (None, "d", "own"), (2, None, big), (2, None, big), (1, "e", big)], "page_id long, url string, html string")
    warc.write_archive(again, str(tmp_path / "again"))
    rows = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_archive(spark, str(tmp_path / "again")).collect()), key=repr)
    assert rows == sorted([(1, "response", None), (1, "response", None), (None, "revisit", 1), (None, "response", None), (2, "response", None), (2, "response", None), (1, "revisit", 2)], key=repr)
    broken = table.where("chunks > 1").withColumn("data", F.when(F.col("chunk") == 1, F.lit(b"zz")).otherwise(F.col("data")))
    broken.unionByName(table.where("chunks = 1")).write.parquet(str(tmp_path / "broken"))
    with pytest.raises(Exception, match="digest|ends before"):
        warc.read_archive(spark, str(tmp_path / "broken")).collect()
    warc.write_archive(pages.where("page_id < 0"), str(tmp_path / "none"))
    assert warc.read_archive(spark, str(tmp_path / "none")).count() == 0


def test_all_members_of_a_crowded_region_meet(spark, monkeypatch):
    """3,000 texts of one region share 96 of 120 shingles with each other (0.667); 60 pairs among them share 104 (0.765)."""
    monkeypatch.setattr(near_dedup, "BLOCK", 400)  # so that the crowd takes many cells
    template = " ".join(f"t{i}" for i in range(100))
    texts = [template + "".join(f" u{i}x{k}" for k in range(24)) for i in range(3000)]
    for i in range(60):
        texts[2999 - i] = template + "".join(f" u{i}x{k}" if k < 8 else f" v{i}x{k}" for k in range(24))
    (sets,) = near_dedup._sets(iter([pd.DataFrame({"doc_id": range(3000), "text": texts})]))
    rows = pd.DataFrame({"region": 7, "id": sets["id"], "component": sets["id"], "n": 3000, "most": 1000, "largest": 1, "fine": sets["fine"], "members": sets["packed"]})
    rows.loc[1000:1999, "component"] = 1  # one large component in the middle
    rows.loc[1, "component"] = 0
    got = near_dedup._across(spark.createDataFrame(rows), 4, 75).collect()
    assert {(min(r), max(r)) for r in got} == {(i, 2999 - i) for i in range(60)}


def test_training_takes_whole_documents_until_there_are_enough_lines(spark, monkeypatch):
    d = docs(spark, [f"line {i}\n" * (40 if i == 3 else 2) + "x###" * (i % 2) for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    seen = []
    fit = quality.ChainField.fit
    monkeypatch.setattr(quality.ChainField, "fit", lambda self, own, y: seen.append([len(x) for x in own]) or fit(self, own, y))
    for most in (1_000_000, 30):
        monkeypatch.setattr(quality, "TRAIN_LINES", most)
        quality.learned(d, labels)
    whole, part = seen
    assert sum(whole) > 100 and 30 <= sum(part) < 30 + 41 and not set(part) - set(whole)


def test_quality_trains_on_all_lines_of_long_texts(spark):
    """Bad texts have junk in their heads and tails only; their middle 80 lines are as clean as those of good ones."""
    rng = random.Random(5)
    texts = []
    for i in range(200):
        lines = [sentence(rng, 6) + "." for _ in range(160)]
        texts.append("\n".join(x if i % 2 or 40 <= k < 120 else " ".join(w + "###" for w in x.split()) for k, x in enumerate(lines)))
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    got = quality.score_quality(docs(spark, texts), labels).toPandas()
    held = got[got.held_out]
    assert len(held) > 10 and (held.predicted == held.doc_id % 2).all()
    assert held.score[held.doc_id % 2 == 1].min() > 0.6 > 0.4 > held.score[held.doc_id % 2 == 0].max()


def test_a_licence_of_thousands_of_words_is_found_whole_and_changed(spark):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(700)}"
    template = [word() for _ in range(4000)]
    changed = [f"x{i}" if i % 40 == 7 else w for i, w in enumerate(template)]  # a hundred words, each in two bigrams
    around = lambda own: " ".join([word() for _ in range(200)] + own + [word() for _ in range(900)])
    texts = [around(template), around(changed), around(template[:1500]), around([]), " ".join(template)]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs(spark, texts), templates={"long": " ".join(template)}).collect()}
    assert [(got[i]["license"], got[i]["first_word"]) for i in range(5)] == [("long", 200), ("long", 200), (None, None), (None, None), ("long", 0)]
    assert got[0]["dice"] == got[4]["dice"] == 1.0 and 0.93 < got[1]["dice"] < 0.96
