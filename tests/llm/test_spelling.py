"""Spelling variants against plain versions, with broadcast shards and in the grid."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import spelling

WORDS, DOCS = "word string, n long", "doc_id long, text string"


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts, times=5):
    near = {w: [x for x in counts if one_apart(w, x)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None
    def root(w):  # noqa: E306
        while form[w] is not None:
            w = form[w]
        return w
    return sorted((w, form[w], root(w), n, len(near[w]), None if form[w] is None else counts[form[w]]) for w, n in counts.items())  # noqa: E305


def random_counts(seed, n, alphabet):
    rng = random.Random(seed)
    return {"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 7))): rng.choice([1, 2, 5, 5, 25, 125, 130, 700, 90_000]) for _ in range(n)}


@pytest.mark.parametrize("alphabet", ["ab", "abcdé", "aÿ日\U0001f600"])
def test_automaton_on_a_trie(alphabet):
    words = sorted(random_counts(1, 400, alphabet))
    trie = spelling.Trie.load(*spelling.Trie.of(words, list(range(1, len(words) + 1))).dump())
    for w in [*words, "", "zzz", alphabet[0] * 8]:
        assert sorted(trie.near(w)) == [(x, i + 1) for i, x in enumerate(words) if one_apart(w, x)]


def test_long_words_of_one_letter_take_linear_time():
    words = sorted("a" * n for n in (6, 99_999, 100_000, 100_001)) + ["a" * 50_000 + "b" + "a" * 49_999]
    trie = spelling.Trie.of(words, [1, 2, 3, 4, 5])
    assert sorted(n for _, n in trie.near("a" * 100_000)) == [2, 4, 5]


@pytest.mark.parametrize("bound", [spelling.MOST_BYTES, 2000])
def test_variants_equal_the_plain_version(spark, monkeypatch, bound):
    monkeypatch.setattr(spelling, "MOST_BYTES", bound)
    monkeypatch.setattr(spelling, "SHARD_WORDS", 64)
    monkeypatch.setattr(spelling, "BLOCK_WORDS", 100)
    counts = random_counts(2, 500, "abc")
    rows = spark.createDataFrame([*counts.items(), (None, 7), ("zero", 0), ("nothing", None)], WORDS).withColumns({c: F.lit("x") for c in ("form", "root", "part", "block", "labels")})
    got = [tuple(r) for r in spelling.variants(rows).collect()]
    assert sorted(got) == plain(counts)


def test_a_chain_of_forms_ends_in_one_root_and_ties_go_to_the_smaller(spark):
    chain = {"abcdef" + "x" * k: 5**k for k in range(11)}
    counts = chain | {"mmmmma": 50, "mmmmmb": 50, "mmmmm": 10, "nnnnna": 49, "nnnnn": 10, "alone": 3}
    got = {r["word"]: tuple(r) for r in spelling.variants(spark.createDataFrame([*counts.items()], WORDS)).collect()}
    assert sorted(got.values()) == plain(counts)
    assert {got[w][2] for w in chain} == {"abcdef" + "x" * 10} and got["mmmmm"][1] == "mmmmma" and got["nnnnn"][1] is None
    assert got["alone"] == ("alone", None, "alone", 3, 0, None)


def test_words_are_counted_over_whole_texts(spark):
    rng = random.Random(5)
    vocabulary = ["Éclair", "éclair", "ÀÉÎÕÜ×", "letter", "LETTER", "lettre", "short", "x", "straße", "naïveté", "a" * 300]
    texts = ["".join(rng.choice(vocabulary) + rng.choice([" ", "1", "_", ".", "\n", "日"]) for _ in range(rng.choice([0, 3, 400]))) for _ in range(120)]
    rows = [*enumerate(texts), (3, texts[5]), (None, texts[6]), (500, None), (501, "")]
    want = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            want[w] += 1
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("id", "run", "word", "n", "h")})
    assert {r["word"]: r["n"] for r in spelling.counted(docs).collect()} == {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}
    assert any(len(w) == 299 for w in want)


def test_empty_tables(spark):
    assert spelling.counted(spark.createDataFrame([], DOCS)).collect() == []
    assert spelling.variants(spark.createDataFrame([], WORDS)).collect() == []
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([], WORDS), times=1)
