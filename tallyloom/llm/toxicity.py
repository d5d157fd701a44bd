"""Toxicity by a weighted finite-state pattern grammar.

A lexicon transducer turns a text's words into insults, threats, targets, negations, reported speech, gaps and clause
ends; its insults are words and word beginnings learned from labelled documents, with their log odds as weights. A
transducer for negation and one for reported speech soften insults and threats, one for targets raises what they pass on;
composed into one they weigh every insult or threat by its clause. The clauses' scores, not isolated words, and the number
of threats with a target give a document's score through a fitted logistic curve.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm._common import drop_written, held_out, table, training_labels, written
from tallyloom.llm._text import _BASE, _LOWER, PIECE, U, _power, mix, shingle_set
from tallyloom.llm.quality import logistic

#: Labelled documents that are trained on at most, learned lexicon entries at most, score from which a text is toxic.
TRAIN_DOCS, LEXICON, TOXIC = 8_000, 2_000, 0.5
#: Lengths in bytes of the word beginnings that may become insults; their least log odds and weighted documents.
STEMS, LEAST_ODDS, LEAST_DOCS = (4, 5, 6, 7), 2.0, 4.0
#: Words after which a context symbol has no more effect.
REACH = 6

# Function words that change what an insult or threat means, in the languages of the corpus.
TARGETS = "you your yours u he she they him her them du dich dir dein ihr euch sie tu te toi ton vous votre tú usted ustedes eres ellos"
NEGATIONS = "not no never isn't aren't nicht kein keine nie ne pas jamais nunca ningún tampoco"
REPORTS = "said says say wrote writes called calls quote quoted according sagte sagt schrieb dit disait écrit dijo dice escribió según"
THREATS = "kill hurt beat destroy shoot stab punch burn töten umbringen verletzen tuer frapper matar golpear"

#: Symbols of the grammar. The first seven are what words and clause ends are; MILD is an insult or threat that its
#: context has softened, ADDRESSED a target that an insult or threat before it meets.
GAP, INSULT, THREAT, TARGET, NEGATION, REPORT, END, MILD, ADDRESSED = SYMBOLS = range(9)


class Transducer:
    """A deterministic weighted transducer: in state i, symbol s leads to step[i][s], puts out out[i][s] and costs a factor weight[i][s]."""

    def __init__(self, states: int):
        self.step = np.tile(np.arange(states)[:, None], len(SYMBOLS))
        self.out = np.tile(np.array(SYMBOLS), (states, 1))
        self.weight = np.ones((states, len(SYMBOLS)))

    def arc(self, state: int, symbol: int, to: int, out: int | None = None, weight: float = 1.0) -> None:
        self.step[state][symbol], self.weight[state][symbol] = to, weight
        self.out[state][symbol] = symbol if out is None else out

    def compose(self, other: Transducer) -> Transducer:
        """What the first puts out the second reads; states are pairs and factors multiply."""
        n = len(other.step)
        both = Transducer(len(self.step) * n)
        for (a, b), s in product(product(range(len(self.step)), range(n)), SYMBOLS):
            passed = self.out[a][s]
            both.arc(a * n + b, s, self.step[a][s] * n + other.step[b][passed], other.out[b][passed], self.weight[a][s] * other.weight[b][passed])
        return both


def softening(symbol: int, insult: float, threat: float) -> Transducer:
    """After `symbol` and until a gap or a clause's end, insults and threats pass as MILD ones of so much weight."""
    t = Transducer(2)
    t.arc(0, symbol, 1)
    for s, weight in ((INSULT, insult), (THREAT, threat), (MILD, insult)):
        t.arc(1, s, 1, MILD, weight)
    for s in (GAP, END):
        t.arc(1, s, 0)
    return t


def addressing(insult: float, threat: float) -> Transducer:
    """Insults and threats with a target in their clause weigh more, whether it stands before or after them.

    State 1 has a target before; 2 and 3 have an insult or threat that the next target will meet.
    """
    t = Transducer(4)
    for state in range(4):
        t.arc(state, TARGET, 1)
        t.arc(state, INSULT, 2)
        t.arc(state, THREAT, 3)
        for s in (GAP, END):
            t.arc(state, s, 0)
    t.arc(1, INSULT, 1, INSULT, insult)
    t.arc(1, THREAT, 1, THREAT, threat)
    t.arc(2, TARGET, 1, ADDRESSED, insult - 1)
    t.arc(3, TARGET, 1, ADDRESSED, threat - 1)
    return t


#: Weights of an insult and a threat with a target, and what a target after a threat adds.
WITH_TARGET, ADDRESSED_THREAT = (1.5, 2.0), 1.0
GRAMMAR = softening(NEGATION, 0.4, 0.2).compose(softening(REPORT, 0.5, 0.4)).compose(addressing(*WITH_TARGET))

_WORD = np.zeros(256, bool)
_WORD[[*range(65, 91), *range(97, 123), 39]] = True
_WORD[128:] = True
_BETWEEN = re.compile(b"[^A-Za-z'\\x80-\\xff]")
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?;\n"]] = True
_WHOLE = U(0xA0761D6478BD642F)


def _sum(data: bytes, at: int, end: int) -> int:
    """The polynomial sum of data[at:end], PIECE bytes at a time."""
    out = 0
    for begin in range(at, end, PIECE):
        raw = np.frombuffer(data[begin : min(begin + PIECE, end)], np.uint8)
        up, _ = _power(len(raw))
        own = int(((_LOWER[raw] + U(1)) * up[: len(raw)]).sum(dtype=np.uint64))
        out = (out + own * pow(_BASE, begin - at, 1 << 64)) % (1 << 64)
    return out


class Words:
    """The words of a buffer of UTF-8 text: starts, ends, hashes of the whole words and of their beginnings.

    rest is the sum and length of what follows of the last word, if the buffer holds its beginning only.
    """

    def __init__(self, buffer: bytes, rest: tuple[int, int] = (0, 0)):
        raw = np.frombuffer(buffer, np.uint8)
        word = _WORD[raw]
        edge = np.diff(np.concatenate(([False], word, [False])).astype(np.int8))
        self.starts = np.flatnonzero(edge == 1)
        self.ends = np.flatnonzero(edge == -1)
        up, self._down = _power(len(raw))
        self._total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((_LOWER[raw] + U(1)) * up[: len(raw)], out=self._total[1:])
        self.whole = self._hash(self.ends) ^ _WHOLE
        if rest[1]:
            size = int(self.ends[-1] - self.starts[-1])
            own = _sum(buffer, int(self.starts[-1]), int(self.ends[-1])) + rest[0] * pow(_BASE, size, 1 << 64) + (size + rest[1]) * _BASE
            self.whole[-1] = mix(np.array([own % (1 << 64)], np.uint64))[0] ^ _WHOLE
        stops = np.concatenate(([0], np.cumsum(_STOP[raw])))
        self.clause, self.stops = stops[self.starts], int(stops[-1])  # stops before each word, and in all

    def _hash(self, ends: np.ndarray) -> np.ndarray:
        return mix((self._total[ends] - self._total[self.starts]) * self._down[self.starts] + (ends - self.starts).astype(np.uint64) * U(_BASE))

    def beginnings(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(words that are long enough, hashes of their first bytes) for each length of STEMS."""
        for n in STEMS:
            long = self.ends - self.starts >= n
            yield long, self._hash(np.where(long, self.starts + n, self.ends))


def _buffers(texts: list[str | None]) -> Iterator[tuple[list[int], bytes, np.ndarray, bool, tuple[int, int]]]:
    """(indexes, buffer, ends of the texts in it, whether it goes on with the text of the one before, rest of its last word).

    Many short texts stand in one buffer, each with a line break; a long one is alone, in buffers that end between words. Of
    a word that is longer than a buffer the rest is summed up, piece by piece.
    """
    own: list[int] = []
    parts: list[bytes] = []
    size = 0

    def made():
        return list(own), b"\n".join(parts) + b"\n", np.cumsum([len(x) + 1 for x in parts]), False, (0, 0)

    piece = max(PIECE, *STEMS)
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        if size and size + len(data) > piece:
            yield made()
            own, parts, size = [], [], 0
        if len(data) <= piece:
            own.append(i)
            parts.append(data)
            size += len(data) + 1
            continue
        at = 0
        while at < len(data):
            part = data[at : at + piece]
            between = np.flatnonzero(~_WORD[np.frombuffer(part, np.uint8)])
            if at + len(part) < len(data) and len(between):
                part = part[: between[-1] + 1]
            goes_on, rest = at > 0, (0, 0)
            at += len(part)
            if not len(between):  # a word that has no end here
                found = _BETWEEN.search(data, at)
                end = found.start() if found else len(data)
                rest, at = (_sum(data, at, end), end - at), end
            yield [i], part, np.array([len(part) + 1]), goes_on, rest
    if own:
        yield made()


def _hash_words(words: str) -> np.ndarray:
    return np.unique(Words(words.lower().encode()).whole)


class Grammar:
    """The lexicon transducer (sorted hashes and weights) with the composed context transducer."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.weights = hashes[order], weights[order]
        self.context = [(TARGET, _hash_words(TARGETS)), (NEGATION, _hash_words(NEGATIONS)), (REPORT, _hash_words(REPORTS))]

    def _look_up(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.weights[at], 0.0)

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Of each text: one, log of its clauses' sum, their largest and mean, share of scoring words, threats with a target."""
        total, most, clauses, hits, words_in, threats = (np.zeros(len(texts)) for _ in range(6))
        known_threats = _hash_words(THREATS)
        step, outs, factors = GRAMMAR.step.tolist(), GRAMMAR.out.tolist(), GRAMMAR.weight.tolist()
        state, last, clause, score, current, pending = 0, -REACH, -1, 0.0, 0, 0.0
        word_base = stop_base = 0  # words and stops of the text's earlier buffers
        for own, buffer, ends, goes_on, rest in _buffers(texts):
            words = Words(buffer, rest)
            if not goes_on:
                total[current] += score
                most[current] = max(most[current], score)
                state, last, clause, score, current, pending = 0, -REACH, -1, 0.0, own[0], 0.0
                word_base, stop_base, last_clause = 0, 0, -1
            if not len(words.starts):
                stop_base += words.stops
                continue
            weight = self._look_up(words.whole)
            for long, hashes in words.beginnings():
                weight = np.maximum(weight, np.where(long, self._look_up(hashes), 0))
            symbol = np.full(len(weight), -1)
            for kind, known in self.context:
                symbol[np.isin(words.whole, known)] = kind
            symbol[weight > 0] = INSULT
            symbol[np.isin(words.whole, known_threats)] = THREAT
            doc = np.searchsorted(ends, words.starts, side="right")
            place = words.clause + stop_base
            np.add.at(words_in, own, np.bincount(doc, minlength=len(own)))
            np.add.at(clauses, own, np.bincount(doc[place != np.concatenate(([last_clause], place[:-1]))], minlength=len(own)))
            for w in np.flatnonzero(symbol >= 0).tolist():
                if place[w] != clause or own[doc[w]] != current:
                    total[current] += score
                    most[current] = max(most[current], score)
                    state, clause, score, current, pending = 0, place[w], 0.0, own[doc[w]], 0.0
                elif w + word_base - last > REACH:
                    state = step[state][GAP]
                s = int(symbol[w])
                out, factor = outs[state][s], factors[state][s]
                if s in (INSULT, THREAT):
                    score += weight[w] * factor
                    hits[current] += weight[w] > 0
                    pending = weight[w]
                    threats[current] += out == THREAT and factor > 1
                elif out == ADDRESSED:
                    score += pending * factor
                    threats[current] += factor == ADDRESSED_THREAT
                state, last = step[state][s], w + word_base
            word_base, stop_base, last_clause = word_base + len(words.starts), stop_base + words.stops, place[-1]
        if len(texts):
            total[current] += score
            most[current] = max(most[current], score)
        return np.stack((np.ones(len(texts)), np.log1p(total), np.minimum(most, 40) / 10, np.log1p(20 * total / np.maximum(clauses, 1)), np.log1p(100 * hits / np.maximum(words_in, 1)), np.log1p(threats)), axis=1)


def _copies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Four minima of a text's shingles: near copies share most of them, and share one document's weight in training."""
    from tallyloom.llm._text import word_hashes

    for pdf in batches:
        rows = []
        for _, words in word_hashes(list(pdf["text"])):
            values = shingle_set(words)
            rows.append([int((mix(values + U(k * 7919 + 1)).min() if len(values) else U(k)).astype(np.int64)) for k in range(4)])
        yield pd.DataFrame({"doc_id": pdf["doc_id"], **{f"m{k}": [r[k] for r in rows] for k in range(4)}})


def _stems(weights: dict[int, float]):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Weighted documents of both classes that hold each word or word beginning."""
        for pdf in batches:
            seen, toxic, share = [], [], []
            for text, y, doc in zip(pdf["text"], pdf["y"], pdf["doc_id"], strict=True):
                each = []
                for _, buffer, _, _, rest in _buffers([text]):
                    words = Words(buffer, rest)
                    each.append(words.whole)
                    each += [hashes[long] for long, hashes in words.beginnings()]
                found = np.unique(np.concatenate(each)) if each else np.zeros(0, np.uint64)
                seen.append(found)
                toxic.append(np.full(len(found), weights[doc] if y else 0.0))
                share.append(np.full(len(found), 0.0 if y else weights[doc]))
            if seen:
                keys, at = np.unique(np.concatenate(seen), return_inverse=True)
                yield pd.DataFrame({"stem": keys.astype(np.int64), "toxic": np.bincount(at, np.concatenate(toxic), len(keys)), "clean": np.bincount(at, np.concatenate(share), len(keys))})

    return count


def _feature_rows(grammar: Grammar):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = grammar.features(list(pdf["text"]))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], **{f"x{k}": x[:, k] for k in range(x.shape[1])}})

    return rows


def _scorer(grammar: Grammar, curve: np.ndarray):
    """A column function of the texts; only they cross to Python."""

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            odds = grammar.features(list(texts)) @ curve
            yield pd.Series(1 / (1 + np.exp(-np.clip(odds, -30, 30))))

    return F.pandas_udf(score, "double").asNondeterministic()  # so that a plan runs it once


def learned(docs: DataFrame, labels: DataFrame) -> tuple[Grammar, np.ndarray]:
    """The grammar and the curve, from at most TRAIN_DOCS labelled documents that aren't held out."""
    chosen = F.broadcast(training_labels(labels, "toxic", TRAIN_DOCS))  # at most TRAIN_DOCS rows of two numbers
    # Of rows that repeat an id the least text is trained on, so that reruns agree.
    sample = written(docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")), "sample")
    keys = sample.mapInPandas(_copies, "doc_id long, m0 long, m1 long, m2 long, m3 long").toPandas().sort_values("doc_id")
    group = np.ones(len(keys))
    for k in range(4):
        group = np.maximum(group, keys[f"m{k}"].map(keys[f"m{k}"].value_counts()).to_numpy(float)) if len(keys) else group
    weights = dict(zip(keys["doc_id"].tolist(), (1 / group).tolist(), strict=True))
    y = {r["doc_id"]: r["y"] for r in sample.select("doc_id", "y").collect()}
    n1 = sum(w for d, w in weights.items() if y[d])
    n0 = sum(w for d, w in weights.items() if not y[d])
    empty = Grammar(np.zeros(0, np.uint64), np.zeros(0))
    if not n1 or not n0:
        return empty, np.array([np.log((n1 + 0.5) / (n0 + 0.5)), 0, 0, 0, 0, 0])
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("clean") + 0.5) / (n0 + 1))
    counts = sample.mapInPandas(_stems(weights), "stem long, toxic double, clean double").groupBy("stem").agg(F.round(F.sum("toxic"), 6).alias("toxic"), F.round(F.sum("clean"), 6).alias("clean"))  # whatever the order of the sums
    best = counts.where(F.col("toxic") >= max(LEAST_DOCS, n1 / 100)).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS).orderBy(F.desc(F.col("odds") * F.col("toxic")), "stem").limit(LEXICON).collect()
    grammar = Grammar(np.array([r["stem"] for r in best], np.int64).astype(np.uint64), np.array([r["odds"] for r in best], float))
    rows = sample.mapInPandas(_feature_rows(grammar), "doc_id long, y int, x0 double, x1 double, x2 double, x3 double, x4 double, x5 double").toPandas().sort_values("doc_id")
    drop_written(sample)
    x = rows[[f"x{k}" for k in range(6)]].to_numpy()
    return grammar, logistic(x, rows["y"].to_numpy(float), decay=0.3)


def score_toxicity(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs (doc_id, text), with the columns `keep`.

    labels (doc_id, toxic) are read only outside the held-out fifth; repeated ones of an id count as their maximum, and
    near copies among the training texts share one text's weight. Every whole text is scored; null and empty ones have no
    clause and get the curve's constant, rows that repeat an id are scored alike, a row without one as any other. Without
    labels of both classes all texts get one score. An empty table gives an empty result.
    """
    grammar, curve = learned(docs, labels)
    kept = [c for c in keep if c not in ("doc_id", "held_out", "score", "predicted")]
    scored = docs.select("doc_id", "text", *(c for c in kept if c != "text")).withColumn("score", _scorer(grammar, curve)(F.col("text").cast("string"))).withColumn("held_out", held_out(F.col("doc_id")))
    return scored.withColumn("predicted", (F.col("score") >= TOXIC).cast("int")).select("doc_id", "held_out", "score", "predicted", *kept)



def op9_clause_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
