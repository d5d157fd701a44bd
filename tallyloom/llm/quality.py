"""Document quality from a linear-chain conditional random field over lines.

Every line of a text is described by shares of character and word classes, by repetition, and by the same of its
neighbours. A chain with the labels good and bad over the lines is trained on labelled documents, whose label stands for
all their lines; forward-backward gives each line's marginal, the marginals' mean weighted by length gives a document's
quality, and a logistic curve fitted on the training documents turns that into a probability.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm._common import drop_written, held_out, table, training_labels, written
from tallyloom.llm._text import _SPACE, U, _hash_buffer, _hash_long, mix

#: Labelled documents that are trained on at most, each with all its lines, and lines of them after which no further document
#: is taken (some 150 MB on the driver); score from which a text is good.
TRAIN_DOCS, TRAIN_LINES, GOOD = 4_000, 1_000_000, 0.3
#: Lines, padding included, of the chains that a step of training holds at once; a longer chain alone.
_SLOTS = 1 << 17
#: Bytes of text that are described at once.
_PIECE = 1 << 18
_WHITE = re.compile(rb"[\x20\x09-\x0d]")


def _table(members: str) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[[ord(c) for c in members]] = 1
    return out


_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER | _table("abcdefghijklmnopqrstuvwxyz")
_LETTER[128:] = 1
_DIGIT, _PIPE, _BANG, _END = _table("0123456789"), _table("|"), _table("!"), _table(".,;:?!")
_SYMBOL = _table("#$%&*~^=<>_+@\\/`{}[]")
#: Features that a line also takes from the lines before and after it.
_NEAR = [1, 2, 3, 4, 5, 6]
N_FEATURES = 13 + len(_NEAR)


def _line_counts(buffer: bytes, words_before: int = 0, last: np.uint64 | None = None) -> tuple[np.ndarray, np.ndarray, int, np.uint64 | None]:
    """Counts and key of each line of a buffer; the last line may be cut between words.

    The counts are letters, bangs, pipes, symbols, capitals, digits, ends, words, repeats of the word before, and bytes. The
    first line goes on from `words_before` words, the last of which has the hash `last`; the same of the last line returns.
    """
    raw = np.frombuffer(buffer, np.uint8)
    breaks = np.flatnonzero(raw == 10)
    starts = np.concatenate(([0], breaks + 1))
    starts = starts[starts < len(raw)]
    hashes, at = _hash_buffer(buffer)
    line = np.searchsorted(starts, at, side="right") - 1
    words = np.bincount(line, minlength=len(starts))
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    if last is not None and len(hashes) and line[0] == 0:
        same[0] = hashes[0] == last
    order = np.arange(len(at)) - np.searchsorted(line, line) + np.where(line == 0, words_before, 0)
    key = np.zeros(len(starts), np.uint64)
    np.add.at(key, line, mix(hashes + order.astype(np.uint64) * U(0x9E3779B97F4A7C15)))
    classes = [np.add.reduceat(t[raw], starts, dtype=np.int64) for t in (_LETTER, _BANG, _PIPE, _SYMBOL, _UPPER, _DIGIT, _END)]
    ends = np.concatenate((starts[1:], [len(raw)]))
    size = ends - starts - (raw[ends - 1] == 10)
    counts = np.stack((*classes, words, np.bincount(line[same], minlength=len(starts)), size), axis=1)
    open_words = int(words[-1]) + (words_before if len(starts) == 1 else 0)
    open_last = hashes[-1] if len(hashes) and line[-1] == len(starts) - 1 else (last if len(starts) == 1 else None)
    return counts, key, open_words, open_last


def _word_counts(data: memoryview, words_before: int, last: np.uint64 | None) -> tuple[np.ndarray, np.ndarray, int, np.uint64]:
    """_line_counts of one word of any length, _PIECE bytes at a time."""
    classes = np.zeros(7, np.int64)
    for at in range(0, len(data), _PIECE):
        raw = np.frombuffer(data[at : at + _PIECE], np.uint8)
        classes += [int(t[raw].sum(dtype=np.int64)) for t in (_LETTER, _BANG, _PIPE, _SYMBOL, _UPPER, _DIGIT, _END)]
    own = _hash_long(data)
    key = mix(own + np.array([words_before], np.uint64) * U(0x9E3779B97F4A7C15))
    repeated = int(last is not None and own[0] == last)
    return np.array([[*classes, 1, repeated, len(data)]]), key, words_before + 1, own[0]


def _long_counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """_line_counts of a text of any length, cut after white space into pieces of at most _PIECE bytes; a longer word is taken
    by itself."""
    parts, keys = [], []
    at, words, last, open_ = 0, 0, None, False
    while at < len(data):
        end = at + _PIECE
        if end < len(data):
            cut = max(data.rfind(b"\n", at, end), data.rfind(b" ", at, end)) + 1
            if not cut:
                others = np.flatnonzero(_SPACE[np.frombuffer(data[at:end], np.uint8)])
                cut = at + int(others[-1]) + 1 if len(others) else 0
            end = cut
        if end:
            piece = data[at:end]
            counts, key, words, last = _line_counts(piece, words, last)
        else:  # within a word: up to its end
            found = _WHITE.search(data, at)
            end = found.start() if found else len(data)
            piece = b""
            counts, key, words, last = _word_counts(memoryview(data)[at:end], words, last)
        if open_:  # the first line is the rest of the one before
            parts[-1][-1] += counts[0]
            keys[-1][-1:] += key[:1]
            counts, key = counts[1:], key[1:]
        if len(counts):
            parts.append(counts)
            keys.append(key)
        open_ = not piece.endswith(b"\n")
        if not open_:
            words, last = 0, None
        at = end
    return np.concatenate(parts), np.concatenate(keys)


def _features(counts: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, byte lengths) of a text's lines with words; a text without any has one line of zeros."""
    full = counts[:, 7] > 0
    if not full.any():
        return np.zeros((1, N_FEATURES)), np.ones(1)
    letters, bang, pipe, symbol, upper, digit, end, words, repeated, length = counts[full].astype(float).T
    size, before = np.maximum(length, 1), pd.Series(keys[full]).duplicated().to_numpy()
    own = np.stack(
        [
            np.ones(len(words)), np.minimum(symbol / words, 2), np.minimum(pipe / words, 1), np.minimum(bang / words, 2), repeated / words,
            upper / np.maximum(letters, 1), digit / size, symbol / size, np.log1p(words) / 5,
            np.minimum(letters / words / 10, 3), np.minimum(end / words, 2), letters / size, before,
        ],
        axis=1,
    )
    near = np.zeros((len(own), len(_NEAR)))
    if len(own) > 1:
        near[1:] += own[:-1][:, _NEAR]
        near[:-1] += own[1:][:, _NEAR]
        near[1:-1] /= 2
    return np.concatenate((own, near), axis=1), length


def line_features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, byte lengths) of the lines with words of each text; a text without any has one line of zeros."""
    group: list[bytes] = []
    size = 0

    def flush():
        if group:
            joined = b"\n".join(group) + b"\n"
            counts, keys, _, _ = _line_counts(joined)
            ends = np.cumsum(np.array([x.count(b"\n") + 1 for x in group]))
            for begin, end in zip(np.concatenate(([0], ends[:-1])), ends, strict=True):
                yield _features(counts[begin:end], keys[begin:end])
            group.clear()

    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if len(data) > _PIECE:  # a long text alone
            yield from flush()
            size = 0
            yield _features(*_long_counts(data))
            continue
        if size + len(data) > _PIECE:
            yield from flush()
            size = 0
        group.append(data)
        size += len(data) + 1
    yield from flush()


class ChainField:
    """A linear-chain conditional random field with two labels: weights w of the odds for good, a 2 x 2 table of steps."""

    def __init__(self, features: int):
        self.mean, self.scale = np.zeros(features), np.ones(features)
        self.w, self.step = np.zeros(features), np.zeros((2, 2))

    def _passes(self, odds: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log forward and backward messages and log partition of padded chains (chains, lines)."""
        chains, lines = odds.shape
        unary = np.stack((np.zeros_like(odds), odds), axis=2)
        forward, backward = np.zeros((chains, lines, 2)), np.zeros((chains, lines, 2))
        forward[:, 0] = unary[:, 0]
        for t in range(1, lines):
            moved = np.logaddexp(forward[:, t - 1, :1] + self.step[0], forward[:, t - 1, 1:] + self.step[1])
            forward[:, t] = np.where(mask[:, t, None], moved + unary[:, t], forward[:, t - 1])
        for t in range(lines - 2, -1, -1):
            ahead = unary[:, t + 1] + backward[:, t + 1]
            moved = np.logaddexp(self.step[:, 0] + ahead[:, :1], self.step[:, 1] + ahead[:, 1:])
            backward[:, t] = np.where(mask[:, t + 1, None], moved, 0)
        return forward, backward, np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])

    def fit(self, docs: list[np.ndarray], labels: np.ndarray, rounds: int = 120, rate: float = 0.1, decay: float = 1e-3) -> ChainField:
        """Adam on the mean conditional log-likelihood, both classes weighing the same.

        Chains are padded to the longest of their bucket, less than twice their length.
        """
        sizes = np.array([len(x) for x in docs])
        self.mean = sum(x.sum(0, dtype=np.float64) for x in docs) / sizes.sum()
        self.scale = np.sqrt(sum(((x - self.mean) ** 2).sum(0) for x in docs) / sizes.sum()) + 1e-6
        self.mean[0], self.scale[0] = 0, 1
        y = labels.astype(int)
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) / sizes
        buckets: list[list[int]] = []
        for i in np.argsort(sizes, kind="stable").tolist():
            if not buckets or sizes[i] >= 2 * sizes[buckets[-1][0]] or (len(buckets[-1]) + 1) * sizes[i] > _SLOTS:
                buckets.append([])
            buckets[-1].append(i)
        m = [np.zeros_like(self.w), np.zeros_like(self.step)]
        v = [np.zeros_like(self.w), np.zeros_like(self.step)]
        for r in range(1, rounds + 1):
            g_w, g_step = -decay * self.w, -decay * 10 * self.step
            for own in buckets:
                x = (np.concatenate([docs[i] for i in own]) - self.mean) / self.scale
                mask = np.arange(sizes[own].max()) < sizes[own][:, None]
                odds = np.zeros(mask.shape)
                odds[mask] = x @ self.w
                forward, backward, total = self._passes(odds, mask)
                good = np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None])
                g_w += (weight[own][:, None] * (y[own][:, None] - good))[mask] @ x
                pairs = mask[:, 1:]
                ahead = np.stack((np.zeros_like(odds), odds), axis=2)[:, 1:] + backward[:, 1:]
                both = np.exp(forward[:, :-1, :, None] + self.step + ahead[:, :, None, :] - total[:, None, None, None])
                g_step -= np.einsum("dl,dlij->ij", weight[own][:, None] * pairs, both)
                for label in (0, 1):
                    g_step[label, label] += (weight[own] * pairs.sum(1) * (y[own] == label)).sum()
            for k, (value, g) in enumerate(((self.w, g_w), (self.step, g_step))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                value += rate * (m[k] / (1 - 0.9**r)) / (np.sqrt(v[k] / (1 - 0.99**r)) + 1e-8)
        return self

    def quality(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The length-weighted mean of the lines' marginals of being good, one number a document."""
        out = np.empty(len(docs))
        order = sorted(range(len(docs)), key=lambda i: len(docs[i][0]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and end - at < 512 and (end - at + 1) * len(docs[order[end]][0]) <= 200_000:
                end += 1
            own = [docs[i] for i in order[at:end]]
            lines = max(len(x) for x, _ in own)
            odds, mask, size = np.zeros((len(own), lines)), np.zeros((len(own), lines), bool), np.zeros((len(own), lines))
            for i, (x, length) in enumerate(own):
                odds[i, : len(x)], mask[i, : len(x)], size[i, : len(x)] = ((x - self.mean) / self.scale) @ self.w, True, np.maximum(length, 1)
            forward, backward, total = self._passes(odds, mask)
            good = np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None])
            out[order[at:end]] = (good * size * mask).sum(1) / size.sum(1)
            at = end
        return out


def logistic(x: np.ndarray, y: np.ndarray, decay: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; x has a column of ones first."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], decay)
    ridge[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.linalg.solve(h, g)
        w -= step * min(1, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _logit(q: np.ndarray) -> np.ndarray:
    q = np.clip(q, 1e-6, 1 - 1e-6)
    return np.log(q / (1 - q))


def _collect_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for (x, length), y in zip(line_features(list(pdf["text"])), pdf["y"], strict=True):
            rows.append((int(y), len(x), x.astype(np.float32).tobytes(), length.astype(np.float32).tobytes()))
        yield pd.DataFrame(rows, columns=["y", "n", "x", "length"]).assign(doc_id=pdf["doc_id"].to_numpy())[["doc_id", "y", "n", "x", "length"]]


def _scorer(model: ChainField | None, curve: np.ndarray):
    """A column function of the texts; only they cross to Python."""

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for start in range(0, len(texts), 512):
                part = list(texts.iloc[start : start + 512])
                odds = np.full(len(part), curve[0]) if model is None else curve[0] + curve[1] * _logit(model.quality(list(line_features(part))))
                out.append(1 / (1 + np.exp(-np.clip(odds, -30, 30))))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return F.pandas_udf(score, "double").asNondeterministic()  # so that a plan runs it once


def learned(docs: DataFrame, labels: DataFrame) -> tuple[ChainField | None, np.ndarray]:
    """The field and the curve from all lines of at most TRAIN_DOCS labelled documents that aren't held out (see TRAIN_LINES)."""
    chosen = F.broadcast(training_labels(labels, "quality", TRAIN_DOCS))  # at most TRAIN_DOCS rows of two numbers
    # Of rows that repeat an id the least text is trained on, in the order of the ids, so that reruns agree.
    known = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    lines = written(known.mapInPandas(_collect_features, "doc_id long, y int, n long, x binary, length binary"), "lines")
    # Whole documents in the order in which they were chosen, at most TRAIN_DOCS rows of two numbers, until there are enough lines.
    before = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    taken = lines.select("doc_id", "n").withColumn("before", before).where(F.coalesce("before", F.lit(0)) < TRAIN_LINES).select("doc_id")
    rows = lines.join(taken, "doc_id", "left_semi").toPandas().sort_values("doc_id")
    drop_written(lines)
    y = rows["y"].to_numpy()
    if len(set(y.tolist())) < 2:
        return None, np.array([_logit(np.array((y.sum() + 0.5) / (len(y) + 1.0)))])
    data = [(np.frombuffer(x, np.float32).reshape(-1, N_FEATURES), np.frombuffer(n, np.float32)) for x, n in zip(rows["x"], rows["length"], strict=True)]
    model = ChainField(N_FEATURES).fit([x for x, _ in data], y)
    q = _logit(model.quality(data))
    return model, logistic(np.stack((np.ones(len(q)), q), axis=1), y)


def score_quality(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs (doc_id, text), with the columns `keep`.

    Trains on all lines of at most TRAIN_DOCS documents that labels (doc_id, quality) has a label for and whose id isn't
    held out, the first in the order of a hash until they have TRAIN_LINES lines; repeated labels of an id count as their maximum, repeated rows as their
    least text. Scores every whole text, also null and empty ones, which are one line without features; rows that repeat
    an id are scored each by its text, a row without one as any other. Without labels of both classes the score is the
    share of good ones, 0.5 with none. An empty table gives an empty result.
    """
    model, curve = learned(docs, labels)
    kept = [c for c in keep if c not in ("doc_id", "held_out", "score", "predicted")]
    scored = docs.select("doc_id", "text", *(c for c in kept if c != "text")).withColumn("score", _scorer(model, curve)(F.col("text").cast("string"))).withColumn("held_out", held_out(F.col("doc_id")))
    return scored.withColumn("predicted", (F.col("score") >= GOOD).cast("int")).select("doc_id", "held_out", "score", "predicted", *kept)


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
