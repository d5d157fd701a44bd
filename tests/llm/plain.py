"""Brute-force versions of the operators' decisions, one row at a time, that share no code with their kernels."""

import math
import re
from collections import Counter

import numpy as np

from tallyloom.llm import quality, toxicity

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(texts):
    """{id: smallest id reachable} for {id: text}, over all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 4 >= 3 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 75 * (len(a) + len(b) - both):
                    x, y = root(i), root(j)
                    parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


# ------------------------------------------------------------------ toxicity
def _toxic_word(w):
    return lower(w.decode("utf-8", "surrogateescape")).encode("utf-8", "surrogateescape")


def toxic_features(grammar, text):
    """The features of one text: each machine steps on its own, nothing is composed."""
    data = (text or "").encode("utf-8", "surrogatepass")
    known = dict(zip(grammar.hashes.tolist(), grammar.weights.tolist(), strict=True))
    roles = {w: s for s, words in ((toxicity.TARGET, toxicity.TARGETS), (toxicity.NEGATION, toxicity.NEGATIONS), (toxicity.REPORT, toxicity.REPORTS), (toxicity.THREAT, toxicity.THREATS)) for w in (_toxic_word(x.encode()) for x in words.split())}
    # Where a word is in two lists the later list of the grammar counts, and threats last.
    clauses, hits, n_words, threats = {}, 0, 0, 0
    negated = reported = False
    side, pending, kind, last, place = None, 0.0, None, -99, None
    stops = np.cumsum([0] + [b in b".!?;\n" for b in data])
    for n, m in enumerate(re.finditer(rb"[A-Za-z'\x80-\xff]+", data)):
        w = _toxic_word(m.group())
        n_words += 1
        clause = int(stops[m.start()])
        clauses.setdefault(clause, 0.0)
        hashes = [int(toxicity.Words(w).whole[0])]
        for k in toxicity.STEMS:
            if len(w) >= k:
                hashes.append(int(toxicity.Words(w[:k]).whole[0]) ^ int(toxicity._WHOLE))
        weight = max(0.0, *(known.get(h, 0.0) for h in hashes))
        symbol = roles.get(w)
        if symbol != toxicity.THREAT and weight > 0:
            symbol = toxicity.INSULT
        if symbol is None:
            continue
        if clause != place or n - last > toxicity.REACH:
            negated = reported = False
            side, kind = None, None
            if clause != place:
                pending = 0.0
        place, last = clause, n
        if symbol in (toxicity.INSULT, toxicity.THREAT):
            threat, mild, factor = symbol == toxicity.THREAT, False, 1.0
            if negated:
                mild, factor = True, 0.2 if threat else 0.4
            if reported:
                factor *= (0.4 if threat else 0.5) if not mild else 0.5
                mild = True
            if not mild and side == "target":
                factor = 2.0 if threat else 1.5
                threats += threat
            elif not mild:
                side, kind = "pending", symbol
            clauses[clause] += weight * factor
            pending = weight
            hits += weight > 0
        elif symbol == toxicity.TARGET:
            if side == "pending":
                clauses[clause] += pending * (1.0 if kind == toxicity.THREAT else 0.5)
                threats += kind == toxicity.THREAT
            side = "target"
        negated |= symbol == toxicity.NEGATION
        reported |= symbol == toxicity.REPORT
    total = sum(clauses.values())
    return [1.0, math.log1p(total), min(max(clauses.values(), default=0.0), 40) / 10, math.log1p(20 * total / max(len(clauses), 1)), math.log1p(100 * hits / max(n_words, 1)), math.log1p(threats)]


def logistic(x):
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


# ------------------------------------------------------------------ quality
def line_features(text):
    """(features, byte lengths) of a text's lines with words."""
    rows, lengths, seen = [], [], set()
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        words = tuple(lower(w.decode("latin-1")) for w in re.findall(rb"[^\x20\x09-\x0d]+", line))
        if not words:
            continue
        count = lambda chars: sum(line.count(bytes([c])) for c in chars)  # noqa: B023, E731
        upper = count(range(65, 91))
        letters = upper + count(range(97, 123)) + sum(b >= 128 for b in line)
        n, size = len(words), max(len(line), 1)
        symbol = count(b"#$%&*~^=<>_+@\\/`{}[]")
        repeated = sum(a == b for a, b in zip(words, words[1:], strict=False))
        rows.append([1, min(symbol / n, 2), min(count(b"|") / n, 1), min(count(b"!") / n, 2), repeated / n, upper / max(letters, 1), count(b"0123456789") / size, symbol / size, math.log1p(n) / 5, min(letters / n / 10, 3), min(count(b".,;:?!") / n, 2), letters / size, words in seen])
        seen.add(words)
        lengths.append(len(line))
    if not rows:
        return np.zeros((1, quality.N_FEATURES)), np.ones(1)
    out = []
    for i, r in enumerate(rows):
        near = [rows[k] for k in (i - 1, i + 1) if 0 <= k < len(rows)]
        out.append(r + [sum(x[c] for x in near) / max(len(near), 1) for c in range(1, 7)])
    return np.array(out, float), np.array(lengths, float)


def document_quality(model, text):
    """The length-weighted mean marginal of good by plain forward-backward sums, scaled line by line."""
    x, length = line_features(text)
    odds = ((x - model.mean) / model.scale) @ model.w
    step = np.exp(model.step)
    unary = [np.array([1.0, math.exp(o)]) if o < 0 else np.array([math.exp(-o), 1.0]) for o in odds]
    forward = [unary[0] / unary[0].sum()]
    for u in unary[1:]:
        f = (forward[-1] @ step) * u
        forward.append(f / f.sum())
    backward = [np.ones(2)]
    for u in unary[:0:-1]:
        b = step @ (u * backward[0])
        backward.insert(0, b / b.sum())
    good = [f[1] * b[1] / (f * b).sum() for f, b in zip(forward, backward, strict=True)]
    size = np.maximum(length, 1)
    return float((np.array(good) * size).sum() / size.sum())


# ------------------------------------------------------------------ mixing and packing
def mix(rows, weights=(5, 2, 1), epochs=3):
    """{row number: words taken} of rows (doc_id, text, source)."""
    import hashlib

    sizes = [len(WORD.findall(t or "")) for _, t, _ in rows]
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(sizes, rows, strict=True) if r[2] == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    left, open_, target = float(sum(sizes)), set(sources), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > epochs * total[s]}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in full:
            target[s] = float(epochs * total[s])
            left -= target[s]
        open_ -= full
    taken = {}
    for s in sources:
        budget = math.floor(target[s] + 1e-9)
        own = [i for i, r in enumerate(rows) if r[2] == s]
        key = lambda i: hashlib.md5(f"mix-1:{'' if rows[i][0] is None else rows[i][0]}:{'' if rows[i][1] is None else hashlib.md5(rows[i][1].encode()).hexdigest()}".encode()).hexdigest()
        whole = budget // total[s] if total[s] else 0
        rest = budget - whole * total[s]
        for i in sorted(own, key=key):
            part = min(sizes[i], rest)
            rest -= part
            taken[i] = whole * sizes[i] + part
    return taken


def repeats(words, taken):
    """The texts that a document gives: whole as often as it is taken, then its first words."""
    out = []
    while taken > 0:
        out.append(min(taken, len(words)))
        taken -= len(words)
    return out


def best_fit(lengths, plan, capacities):
    """Used words of every bin: each piece into the fullest open bin that has room, of equals that which was filled last."""
    bins = []
    for time, n in enumerate(lengths):
        fits = [b for b in bins if b["room"] >= n]
        if fits:
            own = min(fits, key=lambda b: (b["room"], -b["time"]))
        else:
            own = {"used": 0, "room": plan[next(k for k, c in enumerate(sorted(capacities)) if n <= c)]}
            bins.append(own)
        own["used"], own["room"], own["time"] = own["used"] + n, own["room"] - n, time
    return Counter(b["used"] for b in bins)
