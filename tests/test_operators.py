"""Operators on literal rows: nulls, ties, boundaries and state."""

import difflib
import itertools
import json
import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tallyloom import plans
from tallyloom.functions import scalar as sc
from tallyloom.operators import fit, fuzzy, joins, matching, merge, quality, roles, search, sequence, stints, vectors, workflow
from tallyloom.plans import composition
from tallyloom.sources import bucketed, nested, paged, sinks, tables
from tallyloom.streaming import streams, tracks


def got(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


READS = "slot string, t double, value string, score double, margin double, scores map<string,double>"


def track(slot, *parts):
    """Reads of (value, first, last[, score, margin, what else scored]) every five seconds."""
    rows = []
    for value, first, last, *more in parts:
        score, margin, others = (*more, *(0.9, 0.3, {})[len(more) :])
        rows += [(slot, float(t), value, score, margin, {value: score, **others}) for t in range(first, last + 1, 5)]
    return rows


TRACKS = {
    "isolated": track("isolated", ("tracer", 0, 45), ("genji", 50, 50, 0.5, 0.3, {"tracer": 0.45}), ("tracer", 55, 95)),
    "genuine": track("genuine", ("tracer", 0, 45), ("sombra", 50, 75, 0.9, 0.3, {"tracer": 0.2})),
    "variant": track("variant", ("tracer", 0, 45), ("sombra", 50, 75, 0.55, 0.01, {"tracer": 0.54}), ("tracer", 80, 95)),
    "gap": track("gap", ("tracer", 0, 45), ("sombra", 50, 50, 0.9, 0.3, {"tracer": 0.2}), ("sombra", 100, 125, 0.9, 0.3, {"tracer": 0.2})),
    "never": track("never", ("tracer", 0, 0), ("genji", 5, 5), ("ana", 10, 10, 0.5)),
    "open": track("open", ("tracer", 0, 45), ("genji", 50, 50, 0.9, 0.3, {"tracer": 0.2})),
    "other": track("other", ("tracer", 0, 45), ("genji", 50, 50), ("ana", 55, 75, 0.9, 0.3, {"tracer": 0.1})),
}


def kinds(df):
    out = {}
    for r in df.orderBy("slot", "t", "kind").collect():
        out.setdefault(r["slot"], []).append((r["kind"], r["value"], r["t"], r["reason"]))
    return out


def test_stints_and_their_events(spark):
    reads = spark.createDataFrame([r for rows in TRACKS.values() for r in rows] + [("null", None, "x", 1.0, 1.0, {}), ("null", 1.0, None, 1.0, 1.0, {})], READS)
    found = kinds(stints.stints(reads, "slot"))
    assert found["isolated"] == [("stint", "tracer", 0.0, None), ("rejected-swap", "genji", 50.0, "returned")]
    assert found["genuine"] == [("stint", "tracer", 0.0, None), ("stint", "sombra", 50.0, None), ("swap", "sombra", 50.0, None)]
    assert [k for k, *_ in found["variant"]] == ["stint", "rejected-swap", "rejected-swap"] and found["variant"][1][3] == "small-margin"
    assert ("swap", "sombra", 100.0, None) in found["gap"]
    assert found["never"] == [("unestablished", "ana", 10.0, "few-reads")]
    assert found["open"][-1] == ("rejected-swap", "genji", 50.0, "unresolved")
    assert ("rejected-swap", "genji", 50.0, "interrupted") in found["other"] and ("swap", "ana", 55.0, None) in found["other"]
    assert "null" not in found
    setup = kinds(stints.stints(reads.where("slot = 'genuine'"), "slot", spark.createDataFrame([("genuine", 45.0, 90.0), ("variant", 0.0, 9.0)], SPANS)))
    assert ("setup-change", "sombra", 50.0, None) in setup["genuine"]
    assert stints.stints(reads.where("false"), "slot").count() == 0


def plain_stints(rows, setups=(), rounds=()):
    """The same decisions over a list of reads, with the reads themselves kept: (kind, value, t, reason, early, stands)."""
    held, rival, out = [], [], []
    mean = lambda xs: sum(xs) / len(xs)

    def doubt():
        n, span = len(rival), rival[-1][1] - rival[0][1]
        strong = n >= 2 and span >= 2 and min(r[3] for r in rival) >= 0.8
        if not strong and n < 3:
            return "few-reads"
        if not strong and span < 3:
            return "short-span"
        if mean([r[4] for r in rival]) < 0.05:
            return "small-margin"
        over = [r[3] - r[5].get(held[0][2], -1.0) for r in rival if r[5]] if held else []
        return "not-displaced" if over and mean(over) < 0.04 else None

    def stint():
        before = [r for r in rounds if r[0] <= held[0][1]]
        start, end = max(before, key=lambda r: r[0]) if before else (None, None)
        early = start is not None and held[0][1] - start <= 30
        stands = not early or held[-1][1] >= start + 60 or (end is not None and end < start + 60)
        return "stint", held[0][2], held[0][1], None, early, stands

    def event(kind, reason):
        return kind, rival[0][2], rival[0][1], reason, None, None

    for r in rows:
        if held and r[2] == held[0][2]:
            if rival:
                out.append(event("rejected-swap", "returned"))
            held, rival = [*held, r], []
            continue
        if rival and rival[0][2] != r[2]:
            if held:
                out.append(event("rejected-swap", "interrupted"))
            rival = []
        if held and rival and r[1] - rival[-1][1] > 20:
            rival = []
        rival = [*rival, r]
        why = doubt()
        if why is None:
            if held:
                setup = any(a - 2 <= rival[0][1] <= b + 2 for a, b in setups)
                out += [stint(), event("setup-change" if setup else "swap", None)]
            held, rival = rival, []
        elif held and len(rival) >= 5 and rival[-1][1] - rival[0][1] > 3:
            out.append(event("rejected-swap", why))
            rival = []
    if rival:
        out.append(event("rejected-swap", "unresolved") if held else event("unestablished", "few-reads"))
    return out + ([stint()] if held else [])


def random_reads(seed, slots=12, n=120):
    rng = random.Random(seed)
    rows = []
    for s in range(slots):
        t, value = 0.0, "a"
        for _ in range(n):
            t += rng.choice([1.0, 2.0, 5.0, 25.0])
            value = rng.choice(["a", "b", "c"]) if rng.random() < 0.3 else value
            score = rng.choice([0.5, 0.7, 0.9])
            rows.append((f"s{s}", t, value, score, rng.choice([0.01, 0.1, 0.3]), rng.choice([{}, {"a": 0.45, "b": 0.5, "c": 0.88}])))
    return rows


SPANS = "slot string, start double, end double"
SETUPS = {f"s{i}": [(40.0 * k + i, 40.0 * k + i + 9) for k in range(i % 3, 20, 3)] for i in range(12)}
ROUNDS = {f"s{i}": [(20.0 + 97.0 * k, None if k == 9 else 100.0 + 97.0 * k) for k in range(i % 2, 10)] for i in range(12)}


def found_rows(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["slot"], []).append((r["kind"], r["value"], r["t"], r["reason"], r["early"], r["stands"]))
    return {s: sorted(x, key=repr) for s, x in out.items()}


def plain_found(rows, setups=SETUPS, rounds=ROUNDS):
    slots = {r[0] for r in rows}
    return {s: sorted(plain_stints([r for r in rows if r[0] == s], setups.get(s, ()), rounds.get(s, ())), key=repr) for s in slots}


def spans(spark, of):
    return spark.createDataFrame([(s, a, b) for s, own in of.items() for a, b in own] + [(None, 1.0, 2.0)], SPANS)


def test_stints_equal_a_plain_version_with_setups_and_rounds_of_their_own(spark):
    rows = random_reads(1)
    reads = spark.createDataFrame(rows, READS)
    want = plain_found(rows)
    assert found_rows(stints.stints(reads, "slot", spans(spark, SETUPS), spans(spark, ROUNDS))) == want and len(want) == 12
    # Each rule was hit.
    every = [x for own in want.values() for x in own]
    assert {x[0] for x in every} >= {"stint", "swap", "setup-change", "rejected-swap"} and {x[4:] for x in every} >= {(True, True), (True, False), (False, True)}
    assert {x[3] for x in every} >= {"returned", "interrupted", "small-margin", "not-displaced", "unresolved"}
    # Slots of two maps of the same phases: spans come once a map.
    maps = reads.withColumn("map", F.when(F.col("slot") < "s4", "m0").otherwise("m1"))
    own = {s: SETUPS["s0"] if s < "s4" else SETUPS["s7"] for s in SETUPS}
    once = spark.createDataFrame([(m, a, b) for m, s in (("m0", "s0"), ("m1", "s7")) for a, b in SETUPS[s]], "map string, start double, end double")
    assert found_rows(stints.stints(maps, ["map", "slot"], once, within=["map"])) == plain_found(rows, own, {})


def streamed(spark, path, name, parts, **more):
    """stints_of_stream() over the parts (reads, setups, rounds), a micro-batch each."""
    for i, frames in enumerate(parts):
        for kind, df in zip(("reads", "setups", "rounds"), frames, strict=True):
            df.coalesce(1).write.parquet(f"{path}/{kind}/{i}")
    read = lambda kind, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{path}/{kind}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", tracks.PROVIDER)
    try:
        out = tracks.stints_of_stream(read("reads", READS), "slot", 500.0, "60 seconds", read("setups", SPANS), read("rounds", SPANS), **more)
        return found_rows(streams.collect_all(out, name, "append").where("slot <> 'sentinel'"))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def cut(rows, n, at, jitter, seed):
    """rows in n parts by their time, but up to `jitter` early or late; in no order within a part."""
    rng = random.Random(seed)
    width = max(map(at, rows)) / n + 1
    parts = [[] for _ in range(n)]
    for r in rows:
        parts[min(n - 1, max(0, int((at(r) + rng.uniform(-jitter, jitter)) / width)))].append(r)
    for p in parts:
        rng.shuffle(p)
    return parts


def test_a_stream_closes_its_tracks_with_the_rows_of_the_batch(spark, tmp_path):
    """Rows out of order over four micro-batches; a sentinel far ahead moves the watermark past all closing times."""
    rows = random_reads(1)
    flat = lambda of: [(s, a, b) for s, own in of.items() for a, b in own]
    reads = cut(rows, 4, lambda r: r[1], 20, 2)
    reads[-1].append(("sentinel", 10_000.0, "a", 1.0, 1.0, {}))
    setups, rounds = (cut(flat(of), 4, lambda r: r[1] - 30, 10, 3) for of in (SETUPS, ROUNDS))
    parts = [(spark.createDataFrame(a, READS), spark.createDataFrame(b, SPANS), spark.createDataFrame(c, SPANS)) for a, b, c in zip(reads, setups, rounds, strict=True)]
    assert streamed(spark, tmp_path, "tracks_all", parts) == plain_found(rows)


def test_a_stream_goes_on_where_a_batch_ended(spark, tmp_path):
    rows = random_reads(4)
    reads = spark.createDataFrame(rows, READS)
    setups, rounds = spans(spark, SETUPS).dropna(), spans(spark, ROUNDS).where("slot is not null")
    early = reads.where("t <= 300")
    initial = stints.open_slots(early, "slot", setups.where("start <= 302"), rounds.where("start <= 300"))
    rest = reads.where("t > 300").unionByName(spark.createDataFrame([("sentinel", 10_000.0, "a", 1.0, 1.0, {})], READS))
    got = streamed(spark, tmp_path, "tracks_rest", [(rest, setups.where("start > 302"), rounds.where("start > 300"))], initial=initial)
    want = plain_found(rows)
    for s, own in want.items():
        missing = [x for x in own if x not in got[s]]
        assert all(x in own for x in got[s]) and all(x[2] <= 300 for x in missing) and len(missing) < len(own)
        assert [x for x in own if x[2] > 300] == [x for x in got[s] if x[2] > 300]


def test_emblems_make_rounds(spark):
    """Lock, A, lock, B, lock, C: three setups and three rounds; a flicker and a short segment don't part them."""
    shapes = {"L": [1.0, 0, 0, 0], "A": [0, 1.0, 0, 0], "B": [0, 0, 1.0, 0], "C": [0, 0, 0, 1.0]}
    letters = "L" * 8 + "A" * 12 + "L" + "A" * 17 + "L" * 6 + "B" * 30 + "L" * 6 + "C" * 20 + "BB" + "C" * 8
    frames = spark.createDataFrame([("m", 5.0 * i, [float(x) for x in shapes[c]]) for i, c in enumerate(letters)], "map string, t double, emblem array<double>")
    rounds = stints.rounds_of(stints.emblem_segments(frames, "map"), "map")
    assert got(rounds, "part", "number", "start", "end") == [("round", 1, 40.0, 185.0), ("round", 2, 220.0, 365.0), ("round", 3, 400.0, 545.0), ("setup", 1, 0.0, 35.0), ("setup", 2, 190.0, 215.0), ("setup", 3, 370.0, 395.0)]


def plain_match(text, catalog, contained):
    if len(text) < (3 if contained else 2):
        return None, "none", "short"
    names, codes = {n: i for i, n, _ in sorted(catalog)}, {c: i for i, _, c in sorted(catalog) if c}
    if text in names:
        return names[text], "exact", None
    if not contained:
        if text in codes:
            return codes[text], "code", None
        for w in text.split(" "):
            if len(w) >= 2 and w in codes:
                return codes[w], "code", "word"
    else:
        inside = [i for n, i in names.items() if n in text]
        if inside:
            return (inside[0], "contains", None) if len(inside) == 1 else (None, "none", "ambiguous")
    best = {}
    for n, i in names.items():
        best[i] = max(best.get(i, 0), difflib.SequenceMatcher(None, text, n).ratio())
    ranked = sorted(best.items(), key=lambda x: (-x[1], str(x[0])))
    if ranked[0][1] < 0.72:
        return None, "none", "far"
    if len(ranked) > 1 and ranked[0][1] - ranked[1][1] < 0.08:
        return None, "none", "close"
    return ranked[0][0], "fuzzy", None


@pytest.mark.parametrize("contained", [False, True])
def test_names_match_as_in_a_plain_version(spark, contained):
    rng = random.Random(4)
    names = ["CRAZY RACCOON", "TEAM FALCONS", "FALCON", "GEEKAY ESPORTS", "GEN G", "TWISTED MINDS", "AL QADSIAH", "T1", "NEPAL", "NEPAL VILLAGE", "OASIS"]
    catalog = [(i, n, "".join(w[0] for w in n.split()) + ("X" if i % 3 else "")) for i, n in enumerate(names)]
    texts = ["", "a", "Crazy Raccoon!", "crazy-raccoon", "Crazy Racoon", "vs TFX now", "TF", "NEPAL", "control: nepal village", "map OASIS", "nepal oasis", "falcons", None, "T1", "xx t1 yy"]
    for _ in range(60):
        t = list(rng.choice(names))
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice("ABCDEFG ")
        texts.append("".join(t))
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, x string").withColumn("_id", F.lit(0))
    found = matching.match_names(rows, "x", spark.createDataFrame(catalog, "id int, name string, code string"), least_chars=3 if contained else 2, codes=not contained, contained=contained)
    normal = lambda x: " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in (x or "").upper()).split())
    assert {r["n"]: (r["id"], r["method"], r["reason"]) for r in found.collect()} == {n: plain_match(normal(x), catalog, contained) for n, x in enumerate(texts)}
    none = matching.match_names(rows, "x", spark.createDataFrame([], "id int, name string, code string"))
    assert {r["reason"] for r in none.collect()} == {"short", "empty"}


def noisy(rng, name, alphabet):
    t = list(name)
    for _ in range(rng.randint(0, 4)):
        k = rng.randrange(len(t) + 1)
        t[k : k + rng.randint(0, 1)] = rng.choice(alphabet + " ")
    return "".join(t)


def plain_fuzzy(text, catalog):
    best = {}
    for n, i in catalog:
        if n:
            best[i] = max(best.get(i, 0), difflib.SequenceMatcher(None, text, n).ratio())
    ranked = sorted(best.items(), key=lambda x: (-x[1], str(x[0])))
    if not ranked or ranked[0][1] < 0.72:
        return None, None, "far"
    if len(ranked) > 1 and ranked[0][1] - ranked[1][1] < 0.08:
        return None, None, "close"
    return ranked[0][0], round(ranked[0][1], 3), None


@pytest.mark.parametrize(("alphabet", "block"), [("ABCDEFGH", 16_384), ("abé日😀xyz", 50), ("AB", 16_384)])
def test_the_most_similar_name_is_that_of_all_pairs(spark, monkeypatch, alphabet, block):
    monkeypatch.setattr(fuzzy, "BLOCK_NAMES", block)
    monkeypatch.setattr(fuzzy, "BLOCK_TEXTS", block // 2)
    rng = random.Random(block)
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    names = [" ".join(word(rng.randint(1, 9)) for _ in range(rng.randint(1, 3))) for _ in range(260)] + [word(70), word(250), "A", "AB"]
    catalog = [(n, i // 2) for i, n in enumerate(names)] + [(names[3], 900), (None, 901), ("", 902)]
    texts = [noisy(rng, rng.choice(names), alphabet) for _ in range(150)] + [word(80), "Q", names[3], names[-4][:60] + word(20)]
    frame = spark.createDataFrame([(t,) for t in [*texts, texts[0], "", None]], "text string")
    found = fuzzy.fuzzy_best(frame, spark.createDataFrame(catalog, "name string, id int"), 0.72, 0.08).collect()
    assert {r["text"]: (r["id"], r["quality"], r["reason"]) for r in found} == {t: plain_fuzzy(t, catalog) for t in texts if t} and len(found) == len({t for t in texts if t})
    assert fuzzy.fuzzy_best(frame, spark.createDataFrame([], "name string, id int"), 0.72, 0.08).where("reason <> 'far'").count() == 0


def test_few_of_many_names_are_measured():
    rng = random.Random(1)
    syllables = [a + b + c for a in "BDFGKLMNPRST" for b in "AEIOU" for c in "NRSTLX"]
    names = sorted({" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(2)) for _ in range(20_000)})
    block = fuzzy.Names(names, list(range(len(names))))
    measured = 0
    for _ in range(20):
        text = noisy(rng, rng.choice(names), "ABCDEF")
        measured += block.best_two(text, 0.64)[1]
    assert measured < 20 * len(names) / 1000


def test_line_ups_equal_all_combinations(spark):
    rng = random.Random(6)
    role = {f"h{i}": ["Tank", "Damage", "Damage", "Support"][i % 4] for i in range(11)}
    reads, able, want = [], [], {}
    for k in range(40):
        slots = 4 if k == 0 else 5
        cand = {s: [(h, role[h], rng.choice([0.1, 0.2, 0.4, 0.5, 0.7, 0.9])) for h in rng.sample(sorted(role), 6 if k % 7 else 2)] for s in range(slots)}
        seen = {s: max(c, key=lambda x: x[2]) for s, c in cand.items()}
        seen = {s: (v if x >= 0.5 else None, x) for s, (v, _, x) in seen.items()}
        reads += [(k, s, v, x) for s, (v, x) in seen.items()]
        able += [(k, s, v, r, x) for s, c in cand.items() for v, r, x in c]
        legal = []
        for picks in itertools.product(*cand.values()):
            count = Counter(r for _, r, _ in picks)
            if slots == 5 and len({v for v, *_ in picks}) == 5 and count == {"Tank": 1, "Damage": 2, "Support": 2}:
                legal.append((-round(sum(x for *_, x in picks), 9), tuple(v for v, *_ in picks)))
        want[k] = min(legal)[1] if legal else "slots" if slots == 4 else "no assignment"
    found = roles.line_ups(spark.createDataFrame([*reads, (None, 1, "h1", 0.5)], "k int, slot int, value string, score double"), spark.createDataFrame([*able, (1, 0, "zz", "Other", 9.0), (1, None, "h0", "Tank", 9.0)], "k int, slot int, value string, role string, score double"), "k")
    got_rows = {}
    for r in found.orderBy("k", "slot").collect():
        got_rows.setdefault(r["k"], []).append(r)
    seen = {(k, s): (v, x) for k, s, v, x in reads}
    assert set(got_rows) == set(want) and {"slots", "no assignment", "overruled", "incomplete", None} <= {r["anomaly"] for own in got_rows.values() for r in own}
    for k, own in got_rows.items():
        if isinstance(want[k], str):
            assert {r["anomaly"] for r in own} == {want[k]} and not any(r["valid"] for r in own)
            continue
        for r, value in zip(own, want[k], strict=True):
            read, _ = seen[k, r["slot"]]
            assert r["role"] == role[value] and r["value"] in (value, "UNKNOWN")
            assert r["source"] == ("direct" if read == value else "role-corrected" if read else "role-inferred" if r["score"] >= 0.3 else "unresolved")


def test_leases(spark):
    rng = random.Random(2)
    rows = [(f"r{rng.randrange(3)}", float(rng.randrange(300)), f"w{rng.randrange(3)}", rng.choice(["acquire", "acquire", "heartbeat", "release", "reap", "odd"])) for _ in range(300)]
    want, state = [], {}
    for r, at, w, action in sorted(rows, key=lambda x: (x[0], x[1], x[2], x[3])):
        holder, until = state.get(r, (None, None))
        late = holder is not None and until <= at
        ok = (action == "acquire" and (holder in (None, w) or late)) or (action in ("heartbeat", "release") and holder == w) or (action == "reap" and late)
        if ok:
            state[r] = (None, None) if action in ("release", "reap") else (w, at + 20)
        want.append((r, at, w, action, ok, *state.get(r, (None, None))))
    found = workflow.lease_log(spark.createDataFrame(rows, "resource string, at double, worker string, action string"), 20.0)
    assert got(found, *found.columns) == sorted(want, key=repr)


def test_leaders_and_farthest_picks(spark):
    rng = np.random.default_rng(6)
    rows = [(i, i % 3, rng.normal(size=4).tolist()) for i in range(90)] + [(90, 0, rng.normal(size=4).tolist())]
    df = spark.createDataFrame([*rows, (91, 1, None), (None, 1, [0.0] * 4)], "id long, label int, v array<double>")
    want, picks = [], []
    for label in range(3):
        own, led = [(i, np.array(v)) for i, lab, v in rows if lab == label], []
        for i, v in own:
            hit = next((j for j, x in led if x @ v >= 1.0), i)
            led += [(i, v)] if hit == i else []
            want.append((i, hit))
        chosen = [own[0]]
        while len(chosen) < 4:
            chosen.append(max(own, key=lambda x: (round(min(((x[1] - c) ** 2).sum() for _, c in chosen), 9), -x[0])))
        picks += [(label, i, k + 1) for k, (i, _) in enumerate(chosen)]
    assert got(vectors.leaders(df, 1.0), "id", "leader") == sorted(want, key=repr)
    assert got(vectors.farthest_first(df, 4), "label", "id", "rank") == sorted(picks, key=repr)


def test_blocks_give_what_all_pairs_give(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(150, 3))
    df = spark.createDataFrame([(i, i % 4, x[i].tolist()) for i in range(150)], "id long, label int, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if i % 4 == j % 4 and round(float(u[i] @ u[j]), 6) >= 0.9}
    monkeypatch.setattr(vectors, "BLOCK", 20)
    found = vectors.similar_pairs(df, 0.9)
    assert {(r["id"], r["other"]) for r in found.collect()} == want
    top = vectors.top_k(df.where("id % 10 = 0"), df, 3).collect()
    for q in range(0, 150, 10):
        s = [(-round(float(x[q] @ x[i]), 9), i) for i in range(150) if i != q]
        assert [r["id"] for r in sorted(top, key=lambda r: r["rank"]) if r["query_id"] == q] == [i for _, i in sorted(s)[:3]]


def test_similar_pairs_of_clusters_skip_most_pairs_of_blocks(spark, monkeypatch):
    """Forty clusters, two labels, copies, a zero vector and nulls: the pairs of all pairs from few pairs of blocks."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    x = np.repeat(centres, 30, axis=0) + 0.05 * rng.normal(size=(1200, 16))
    x[5] = x[4]
    rows = [(i, None if i == 9 else int(i % 60 < 30), x[i].tolist()) for i in range(1200)] + [(1200, 1, [0.0] * 16), (1201, 1, None), (None, 1, x[0].tolist()), (1202, 1, [float("nan")] * 16), (1203, 1, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "id long, label int, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    label = np.array([-1 if i == 9 else int(i % 60 < 30) for i in range(1200)])
    ok = label >= 0
    near = np.triu((s >= 0.9) & (label[:, None] == label) & ok[:, None] & ok, 1)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    found = vectors.similar_pairs(df, 0.9)
    assert sorted((r["id"], r["other"]) for r in found.collect()) == sorted(zip(*(a.tolist() for a in np.nonzero(near)), strict=True)) and near.sum() > 10_000
    held, of = vectors.block_pairs(df.where("label is not null"), 0.9, "label")
    assert held < of / 4  # 640 of 3,027
    # The nearest of the other label, if it is near enough at all.
    other = np.where((label[:, None] != label) & ok[:, None] & ok, s, -2)
    want = {i: (max(j for j in range(1200) if other[i, j] == other[i].max()), other[i].max()) for i in range(1200) if other[i].max() >= 0.3}
    got_other = {r["id"]: (r["other"], r["sim"]) for r in vectors.nearest_of_other_classes(df, 0.3).collect()}
    assert got_other == {i: (j, float(x)) for i, (j, x) in want.items()} and want


def test_a_vector_is_copied_for_each_bundle_it_meets_not_for_each_block(spark, monkeypatch):
    x = np.random.default_rng(11).normal(size=(400, 24))
    df = spark.createDataFrame([(i, i % 3, x[i].tolist()) for i in range(400)], "id long, label int, v array<double>")
    monkeypatch.setattr(vectors, "BLOCK", 10)
    monkeypatch.setattr(vectors, "BUNDLES", 4)
    monkeypatch.setattr(vectors, "BUNDLE", 1000)
    sizes = spark.sparkContext.accumulator(0)
    found = vectors._near_blocks(df.withColumn("all", F.lit(0)), 0.3, "all", lambda a, b, s: a[["id"]], "id long", lambda f: sizes.add(1) or f).count()
    assert sizes.value == 10 and found > 400  # four bundles meet themselves and each other
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    s[np.arange(400)[:, None] % 3 == np.arange(400) % 3] = -2
    want = {i: (max(j for j in range(400) if s[i, j] == s[i].max()), float(s[i].max())) for i in range(400) if s[i].max() >= 0.3}
    assert {r["id"]: (r["other"], r["sim"]) for r in vectors.nearest_of_other_classes(df, 0.3).collect()} == want


def test_asof_takes_the_latest_before_and_none_before_the_first(spark):
    left = spark.createDataFrame([(1, 5), (1, 10), (1, 1), (2, 7)], "k int, t int")
    right = spark.createDataFrame([(1, 5, "x"), (1, 8, "y"), (3, 1, "z")], "k int, s int, v string")
    assert got(joins.asof_join(left, right, ["k"], "t", "s", ["v"]), "k", "t", "v") == [(1, 1, None), (1, 10, "y"), (1, 5, "x"), (2, 7, None)]


def test_range_join_includes_both_ends(spark):
    points = spark.createDataFrame([(0,), (10,), (20,), (21,)], "t int")
    spans = spark.createDataFrame([(10, 20)], "a int, b int")
    df = joins.range_join(points, spans, "t", "a", "b", 7)
    assert got(df, "t") == [(10,), (20,)]
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()


def test_islands_boundary_and_interval_merge(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 6, 8), ("a", 20, 21), ("b", 1, 2)], "k string, s int, e int")
    assert got(sequence.merge_intervals(df, ["k"], "s", "e", 1), "k", "s", "e", "parts") == [("a", 0, 8, 2), ("a", 20, 21, 1), ("b", 1, 2, 1)]


def test_evict_until_budget(spark):
    df = spark.createDataFrame([(1, 10), (2, 10), (3, 10)], "at int, size int").withColumn("k", F.lit(0))
    assert got(sequence.evict_until_budget(df, ["k"], ["at"], "size", 15), "at") == [(1,), (2,)]
    assert got(sequence.evict_until_budget(df, ["k"], ["at"], "size", 30), "at") == []


def test_upsert_keeps_what_the_source_lacks_and_the_guard_forbids(spark):
    t = spark.createDataFrame([(1, "a", 0), (2, "b", 1)], "k int, v string, locked int")
    s = spark.createDataFrame([(1, None, 0), (2, "n", 0), (3, "c", 0)], "k int, v string, locked int")
    assert got(merge.upsert(t, s, ["k"], ["v", "locked"], F.col("t.locked") == 0), "k", "v") == [(1, "a"), (2, "b"), (3, "c")]


def test_rate_has_no_evidence_no_value(spark):
    df = spark.createDataFrame([(0, 0), (1, 2)], "a int, b int")
    assert got(df.select(sc.rate(F.col("a"), F.col("b")).alias("r")), "r") == [(0.5,), (None,)]


@pytest.mark.parametrize(("text", "slug"), [("Team  A!", "team-a"), ("--", "unknown"), ("", "unknown"), ("x-Y", "x-y")])
def test_slug(spark, text, slug):
    assert spark.range(1).select(sc.slugify(F.lit(text))).first()[0] == slug


def test_texts_and_times(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(sc.clean_title(F.lit("[DROPS] (x) Final | #tag"))) == "Final"
    assert one(sc.iso_duration_seconds(F.lit("PT1H42M30S"))) == 6150
    assert one(sc.clock_seconds(F.lit("1:02:03"))) == 3723
    assert one(sc.short_code(F.lit("ab cdefg"))) == "ABCDE"
    assert one(sc.title_number(F.lit("Stage 2 Week 3 Day 2"), "week")) == 3
    assert one(sc.title_number(F.lit("no numbers"), "week")) is None
    assert one(sc.norm_contains(F.lit("abc"), F.lit(""))) is False
    assert one(tables.unwrap_js(F.lit('window.X = {"a": {"b": 1}};'))) == '{"a": {"b": 1}}'


def test_sources_and_sinks(spark, tmp_path):
    assert tables.scan_or_empty(spark, f"{tmp_path}/none", "a int").count() == 0
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nbroken\n')
    assert {r["a"] for r in tables.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").collect()} == {1, None}
    (tmp_path / "doc.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert got(tables.read_json_document(spark, str(tmp_path / "doc.json"), "a int"), "a") == [(1,), (2,)]
    (tmp_path / "feed.xml").write_text("<feed><entry><id>1</id></entry><entry><id>2</id></entry></feed>")
    assert got(tables.read_feed(spark, str(tmp_path / "feed.xml"), "id int"), "id") == [(1,), (2,)]
    assert tables.list_files(spark, str(tmp_path), "*.json").count() == 1
    df = spark.createDataFrame([(2, "b"), (1, "a")], "id int, v string")
    out = sinks.payload({"rows": df}, {"rows": ["id"]})
    assert out.first()[0] == '{"rows":[{"id":1,"v":"a"},{"id":2,"v":"b"}]}'
    sinks.write_script(out, str(tmp_path / "js"), "window.X")
    assert spark.read.text(str(tmp_path / "js")).first()[0].startswith("window.X = {")
    assert sinks.differences(df, df).count() == 0


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, 1, f"2024-01-01 00:{i:02d}:00", "a" if i < 5 else "b") for i in range(10)]
    df = spark.createDataFrame(rows, "id long, user long, at string, v string").withColumn("at", F.col("at").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: streams.event_stream(spark, str(tmp_path / "in"), "id long, user long, at timestamp, v string", "at")
    windows = streams.collect_all(streams.tumbling(stream(), "at", "5 minutes", "1 hour"), "tumbling_t")
    assert sorted(r["n"] for r in windows.collect()) == [5, 5]
    slid = streams.collect_all(streams.sliding(stream(), "at", "4 minutes", "2 minutes", "1 hour"), "sliding_t")
    batch = df.groupBy(F.window("at", "4 minutes", "2 minutes")).agg(F.count("*").alias("n"))
    assert got(slid, "window", "n") == got(batch, "window", "n")
    runs = streams.collect_all(streams.sessions(stream(), "user", "at", "90 seconds", "1 minute"), "sessions_t")
    assert [r["n"] for r in runs.collect()] == [10]
    df.unionByName(df).coalesce(1).write.parquet(str(tmp_path / "twice"))
    twice = streams.event_stream(spark, str(tmp_path / "twice"), "id long, user long, at timestamp, v string", "at")
    assert streams.collect_all(streams.once(twice, ["id"], "at", "1 hour"), "once_t", "append").count() == 10


LEDGER = "id long, first_seen long, last_seen long, v string"


def test_a_stream_accumulates_into_a_ledger_once(spark, tmp_path):
    schema, source = "id long, v string", tmp_path / "in"
    ledger = bucketed.BucketedTable.create(spark, str(tmp_path / "ledger"), LEDGER, ["id"], 64)
    for part, rows in enumerate(([(1, "a"), (1, "b"), (2, "c"), (None, "x")], [(2, "d"), (3, "e")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source / str(part)))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(source))
        streams.accumulate(stream, ledger, "id", ["v"], str(tmp_path / "ck"))
    want = [(1, 0, 0, "b"), (2, 0, 1, "d"), (3, 1, 1, "e")]
    assert got(ledger.read(), "id", "first_seen", "last_seen", "v") == want
    # The same batches from the start: the ledger knows them.
    streams.accumulate(stream, ledger, "id", ["v"], str(tmp_path / "another"))
    assert got(ledger.read(), "id", "first_seen", "last_seen", "v") == want and ledger.versions() == [0, 1, 2]


def upserted(old, new):
    return merge.upsert(old, new, ["id"], ["v"])


def test_a_merge_rewrites_the_buckets_of_its_keys(spark, tmp_path):
    table = bucketed.BucketedTable.create(spark, str(tmp_path / "t"), "id long, v string", ["id"], 32)
    with pytest.raises(bucketed.Conflict):
        bucketed.BucketedTable.create(spark, str(tmp_path / "t"), "id long, v string", ["id"], 32)
    assert table.read().count() == 0
    rows = lambda *x: spark.createDataFrame(list(x), "id long, v string")
    first = table.merge(spark.range(1000).select("id", F.lit("old").alias("v")), upserted)
    assert first["version"] == 1 and len(first["touched"]) == 32
    second = table.merge(rows((3, "new"), (2000, "new"), (5, None)), upserted)
    before, after = table.record(1)["files"], table.record(2)["files"]
    changed = {int(b) for b in after if after[b] != before.get(b)}
    assert changed == set(second["touched"]) and 1 <= len(changed) <= 3
    assert table.read().count() == 1001 and got(table.read().where("v = 'new'"), "id", "v") == [(2000, "new"), (3, "new")]
    assert table.read(1).where("v = 'new'").count() == 0
    # All rows of a bucket go; nothing touches nothing; a key that `how` makes up is refused.
    gone = table.merge(rows((3, "")), lambda old, new: old.where("false"))
    assert str(gone["touched"][0]) not in table.record(3)["files"]
    assert table.merge(rows(), upserted)["version"] == 3
    with pytest.raises(bucketed.Refused, match="other buckets"):
        table.merge(rows((4, "x")), lambda old, new: old.unionByName(rows(*((i, "y") for i in range(50)))))
    assert table.versions() == [0, 1, 2, 3]
    assert table.vacuum(keep=2, idle_seconds=3600) == [] and table.versions() == [2, 3]
    table.merge(rows(*((i, "all") for i in range(400))), upserted)  # every bucket: the three drafts before are named by no record
    assert len(table.vacuum(keep=1, idle_seconds=0)) == 3 and table.versions() == [4] and table.read().where("v = 'all'").count() == 400
    with pytest.raises(ValueError, match="no version 1"):
        table.read(1)


def test_of_two_writers_of_a_bucket_one_is_refused(spark, tmp_path):
    one = bucketed.BucketedTable.create(spark, str(tmp_path / "t"), "id long, v string", ["id"], 8)
    other = bucketed.BucketedTable(spark, str(tmp_path / "t"))
    one.merge(spark.range(100).select("id", F.lit("old").alias("v")), upserted)
    bucket = {r["id"]: r["b"] for r in spark.range(100).select("id", F.pmod(F.xxhash64("id"), F.lit(8)).alias("b")).collect()}
    same = next(i for i in range(1, 100) if bucket[i] == bucket[0])
    apart = next(i for i in range(1, 100) if bucket[i] != bucket[0])
    rows = lambda i, v: spark.createDataFrame([(i, v)], "id long, v string")

    def meanwhile(i):
        def how(old, new):
            other.merge(rows(i, "theirs"), upserted)
            return upserted(old, new)

        return how

    assert one.merge(rows(0, "mine"), meanwhile(apart))["version"] == 3  # after the other's version 2, whose rows stay
    assert got(one.read().where("v <> 'old'"), "id", "v") == sorted([(0, "mine"), (apart, "theirs")])
    with pytest.raises(bucketed.Conflict):
        one.merge(rows(0, "mine again"), meanwhile(same))
    assert got(one.read().where("v <> 'old'"), "id", "v") == sorted([(0, "mine"), (apart, "theirs"), (same, "theirs")])
    assert one.read().count() == 100
    drafts = {f.split("/")[0] for v in one.versions() for f in one.record(v)["files"].values()}
    assert set(one._list("data")) == drafts  # the refused draft is gone


def test_checks_are_counted_while_a_version_is_written(spark, tmp_path):
    table = bucketed.BucketedTable.create(spark, str(tmp_path / "t"), "id long, v string", ["id"], 4)
    checks = {"has value": F.col("v").isNotNull(), "short": F.length("v") < 4}
    rows = spark.createDataFrame([(1, "ok"), (2, None), (3, "long one"), (None, "key")], "id long, v string")
    with pytest.raises(bucketed.Refused, match="'has value': 1, 'short': 2"):
        table.merge(rows, lambda old, new: new, checks=checks)
    assert table.versions() == [0] and table._list("data") == []
    done = table.merge(rows, lambda old, new: new, checks=checks, strict=False)
    assert done["violations"] == {"has value": 1, "short": 2} and table.read().count() == 4


def test_a_numbered_version_is_published_once(spark, tmp_path):
    path = str(tmp_path / "p")
    assert sinks.publish(spark.range(3), path, number=1) == 1
    assert sinks.publish(spark.range(9), path, number=1) == 1 and sinks.current(spark, path).count() == 3


def test_identities_equal_a_fold_over_their_sightings(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(9), i, rng.choice([None, "", "a", "b", "c", "The Academy"]), rng.choice([None, "", "Unknown", "EU", "NA"]), rng.choice([None, None, "x1", "x2"]), rng.choice([None, "", "s1", "s2"])) for i in range(150)]
    rows += [(50, 900, None, None, None, None), (None, 901, "n", "EU", "x", "s"), (51, 902, "", "NA", None, None), (51, 903, "late", "Unknown", None, None)]
    want, place = {}, Counter()
    for key, _, name, region, external, authority in sorted((r for r in rows if r[0] is not None), key=lambda r: r[:2]):
        place[key] += 1
        unsigned = any(m in f" {(name or '').lower()} " for m in quality.UNSIGNED)
        own = want.get(key)
        if own is None:
            own = want[key] = {"name": name or str(key), "previous": [], "region": region or "Unknown", "conflict": False, "status": "unsigned" if unsigned else "active", "external": None, "authority": None, "verified": None}
        else:
            if name and name != own["name"]:
                own["previous"] += [own["name"]] if own["name"] not in own["previous"] else []
                own["name"] = name
            if region and own["region"] not in ("Unknown", region):
                own["conflict"] = True
            elif region and own["region"] == "Unknown":
                own["region"] = region
            own["status"] = "unsigned" if unsigned else own["status"]
        own["external"], own["authority"] = own["external"] or external or None, own["authority"] or authority or None
        own["verified"] = own["verified"] or (place[key] if external else None)
    df = spark.createDataFrame(rows, "id int, at int, name string, region string, external string, authority string")
    found = {r["id"]: {k: list(v) if k == "previous" else v for k, v in r.asDict().items() if k != "id"} for r in quality.identities(df, "id", ["at"]).collect()}
    assert found == want and any(w["conflict"] for w in want.values()) and any(len(w["previous"]) > 2 for w in want.values())
    assert quality.identities(df.where("false"), "id", ["at"]).count() == 0


def test_reports_name_every_check_and_strict_fails_on_warnings(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, v string")
    parts = lambda x: [(x, {"no value": ("WARN", F.count_if(F.col("v").isNull())), "large": ("ERROR", F.sum((F.col("id") > 5).cast("int")))})]
    found = quality.report(parts(df))
    assert got(found, "name", "n", "severity") == [("large", 0, "OK"), ("no value", 1, "WARN")]
    assert [quality.verdict(found, strict).first()["result"] for strict in (False, True)] == ["PASS", "FAIL"]
    assert got(quality.report(parts(df.where("false"))), "n", "severity") == [(0, "OK"), (0, "OK")]
    there = quality.known(df, "id", spark.createDataFrame([(1,), (1,), (None,)], "k int"), "k", "has")
    assert got(there, "id", "has") == [(1, True), (2, False), (3, False)]


def test_windows_around_marks_on_streams_equal_the_join(spark, tmp_path):
    """Rows come out of order over three batches; one comes far too late and is counted."""
    rng = random.Random(3)
    points = [(rng.randrange(3), float(10 * i + rng.randrange(10)), i) for i in range(90)]
    marks = [(rng.randrange(3), float(t), t) for t in range(5, 900, 60)]
    late = (0, 20.0, 999)
    for name, rows in (("points", points), ("marks", marks)):
        placed = [(min(2, max(0, int((r[1] + rng.uniform(-15, 15)) // 300))), r) for r in rows] + ([(2, late)] if name == "points" else [])
        for part in range(3):
            own = [r for p, r in placed if p == part]
            spark.createDataFrame(own, f"k int, s double, {name} int").coalesce(1).write.parquet(str(tmp_path / name / str(part)))
    timed = lambda df, at: df.withColumn(at, F.timestamp_seconds("s")).drop("s")
    read = lambda name, at: timed(spark.readStream.schema(f"k int, s double, {name} int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / name)), at)
    joined = streams.around(read("points", "at"), read("marks", "mark_at"), "k", "at", "mark_at", "2 seconds", "62 seconds", "40 seconds")
    query = joined.writeStream.format("memory").queryName("around_t").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    want = sorted((p, m) for k, t, p in points for j, s, m in marks if k == j and s - 2 <= t <= s + 62)
    assert sorted((r["points"], r["marks"]) for r in spark.table("around_t").collect()) == want and len(want) > 30
    assert streams.late_rows(query) == 1
    tables = (timed(spark.createDataFrame(rows, f"k int, s double, {name} int"), at) for name, rows, at in (("points", points, "at"), ("marks", marks, "mark_at")))
    assert sorted((r["points"], r["marks"]) for r in streams.around(*tables, "k", "at", "mark_at", "2 seconds", "62 seconds", "40 seconds").collect()) == want


def plain_grid(xs, box, low, high):
    best = None
    xs = sorted({x for x in xs if x is not None and low <= x <= high})
    for i, x in enumerate(xs):
        for y in xs[i + 1 :]:
            for k in range(1, 5):
                pitch = (y - x) / k
                if not box * 1.0 <= pitch <= 2.2 * box:
                    continue
                for m in range(5):
                    start, p = round(x - m * pitch, 6), round(pitch, 6)
                    if start - box / 2 < low - 0.6 * box or start + 4 * p + box / 2 > high + 0.6 * box:
                        continue
                    off = [min(abs(c - (start + j * p)) for c in xs) for j in range(5)]
                    held = [o for o in off if o <= 0.34 * p]
                    key = (-len(held), round(sum(held), 6), start, p)
                    best = key if best is None or key < best else best
    return best if best and best[0] <= -2 else None


def test_a_grid_is_that_of_all_hypotheses(spark):
    rng = random.Random(12)
    points = {k: [round(20 + 31.5 * j + rng.uniform(-4, 4), 2) for j in range(5) if rng.random() < 0.8] + [round(rng.uniform(0, 200), 2) for _ in range(rng.randrange(6))] for k in range(25)}
    points |= {25: [], 26: [50.0], 27: [50.0, 50.0], 28: [10.0, 30.0, None, 500.0], 29: [10.0, 199.0]}
    df = spark.createDataFrame([(k, x) for k, xs in points.items() for x in xs] + [(None, 5.0)], "k int, x double").withColumn("m", F.lit("z"))
    found = {r["k"]: (-r["support"], r["residual"], r["start"], r["pitch"]) for r in fit.grid_fit(df, "k", "x", 20.0, 0.0, 200.0).collect()}
    want = {k: g for k, xs in points.items() if (g := plain_grid(xs, 20.0, 0.0, 200.0))}
    assert found == want and len(want) > 20 and {26, 27, 29}.isdisjoint(want)


def test_a_grid_of_many_points_is_dealt_in_shares_and_no_hypothesis_is_shuffled(spark, monkeypatch):
    rng = random.Random(5)
    points = {k: sorted({round(rng.uniform(0, 200), 2) for _ in range(n)}) for k, n in ((1, 60), (2, 30), (3, 7))}
    df = spark.createDataFrame([(k, x) for k, xs in points.items() for x in xs], "k int, x double")
    want = {k: plain_grid(xs, 20.0, 0.0, 200.0) for k, xs in points.items()}
    monkeypatch.setattr(fit, "PAIRS", 100)
    found = fit.grid_fit(df, "k", "x", 20.0, 0.0, 200.0)
    assert {r["k"]: (-r["support"], r["residual"], r["start"], r["pitch"]) for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and not any("start" in line for line in plan.splitlines() if "Exchange hashpartitioning" in line)


@pytest.mark.parametrize("k", [1, 5, 40])
def test_the_best_entries_are_those_of_all(spark, k):
    rng = random.Random(k)
    word = lambda: rng.choice(["all"] * 5 + [f"w{int(rng.paretovariate(0.7)) % 90}" for _ in range(4)])
    text = lambda n: None if rng.random() < 0.05 else rng.choice([" ", "-", "  "]).join(rng.choice([str.upper, str.lower])(word()) for _ in range(rng.randrange(n)))
    entries = [(rng.choice("xy"), i, text(4), text(6), text(3)) for i in range(400)]
    asked = [(i, text(5)) for i in range(40)] + [(100, ""), (101, None), (102, "unknown"), (None, "all"), (103, "all")]
    found = search.top_entries(spark.createDataFrame(entries, "kind string, id int, label string, terms string, sub string"), spark.createDataFrame(asked, "query int, text string"), k)
    cut = lambda t: set((t or "").lower().replace("-", " ").split())
    want = []
    for q, t in asked:
        scores = [(-sum(w * len(cut(t) & cut(f)) for w, f in zip((6, 3, 1), e[2:], strict=True)), e[0], e[1]) for e in entries] if q is not None else []
        want += [(q, r + 1, kind, i, -s) for r, (s, kind, i) in enumerate(sorted(x for x in scores if x[0])[:k])]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_entries_and_queries_of_the_same_tokens_are_compared_once(spark):
    entries = spark.range(20_000).select(F.lit("x").alias("kind"), "id", F.concat(F.lit("thing "), F.col("id").cast("string"), F.lit(" w"), (F.col("id") % 5).cast("string")).alias("label"), F.lit("all").alias("terms"), F.lit(None).cast("string").alias("sub"))
    queries = spark.range(2_000).select(F.col("id").alias("query"), F.concat(F.lit("Thing all w"), (F.col("id") % 4).cast("string")).alias("text"))
    asked = queries.select(search.tokens(F.col("text")).alias("tokens"))
    profiles = search._profiles(entries, asked, 3, list(search.WEIGHTS))
    # w4 is asked by none, and only the entries under the numbers asked differ from others of their kind.
    assert profiles.count() == 5 and max(len(r["members"]) for r in profiles.collect()) == 3
    found = search.top_entries(entries, queries, 3).collect()
    assert len(found) == 6_000 and {(r["id"] - r["query"] % 4, r["rank"], r["score"]) for r in found} == {(0, 1, 15), (5, 2, 15), (10, 3, 15)}


def test_publish_verifies_and_prunes(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.range(5).withColumn("m", F.create_map(F.lit("a"), "id"))
    assert [sinks.publish(df, path, keep=2) for _ in range(3)] == [0, 1, 2]
    assert sinks.versions(spark, path) == [1, 2] and sinks.current(spark, path).count() == 5
    sinks.verify(spark, f"{path}/v2")
    spark.range(1).withColumn("m", F.create_map(F.lit("a"), "id")).write.mode("append").parquet(f"{path}/v2/rows")
    with pytest.raises(ValueError, match="manifest"):
        sinks.verify(spark, f"{path}/v2")
    assert sinks.current(spark, f"{path}-none", "a int").count() == 0
    for day, n in (("d1", 3), ("d2", 4), ("d1", 5)):
        sinks.append_snapshot(spark.range(n), str(tmp_path / "h"), day)
    assert got(spark.read.parquet(str(tmp_path / "h")).groupBy("day").count(), "day", "count") == [("d1", 5), ("d2", 4)]


def test_a_silent_key_is_reported_once(spark, tmp_path):
    schema = "worker string, at timestamp"
    beats = [[("a", 0), ("b", 0), ("a", 60)], [("b", 400)], [("b", 800)], [("a", 1200)]]
    for part, rows in enumerate(beats):
        spark.createDataFrame(rows, "worker string, s long").select("worker", F.timestamp_seconds("s").alias("at")).coalesce(1).write.parquet(str(tmp_path / f"in/{part}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        streams.stale_keys(stream, "worker", "at", "90 seconds", "0 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    found = sorted((r["worker"], int(r["last_at"].timestamp())) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert ("a", 60) in found and all(x in [("a", 60), ("b", 0), ("b", 400), ("b", 800)] for x in found) and len(found) == len(set(found))


def test_nested_documents(spark):
    doc = {"a": [{"id": 1, "Date": "x", "in": {"ID": 2, "date": "y"}}, 5, None], "id": 3}
    rows = spark.createDataFrame([(1, json.dumps(doc)), (2, "{broken"), (3, None), (4, "[]"), (None, "{}")], "k int, d string")
    found = nested.walk_json(rows, "k", "d", (("id",), ("date",)))
    assert got(found, "k", "path", "depth") == [(1, "$.a[0]", 2), (1, "$.a[0].in", 3)]
    assert got(nested.walk_json(rows, "k", "d", (("id",), ("date",)), 2), "path") == [("$.a[0]",)]
    deep = "[" * 500 + '{"id": 1, "date": 2}' + "]" * 500
    assert nested.walk_json(spark.createDataFrame([(1, deep)], "k int, d string"), "k", "d", (("id",),), 10_000).count() == 1
    html = '<script type="application/json">{"x": {"teams": 1}}</script><script id="__NEXT_DATA__">{"a": {"b": 1}}</script>'
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(nested.embedded_state(F.lit(html), ("teams",))) == '{"teams":1}'
    assert one(nested.embedded_state(F.lit("<html/>"), ("teams",))) is None


def test_paged_source_uses_its_cache(spark):
    def transport(url):
        return (200, json.dumps({"items": [1, 2]}), None) if "offset=0" in url else (200, "[]" if "offset=2" in url and "/odd" in url else json.dumps({"items": [3]}), None)

    resources = spark.createDataFrame([("x", "http://h/x"), ("odd", "http://h/odd")], "resource string, url string")
    first = paged.read_pages(resources, transport, page_size=2)
    assert got(first, "resource", "page", "status", "error") == [("odd", 0, 200, None), ("odd", 1, 200, "no JSON object"), ("x", 0, 200, None), ("x", 1, 200, None)]
    again = paged.read_pages(resources, transport, page_size=2, cached=first.where("error is null"))
    assert got(paged.account(again, "d", 1), "resource", "requests", "errors", "left") == [("odd", 1, 1, 0), ("x", 0, 0, 1)]


@pytest.mark.parametrize("partitions", [1, 3])
def test_sessions_count_whole_seconds_and_rows_without_a_time(spark, tmp_path, partitions):
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    rows = [(1, at(0.9)), (1, at(3600.95)), (1, at(7202.1)), (2, at(0.2)), (2, at(3601.1)), (3, None), (4, at(5)), (4, None), (4, at(9000)), (None, at(1))]
    spark.createDataFrame(rows, "user_id long, ts timestamp_ntz").repartition(partitions).write.parquet(str(tmp_path / "events.parquet"))
    found = plans.QUERIES["session_counts"](spark, str(tmp_path)).collect()
    assert {(r["user_id"], r["sessions"], r["n"]) for r in found} == {(1, 2, 3), (2, 2, 2), (3, 1, 1), (4, 2, 3), (None, 1, 1)}


def test_shares_of_the_appearances_grow_with_the_lines(spark):
    tables_ = tables.Tables(spark, DATA)
    few = composition.appearances(tables_).rdd.getNumPartitions()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        scan = tables_.lineitem.rdd.getNumPartitions()
        assert scan > 1 and composition.appearances(tables_).rdd.getNumPartitions() == composition.SHARES * scan > few
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_line_ups_hold_few_keys_of_a_batch_at_a_time(spark, monkeypatch):
    able = spark.range(50).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("slot")).withColumn("role", F.get(F.array(*map(F.lit, ("Tank", "Damage", "Damage", "Support", "Support"))), F.col("slot")))
    able = able.select("k", "slot", F.concat(F.lit("h"), F.col("slot").cast("string")).alias("value"), "role", (F.col("k") / 100 + 0.4).alias("score")).coalesce(1)
    reads = able.select("k", "slot", "value", "score")
    monkeypatch.setattr(roles, "KEYS", 7)
    found = roles.line_ups(reads, able, "k").collect()
    assert sorted((r["k"], r["slot"], r["value"], r["valid"]) for r in found) == [(k, i, f"h{i}", True) for k in range(50) for i in range(5)]
    assert "MapInArrow" in roles.line_ups(reads, able, "k")._jdf.queryExecution().executedPlan().toString()


def test_additive_score_normalises_a_text_once_for_all_its_rules(spark):
    plan = plans.QUERIES["additive_score_reasons"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1 and "aggregate(" not in plan


def test_additive_score_of_odd_texts_and_unknown_parts(spark):
    names = ["one", "Two-2", "cup!", "room", ""]
    texts = [None, "", "  ", "one--two  2", "ONE\ttwo 2 (Cup)", "room\U0001f600one", "straße Two 2", "o ne", "-one-", "grand\nfinal day"]
    rows = [(i, x, h, s) for i, (x, (h, s)) in enumerate(itertools.product(texts, [(None, None), (0.5, 1200), (12.0, 1199), (48.5, 0)]))]
    df = spark.createDataFrame(rows, "i int, raw string, h double, s long").withColumn("text", sc.norm_text(F.col("raw")))
    c = dict(zip(("team_a", "team_b", "competition", "room"), map(F.lit, names), strict=False)) | {"official": F.lit(None).cast("boolean"), "same_region": F.col("s") > 0, "same_language": F.lit(True), "both_live": F.lit(None).cast("boolean"), "seconds": F.col("s")}
    score, reasons = matching.additive_score(matching.broadcast_rules(F.col("text"), ("grand final", ""), F.col("h"), c))

    def plain(x):
        x = x and " ".join(filter(None, "".join(a if a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" else " " for a in x.upper()).split(" ")))
        return x

    def wanted(x, h, s):
        t = plain(x)
        has = lambda n: bool(plain(n)) and t is not None and plain(n) in t
        on = {
            "unofficial": True, "team a": has(names[0]), "team b": has(names[1]), "competition": has(names[2]), "title": has("grand final"), "region": s is not None and s > 0, "language": True, "room": has(names[3]),
            "time close": h == 0.5, "same day": h == 12.0, "time conflict": h == 48.5, "long enough": s == 1200, "too short": s in (0, 1199),
        }
        hit = [n for n in matching.SIGNALS if on.get(n)]
        return plain(x), sum(matching.SIGNALS[n] for n in hit), [f"{matching.SIGNALS[n]:+d} {n}" for n in hit]

    found = df.select("i", "text", score.alias("score"), reasons.alias("reasons")).collect()
    assert {r["i"]: (r["text"], r["score"], r["reasons"]) for r in found} == {i: wanted(x, h, s) for i, x, h, s in rows}
