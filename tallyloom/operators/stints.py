"""WIN-06/07: what a slot holds over time, from noisy reads; and rounds from the emblem that a frame shows."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.sequence import fold_sorted

# Reads that confirm a value; strong reads that do, and their score; seconds and mean margin of a confirming
# run; by how much it must beat the value that it replaces; the longest gap within a run; grace after a round's start.
CONFIRM, STRONG, STRONG_SCORE, STRONG_SPAN = 3, 2, 0.80, 2.0
MIN_SPAN, MIN_MARGIN, MIN_DISPLACE, MAX_GAP = 3.0, 0.05, 0.04, 20.0
SETUP_EDGE, GRACE, RECHECK = 2.0, 30.0, 30.0
# Similarity of equal emblems, reads of the shortest segment, seconds of the shortest round, gap between rounds.
SAME_EMBLEM, MIN_SEGMENT, MIN_ROUND, ROUND_GAP = 0.60, 4, 45.0, 25.0

#: A read: key, time, value, score, margin, and what each value scored there.
READ = "t double, value string, score double, margin double, scores map<string,double>"
OUT = "kind string, value string, other string, t double, end double, reads long, mean double, least double, margin double, reason string, early boolean, stands boolean"
#: What a slot reads in one sorted pass: setup spans (0) and rounds (1) of its map, and its own reads (2), by the time from which they count.
TAGGED = f"at double, tag int, {READ}, until double"


@dataclass
class Run:
    """Reads of one value in a row, as sums: it never holds the reads themselves."""

    value: str
    start: float
    last: float = 0.0
    reads: int = 0
    score: float = 0.0
    least: float = 1e9
    margin: float = 0.0
    over: float = 0.0
    compared: int = 0
    setup: bool = False
    round: tuple[float, float | None] | None = None

    def add(self, t: float, score: float, margin: float, against: float | None) -> None:
        self.last, self.reads = t, self.reads + 1
        self.score, self.least, self.margin = self.score + score, min(self.least, score), self.margin + margin
        if against is not None:
            self.over, self.compared = self.over + score - against, self.compared + 1

    def grace(self) -> tuple[bool, bool]:
        """early: it began within GRACE of its round's start; stands: unless early and gone before GRACE + RECHECK of a round
        that went on longer."""
        if self.round is None or self.start - self.round[0] > GRACE:
            return False, True
        deadline = self.round[0] + GRACE + RECHECK
        return True, self.last >= deadline or (self.round[1] is not None and self.round[1] < deadline)

    def doubt(self) -> str | None:
        """Why the run doesn't confirm its value, or None if it does."""
        span = self.last - self.start
        strong = self.reads >= STRONG and span >= STRONG_SPAN and self.least >= STRONG_SCORE
        if not strong and self.reads < CONFIRM:
            return "few-reads"
        if not strong and span < MIN_SPAN:
            return "short-span"
        if self.margin / self.reads < MIN_MARGIN:
            return "small-margin"
        if self.compared and self.over / self.compared < MIN_DISPLACE:
            return "not-displaced"
        return None


@dataclass
class Slot:
    """The state of one slot between reads: what it holds, the run that may replace it, and the phase of its map.

    Of the setup spans that have begun the latest end is enough to tell whether a time lies in one; of the rounds the last
    that has begun is the one of any run that begins now.
    """

    held: Run | None = None
    rival: Run | None = None
    setup_until: float = float("-inf")
    round: tuple[float, float | None] | None = None

    def take(self, row: tuple) -> Iterator[tuple]:
        """One row of TAGGED, in the order of at and tag; yields what it settles: rows of OUT."""
        _, tag, t, value, score, margin, scores, until = row
        if tag == 0:
            self.setup_until = max(self.setup_until, until + SETUP_EDGE)
        elif tag == 1:
            self.round = (t, None if until is None or until != until else until)
        else:
            yield from self.read(t, value, score, margin, dict(scores or {}))

    def read(self, t: float, value: str, score: float, margin: float, scores: dict[str, float]) -> Iterator[tuple]:
        """One read; yields what it settles: rows of OUT."""
        if self.held is not None and value == self.held.value:
            if self.rival is not None:
                yield self._rejected("returned")
            self.held.add(t, score, margin, None)
            return
        if self.rival is not None and self.rival.value != value:
            if self.held is not None:
                yield self._rejected("interrupted")
            self.rival = None
        if self.rival is not None and self.held is not None and t - self.rival.last > MAX_GAP:
            self.rival = None
        if self.rival is None:
            self.rival = Run(value, t, setup=t <= self.setup_until, round=self.round)
        against = None if self.held is None or not scores else scores.get(self.held.value, -1.0)
        self.rival.add(t, score, margin, against)
        doubt = self.rival.doubt()
        if doubt is None:
            run = self.rival
            if self.held is not None:
                yield self._stint(self.held)
                yield self._row("setup-change" if run.setup else "swap", run, self.held.value, None)
            self.held, self.rival = run, None
        elif self.held is not None and self.rival.reads >= CONFIRM + 2 and self.rival.last - self.rival.start > MIN_SPAN:
            yield self._rejected(doubt)

    def close(self) -> Iterator[tuple]:
        """What stays open at the end of the track."""
        if self.rival is not None:
            yield self._rejected("unresolved") if self.held is not None else self._event("unestablished", "few-reads")
        if self.held is not None:
            yield self._stint(self.held)

    @staticmethod
    def _row(kind: str, run: Run, other: str | None, reason: str | None) -> tuple:
        early, stands = run.grace() if kind == "stint" else (None, None)
        return kind, run.value, other, run.start, run.last, run.reads, run.score / run.reads, run.least, run.margin / run.reads, reason, early, stands

    def _stint(self, run: Run) -> tuple:
        return self._row("stint", run, None, None)

    def _event(self, kind: str, reason: str) -> tuple:
        run, self.rival = self.rival, None
        return self._row(kind, run, self.held.value if self.held else None, reason)

    def _rejected(self, reason: str) -> tuple:
        return self._event("rejected-swap", reason)

    def dump(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def load(state: str) -> Slot:
        fields = json.loads(state)
        for name in ("held", "rival"):
            if run := fields[name]:
                fields[name] = Run(**{**run, "round": tuple(run["round"]) if run["round"] else None})
        fields["round"] = tuple(fields["round"]) if fields["round"] else None
        return Slot(**fields)


@dataclass
class _Track:
    key: tuple
    slot: Slot = field(default_factory=Slot)


def tagged(reads: DataFrame, keys: list[str], setups: DataFrame | None = None, rounds: DataFrame | None = None, within: list[str] | None = None) -> DataFrame:
    """keys and TAGGED: the reads of every slot with the setup spans and rounds of its map.

    reads has `keys` and the columns of READ; setups and rounds have `within` (those of the keys that name a map; all of
    them if not given), start and end. Reads without a time or value, spans without a start, setups without an end and rows
    with a null key are left out; a round without an end is open. Spans are few against reads: they are copied to each slot
    of their map, the reads are not joined with anything.
    """
    within = keys if within is None else within
    names = [c.split()[0] for c in READ.split(", ")]
    value = lambda c, kind: F.lit(None).cast(kind).alias(c)
    out = reads.where("t is not null and value is not null").select(*keys, F.col("t").cast("double").alias("at"), F.lit(2).alias("tag"), *names, value("until", "double"))
    slots = reads.where("t is not null and value is not null").select(*keys).distinct()
    for tag, spans in ((0, setups), (1, rounds)):
        if spans is not None:
            own = spans.where("start is not null" + (" and end is not null" if tag == 0 else "")).select(*within, "start", "end")
            own = own if within == keys else own.join(slots, within)
            at = F.col("start") - SETUP_EDGE if tag == 0 else F.col("start")
            nothing = [value(c.split()[0], c.split()[1]) for c in READ.split(", ")[1:]]
            out = out.unionByName(own.select(*keys, at.cast("double").alias("at"), F.lit(tag).alias("tag"), F.col("start").cast("double").alias("t"), *nothing, F.col("end").cast("double").alias("until")))
    return out


ORDER = ["at", "tag", "value", "score", "until"]


def stints(reads: DataFrame, key: str | list[str], setups: DataFrame | None = None, rounds: DataFrame | None = None, within: list[str] | None = None) -> DataFrame:
    """Stints and events of every slot's track: the keys and the columns of OUT; arguments as of tagged().

    kinds: stint (what was held from t to end), swap and setup-change (a confirmed change at t, other being what it replaced;
    the latter if it begins within a setup span or two seconds of it), rejected-swap (a run that didn't confirm: it
    `returned`, was `interrupted`, stayed doubtful for CONFIRM + 2 reads, or is `unresolved` at the end) and unestablished.
    A stint is early if it began within GRACE of the latest round's start, and stands unless it then ended before RECHECK
    seconds more of a round that went on longer. Equal times go by value and score; of rounds that start together the one
    that ends last counts. One sorted pass over the tagged rows of a slot, which holds two runs whatever the track's length.
    """
    keys = [key] if isinstance(key, str) else list(key)

    def step(track: _Track, row: tuple) -> Iterator[tuple]:
        yield from ((*track.key, *out) for out in track.slot.take(row))

    def end(track: _Track) -> Iterator[tuple]:
        yield from ((*track.key, *out) for out in track.slot.close())

    rows = tagged(reads, keys, setups, rounds, within)
    return fold_sorted(rows, keys, ORDER, [c.split()[0] for c in TAGGED.split(", ")], _Track, step, end, f"{_kinds(reads, keys)}, {OUT}")


def open_slots(reads: DataFrame, key: str | list[str], setups: DataFrame | None = None, rounds: DataFrame | None = None, within: list[str] | None = None) -> DataFrame:
    """The keys and `state`, in which stints() leaves each track before it closes it: where a stream can go on."""
    keys = [key] if isinstance(key, str) else list(key)

    def step(track: _Track, row: tuple) -> Iterator[tuple]:
        for _ in track.slot.take(row):
            pass
        return iter(())

    rows = tagged(reads, keys, setups, rounds, within)
    end = lambda track: [(*track.key, track.slot.dump())]
    return fold_sorted(rows, keys, ORDER, [c.split()[0] for c in TAGGED.split(", ")], _Track, step, end, f"{_kinds(reads, keys)}, state string")


def _kinds(reads: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{k} {reads.schema[k].dataType.simpleString()}" for k in keys)


@dataclass
class _Timeline:
    """The emblems seen so far and the last three of their numbers, which the median is taken of."""

    key: object
    seen: list = field(default_factory=list)
    recent: list = field(default_factory=list)
    segment: list | None = None
    settled: list | None = None

    def number(self, v: np.ndarray) -> int:
        v = v - v.mean()
        v = v / (np.linalg.norm(v) or 1.0)
        if self.seen:
            near = np.array([x @ v for x in self.seen])
            if near.max() >= SAME_EMBLEM:
                return int(near.argmax())
        self.seen.append(v)
        return len(self.seen) - 1

    def put(self, t: float, n: int) -> Iterator[tuple]:
        """One smoothed number; a segment that ends is settled, or absorbed by the one before if it is short."""
        if self.segment is not None and self.segment[0] == n:
            self.segment[2], self.segment[3] = t, self.segment[3] + 1
            return
        yield from self.settle()
        self.segment = [n, t, t, 1]

    def settle(self) -> Iterator[tuple]:
        if self.segment is None:
            return
        if self.settled is not None and self.segment[3] < MIN_SEGMENT:
            self.settled[2], self.settled[3] = self.segment[2], self.settled[3] + self.segment[3]
        else:
            if self.settled is not None:
                yield self.key, *self.settled
            self.settled = self.segment
        self.segment = None


def emblem_segments(frames: DataFrame, key: str) -> DataFrame:
    """`key`, cluster, start, end and reads of the segments of one emblem: frames has `key`, t and emblem (array<double>).

    An emblem joins the most similar one seen before (zero-mean cosine) from SAME_EMBLEM on, else it is a new one; numbers
    are smoothed by a median of three; segments of under MIN_SEGMENT reads join the one before. Holds the distinct emblems
    of one key.
    """

    def step(line: _Timeline, row: tuple) -> Iterator[tuple]:
        t, emblem = row
        line.recent.append((t, line.number(np.asarray(emblem, float))))
        if len(line.recent) == 2:
            yield from line.put(*line.recent[0])
        elif len(line.recent) == 3:
            yield from line.put(line.recent[1][0], sorted(n for _, n in line.recent)[1])
            line.recent.pop(0)

    def end(line: _Timeline) -> Iterator[tuple]:
        if line.recent:
            yield from line.put(*line.recent[-1])
        yield from line.settle()
        if line.settled is not None:
            yield line.key, *line.settled

    clean = frames.where("t is not null and emblem is not null").select(key, "t", "emblem")
    kind = frames.schema[key].dataType.simpleString()
    return fold_sorted(clean, key, ["t"], ["t", "emblem"], _Timeline, step, end, f"{key} {kind}, cluster long, start double, end double, reads long")


def rounds_of(segments: DataFrame, key: str) -> DataFrame:
    """`key`, part (round or setup), number, start and end from emblem_segments(): the first segment's emblem marks every
    setup; other segments without a setup between them are one round, of MIN_ROUND seconds at least."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("start")
    marked = segments.withColumn("setup", F.col("cluster") == F.first("cluster").over(w))
    marked = marked.withColumn("block", F.sum(F.col("setup").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rounds = marked.where("not setup").groupBy(key, "block").agg(F.min("start").alias("start"), F.max("end").alias("end")).where(F.col("end") - F.col("start") >= MIN_ROUND)
    rounds = rounds.withColumn("part", F.lit("round"))
    setups = marked.where("setup").withColumn("part", F.lit("setup"))
    both = rounds.select(key, "part", "start", "end").unionByName(setups.select(key, "part", "start", "end"))
    return both.withColumn("number", F.row_number().over(Window.partitionBy(key, "part").orderBy("start"))).select(key, "part", "number", "start", "end")
