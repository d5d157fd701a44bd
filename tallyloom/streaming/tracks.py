"""STM-05: the stints of a stream, by the state machine of the batch, with event-time timers that sort, settle and close.

Needs the RocksDB state store: spark.sql.streaming.stateStore.providerClass.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyloom.operators.sequence import typed
from tallyloom.operators.stints import OUT, TAGGED, Slot, _kinds, tagged

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_NAMES = [c.split()[0] for c in TAGGED.split(", ")]


def _ms(seconds: float) -> int:
    return int(seconds * 1000)


def _order(row: list) -> tuple:
    """stints' order of the rows of a slot, nulls first."""
    _, _, _, value, score, _, _, until = row
    return row[0], row[1], value or "", score is not None, score or 0, until is not None, until or 0


class Tracks(StatefulProcessor):
    """Of each slot: `waiting` holds the rows that the watermark hasn't passed, `slot` the state machine, `closes` the time of
    the timer that ends the track. Rows are taken in the order of their times when the watermark has passed them, however
    they came; `silence` seconds after its last read a track is closed, its last rows come out and its state goes."""

    def __init__(self, keys: list[str], silence: float):
        self.keys, self.silence = keys, silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "row string")
        self.slot = handle.getValueState("slot", "slot string")
        self.closes = handle.getValueState("closes", "ms long")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        state = initialState["state"].iloc[0]
        self.slot.update((state,))
        end = self._end(Slot.load(state))
        if end is not None:
            self._close_at(end)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        plain = lambda x: None if x is None or x != x else float(x)
        due = set()
        for pdf in rows:
            for at, tag, t, value, score, margin, scores, until in pdf[_NAMES].itertuples(index=False, name=None):
                row = [at, int(tag), t, value, plain(score), plain(margin), dict(scores or {}), plain(until)]
                self.waiting.appendValue((json.dumps(row),))
                due.add(_ms(at))
        for ms in due:
            self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = [json.loads(r[0]) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted((r for r in waiting if _ms(r[0]) <= passed), key=_order)
        slot = Slot.load(self.slot.get()[0]) if self.slot.exists() else Slot()
        out = []
        if ready:
            rest = [(json.dumps(r),) for r in waiting if _ms(r[0]) > passed]
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
            for row in ready:
                end = self._end(slot)
                if end is not None and _ms(row[0]) > end:  # the track was closed before this row
                    out += slot.close()
                    slot = Slot()
                out += slot.take(tuple(row))
            end = self._end(slot)
            self._close_at(_ms(ready[-1][0] + self.silence) if end is None else end)
        if self.closes.exists() and self.closes.get()[0] <= passed:
            out += slot.close()
            self.closes.clear()
            self.slot.clear()
        elif ready:
            self.slot.update((slot.dump(),))
        if out:
            yield typed([(*key, *x) for x in out], [*self.keys, *(c.split()[0] for c in OUT.split(", "))], OUT)

    def _end(self, slot: Slot) -> int | None:
        """When a track is closed if nothing more is read: None if nothing was."""
        last = max((run.last for run in (slot.held, slot.rival) if run), default=None)
        return None if last is None else _ms(last + self.silence)

    def _close_at(self, ms: int) -> None:
        if self.closes.exists():
            if self.closes.get()[0] == ms:
                return
            self.handle.deleteTimer(self.closes.get()[0])
        self.closes.update((ms,))
        self.handle.registerTimer(ms)

    def close(self) -> None:
        pass


def stints_of_stream(reads: DataFrame, key: str | list[str], silence: float, late: str, setups: DataFrame | None = None, rounds: DataFrame | None = None, initial: DataFrame | None = None) -> DataFrame:
    """stints() on a stream, with setups and rounds streams of `keys`, start and end.

    Rows may come in any order up to `late` behind the newest of all; later ones are dropped, as the watermark has it. A
    track closes `silence` seconds after its last read: then its unresolved run and last stint come out, so that the rows
    of all closed tracks are those of the batch, if no track of the batch is silent for so long; after a longer silence a
    slot begins anew, with the phases that begin after the silence. initial (keys, state) is what open_slots() left; the
    stream goes on with it.
    """
    keys = [key] if isinstance(key, str) else list(key)
    timed = tagged(reads, keys, setups, rounds).withColumn("_time", F.timestamp_micros((F.col("at") * 1_000_000).cast("long"))).withWatermark("_time", late)
    held = initial.groupBy(*keys) if initial is not None else None
    return timed.groupBy(*keys).transformWithStateInPandas(Tracks(keys, silence), f"{_kinds(reads, keys)}, {OUT}", "append", "eventtime", held)

