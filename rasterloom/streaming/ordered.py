"""Streams whose frames come late and out of order: sorted state, released by the watermark.

Frames wait in their source's state, in order of their numbers, until the watermark has passed their
time: then none before them can come any more, as Spark drops what is older.  So a frame that is late by
less than ``delay`` is placed where it belongs, whatever micro-batch brings it; one beyond that is
dropped and counted (``dropped_late``).  Timers wake sources that get no frames.  A source's state
holds what it gets within the delay.  Frames of the epoch's first instant are late for Spark, whose watermark begins there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import live

_WAITING = "ts array<long>, no array<long>, signal array<boolean>, before boolean"


class _Waiting:
    """A source's frames that wait, sorted by number, and whether the last one released had a signal."""

    def __init__(self, state=None):
        ts, no, signal, self.before = state[:4] if state is not None else ([], [], [], False)
        self.ts, self.no = np.array(ts, np.int64), np.array(no, np.int64)
        self.signal = np.array(signal, bool)

    def add(self, rows: pd.DataFrame) -> None:
        self.ts = np.append(self.ts, rows["ms"].to_numpy(np.int64))
        self.no = np.append(self.no, rows["frame_no"].to_numpy(np.int64))
        self.signal = np.append(self.signal, rows["has_signal"].to_numpy(bool))
        order = np.lexsort((self.no, self.ts))
        self.ts, self.no, self.signal = self.ts[order], self.no[order], self.signal[order]

    def release(self, watermark: int) -> tuple[np.ndarray, np.ndarray]:
        """(times, numbers) of the frames that capture pushes, of those up to the watermark."""
        n = int(np.searchsorted(self.ts, watermark, "right"))
        now = self.signal[:n]
        keep = now & np.append(self.before, now)[:n]
        got = self.ts[:n][keep], self.no[:n][keep]
        if n:
            self.before = bool(now[-1])
        self.ts, self.no, self.signal = self.ts[n:], self.no[n:], self.signal[n:]
        return got

    def state(self) -> tuple:
        return self.ts.tolist(), self.no.tolist(), self.signal.tolist(), bool(self.before)


def _wake(state, at: int, watermark: int) -> None:
    """Sets the timer that fires once the watermark reaches ``at``, which lies beyond it."""
    state.setTimeoutTimestamp(at - 1 if at - 1 > watermark else at)


def _timed(frames: DataFrame, source: str, delay: str) -> DataFrame:
    rows = frames.filter("has_signal is not null").select(source, "frame_no", "has_signal", "ts").withWatermark("ts", delay)
    return rows.withColumn("ms", F.unix_millis("ts"))


def captured_late(frames: DataFrame, delay: str, source: str = "source_id") -> DataFrame:
    """Streaming ``captured`` of (source, frame_no, has_signal, ts) in any order within ``delay``: (source, frame_no)."""

    def step(key, batches: Iterator[pd.DataFrame], state):
        waiting = _Waiting(state.get if state.exists else None)
        if not state.hasTimedOut:
            for rows in batches:
                waiting.add(rows)
        watermark = state.getCurrentWatermarkMs()
        _, numbers = waiting.release(watermark)
        state.update(waiting.state())
        if len(waiting.ts):
            _wake(state, int(waiting.ts[0]), watermark)
        if len(numbers):
            yield pd.DataFrame({source: pd.array([key[0]] * len(numbers), "Int64"), "frame_no": numbers})

    return _timed(frames, source, delay).groupBy(source).applyInPandasWithState(step, f"{source} long, frame_no long", _WAITING, "append", "EventTimeTimeout")


def playback_stream(frames: DataFrame, every: int, delay: str, last: int | None = None, preroll: int = 0, start: int = 0, source: str = "source_id") -> DataFrame:
    """Streaming ``playback`` of (source, frame_no, has_signal, ts): (source, tick, frame_no, repeated).

    ``playback_runs``, tick by tick."""
    return live.played(playback_runs(frames, every, delay, last, preroll, start, source), source)


def playback_runs(frames: DataFrame, every: int, delay: str, last: int | None = None, preroll: int = 0, start: int = 0, source: str = "source_id") -> DataFrame:
    """Streaming playback of (source, frame_no, has_signal, ts) as runs (source, first, last, frame_no, repeated) of ticks that show the same frame;
    repeated: whether the first of them is a repeat, as the others are.  So what a source sends follows its frames, not its ticks.

    A tick every ``every`` milliseconds from ``start`` (of the epoch; frames come after it) shows the latest frame captured up to it; where none came since the tick
    before, that one is repeated: timers see to it, so sources without frames go on.  A source begins at tick 0, whenever its
    first frame is seen, after ``preroll`` ticks of black (numbered below 0).  last: the last tick."""

    def step(key, batches: Iterator[pd.DataFrame], state):
        old = state.get if state.exists else None
        waiting = _Waiting(old)
        latest, shown, tick = old[4:7] if old is not None else (None, None, -preroll)
        if not state.hasTimedOut:
            for rows in batches:
                waiting.add(rows)
        watermark = state.getCurrentWatermarkMs()
        times, numbers = waiting.release(watermark)
        end = (watermark - start) // every if last is None else min((watermark - start) // every, last)
        first = np.maximum(-((start - times) // every), tick)  # the tick that a frame reaches
        some = np.flatnonzero((first <= end) & (np.append(first[1:], end + 1) != first))  # the latest of each
        first, frame = first[some].tolist(), numbers[some].tolist()
        if tick <= end and (not first or first[0] > tick):
            first, frame = [tick, *first], [latest, *frame]
        before = [shown, *frame[:-1]]
        latest = int(numbers[-1]) if len(numbers) else latest
        if frame:
            shown, tick = frame[-1], int(end) + 1
        state.update((*waiting.state(), latest, shown, tick))
        if last is None or tick <= last:
            _wake(state, max(start + tick * every, watermark + 1), watermark)
        if frame:
            yield pd.DataFrame({source: pd.array([key[0]] * len(frame), "Int64"), "first": first, "last": [*(x - 1 for x in first[1:]), tick - 1], "frame_no": pd.array(frame, "Int64"), "repeated": [x is not None and x == y for x, y in zip(frame, before)]})

    kinds = f"{source} long, first long, last long, frame_no long, repeated boolean"
    return _timed(frames, source, delay).groupBy(source).applyInPandasWithState(step, kinds, f"{_WAITING}, latest long, shown long, tick long", "append", "EventTimeTimeout")


def dropped_late(query) -> int:
    """Frames that came later than the delay, of a query's known progress."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
