"""The live loop as tables and streams: capture, admission, consumption, playback.

Batch forms run over numbered frames by segments (see ``scan``), so one source's rows are worked on by
all tasks; streaming forms keep a few values for each source in state, so neither collects a stream anywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scan

# ---- capture -----------------------------------------------------------------


def captured(frames: DataFrame, source: str = "source_id") -> DataFrame:
    """Frames that capture pushes: with a signal, and the frame before had one too."""
    rows = scan.segmented(frames.filter("has_signal is not null"), source, "frame_no")
    rows = scan.previous(rows, "has_signal", "__b", "frame_no")
    return rows.filter("has_signal and coalesce(__b.has_signal, false)").select(*frames.columns)


def captured_stream(frames: DataFrame, source: str = "source_id") -> DataFrame:
    """Streaming ``captured``: a boolean and a number of state for each source. Columns: source, frame_no.

    A source's frames may come in any order within a micro-batch, whose frames of one source are sorted in
    memory; from one micro-batch to the next their numbers must rise, else the query fails."""

    def step(key, batches: Iterator[pd.DataFrame], state):
        before, last = state.get if state.exists else (False, -(1 << 63))
        rows = pd.concat(list(batches)).sort_values("frame_no")
        if int(rows["frame_no"].iloc[0]) <= last:
            raise ValueError(f"source {key[0]}: frame {rows['frame_no'].iloc[0]} came after frame {last}")
        now = rows["has_signal"].astype(bool)
        keep = now & now.shift(fill_value=before)
        state.update((bool(now.iloc[-1]), int(rows["frame_no"].iloc[-1])))
        yield pd.DataFrame({source: key[0], "frame_no": rows["frame_no"][keep]})

    rows = frames.filter("has_signal is not null").select(source, "frame_no", "has_signal")
    return rows.groupBy(source).applyInPandasWithState(step, f"{source} long, frame_no long", "before boolean, last long", "append", "NoTimeout")


# ---- the ring: bounded, drops the newest ---------------------------------------


def _joined(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """a with b's other columns, by equal keys; null keys are equal."""
    b = b.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return a.join(b, on).drop(*(f"__{k}" for k in keys))


def admitted(events: DataFrame, capacity: int, source: str = "source_id", block: int = 256) -> DataFrame:
    """events (source, seq, kind push or pop) with ``depth`` after the event and ``ok``: whether a push was admitted or a pop got an item.

    An event moves the depth x to min(max(x + a, lo), hi), and such moves one after another are one such move.
    So events are folded by blocks of ``block`` by rank, whatever their numbers are, blocks by groups of as many, and
    groups by source; then each block starts from its own depth.  A task holds a block's events, a group's blocks,
    or a source's groups, one for block * block events."""
    start = f"named_struct('a', 0L, 'lo', 0L, 'hi', {capacity}L)"

    def clamp(x: str) -> str:
        return f"least(greatest({x}, 0L), {capacity}L)"

    by = "(case when e.kind = 'push' then 1L else -1L end)"
    one = f"(acc, e) -> named_struct('a', acc.a + {by}, 'lo', {clamp(f'acc.lo + {by}')}, 'hi', {clamp(f'acc.hi + {by}')})"
    many = "(acc, e) -> named_struct('a', acc.a + e.a, 'lo', least(greatest(acc.lo + e.a, e.lo), e.hi), 'hi', least(greatest(acc.hi + e.a, e.lo), e.hi))"

    def starts(moves: str, depth: str, number: str) -> str:
        """Rows (number, d): the depth before each of moves, from ``depth``."""
        step = f"(acc, e) -> named_struct('d', least(greatest(acc.d + e.a, e.lo), e.hi), 'out', concat(acc.out, array(named_struct('{number}', e.{number}, 'd', acc.d))))"
        return f"inline(aggregate({moves}, named_struct('d', {depth}, 'out', cast(array() as array<struct<{number}:bigint,d:bigint>>)), {step}).out)"

    def gathered(df: DataFrame, *keys: str, number: str) -> DataFrame:
        moves = F.array_sort(F.collect_list(F.struct(number, "f.a", "f.lo", "f.hi")))
        return df.groupBy(*keys).agg(moves.alias("moves"))

    numbered = scan.segmented(events.selectExpr(source, "cast(seq as bigint) as seq", "kind"), source, "seq")
    rows = scan.ranked(numbered, "__r", "seq").selectExpr(source, "seq", "kind", f"__r div {block} as b1")
    blocks = rows.groupBy(source, "b1").agg(F.array_sort(F.collect_list(F.struct("seq", "kind"))).alias("es"))
    blocks = blocks.selectExpr(source, "b1", f"b1 div {block} as b2", "es", f"aggregate(es, {start}, {one}) as f")
    groups = gathered(blocks, source, "b2", number="b1").selectExpr(source, "b2", "moves", f"aggregate(moves, {start}, {many}) as f")
    first = gathered(groups, source, number="b2").selectExpr(source, starts("moves", "0L", "b2"))
    second = _joined(groups.select(source, "b2", "moves"), first, source, "b2").selectExpr(source, starts("moves", "d", "b1"))
    move = clamp(f"acc.d + {by}")
    ok = f"case when e.kind = 'push' then acc.d < {capacity} else acc.d > 0 end"
    step = f"(acc, e) -> named_struct('d', {move}, 'out', concat(acc.out, array(named_struct('seq', e.seq, 'kind', e.kind, 'ok', {ok}, 'depth', cast({move} as int)))))"
    empty = "cast(array() as array<struct<seq:bigint,kind:string,ok:boolean,depth:int>>)"
    out = _joined(blocks.select(source, "b1", "es"), second, source, "b1")
    return out.selectExpr(source, f"inline(aggregate(es, named_struct('d', d, 'out', {empty}), {step}).out)")


def ring_counters(admitted_events: DataFrame, source: str = "source_id") -> DataFrame:
    """For each source: pushes, those dropped as the ring was full, pops, and those that found it empty."""
    push, ok = F.col("kind") == "push", F.col("ok")
    counts = {"pushed": push, "dropped": push & ~ok, "popped": ~push, "empty": ~push & ~ok}
    return admitted_events.groupBy(source).agg(*(F.count_if(c).alias(n) for n, c in counts.items()))


# ---- consumption -----------------------------------------------------------------


def consumer_stats(frames: DataFrame, width: int, height: int, mode: str = "v210") -> DataFrame:
    """One row: frames popped, processed (right format and geometry) and failed."""
    good = (F.col("mode") == mode) & (F.col("width") == width) & (F.col("height") == height)
    ok = F.coalesce(good, F.lit(False))
    return frames.agg(F.count(F.lit(1)).alias("popped"), F.count_if(ok).alias("processed"), F.count_if(~ok).alias("failed"))


def as_of(frames: DataFrame, settings: DataFrame, source: str = "source_id") -> DataFrame:
    """frames (source, at) with the latest setting (source, at, value) at or before each: a union and a running last value by segments, no range join.

    A setting takes effect on the next frame, never within one."""
    a = frames.select(source, "at", F.lit(1).alias("__k"), F.col("frame_no"), F.lit(None).cast(settings.schema["value"].dataType).alias("value"))
    b = settings.select(source, "at", F.lit(0).alias("__k"), F.lit(None).cast("long").alias("frame_no"), "value")
    order = ("at", "__k", "frame_no")
    both = scan.last_known(scan.segmented(a.unionByName(b), source, *order), "value", *order)
    return both.filter("__k = 1").select(source, "at", "frame_no", "value")


def consume(frames: DataFrame, process: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], coverage: Callable[[DataFrame, int], None] | None = None):
    """A query that processes each micro-batch of frames and hands the result to ``sink`` and, once, to ``coverage``.

    Parameters that ``process`` reads are read once for each micro-batch."""

    def run(batch: DataFrame, n: int) -> None:
        out = process(batch)
        if coverage is None:
            sink(out, n)
            return
        out = out.persist()
        try:
            sink(out, n)
            coverage(out, n)
        finally:
            out.unpersist()

    return frames.writeStream.foreachBatch(run)


def keyed(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes a micro-batch's rows to a folder of its own, which it replaces: a batch that runs again after a failure leaves its rows once."""
    return lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}")


# ---- playback --------------------------------------------------------------------


def latest(frames: DataFrame, source: str = "source_id", order: str = "frame_no") -> DataFrame:
    """The newest frame of each source; over a stream this is one state value for each source."""
    fields = F.struct(*[c for c in frames.columns if c != source])
    return frames.groupBy(source).agg(F.max_by(fields, order).alias("frame"))


def playback(frames: DataFrame, ticks: DataFrame, source: str = "source_id") -> DataFrame:
    """ticks (source, tick, at) with the latest frame (source, frame_no, at) at or before each, and whether it repeats the one before.

    Ticks before any frame show the black frame (frame_no null)."""
    a = ticks.select(source, "at", F.lit(1).alias("__k"), "tick", F.lit(None).cast("long").alias("frame_no"))
    b = frames.select(source, "at", F.lit(0).alias("__k"), F.lit(None).cast("long").alias("tick"), F.col("frame_no").cast("long").alias("frame_no"))
    order = ("at", "__k", "frame_no", "tick")
    got = scan.last_known(scan.segmented(a.unionByName(b), source, *order), "frame_no", *order).filter("__k = 1")
    got = scan.previous(got, "frame_no", "__b", "at", "tick")
    return got.withColumn("repeated", F.coalesce(F.col("frame_no") == F.col("__b.frame_no"), F.lit(False))).select(source, "tick", "at", "frame_no", "repeated")


def playback_every(frames: DataFrame, sources: DataFrame, every: int, ticks: int, source: str = "source_id") -> DataFrame:
    """``playback`` at the ticks 0 to ticks - 1, one every ``every`` from 0, of all ``sources`` (rows of source, each once).

    A frame is shown from the first tick that it reaches up to the next frame's.  Only these runs are sorted and exchanged, at most
    one for each frame and source; their ticks arise as they are read, so the ticks take no room."""
    begin = sources.select(source, F.lit(0).cast("long").alias("tick"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("frame_no"))  # black: before any frame
    reached = frames.filter("at is not null").selectExpr(source, f"greatest(at div {every} + if(at % {every} > 0, 1, 0), 0L) as tick", "cast(at as bigint) as at", "cast(frame_no as bigint) as frame_no")
    shown = begin.unionByName(reached.filter(F.col("tick") < ticks)).groupBy(source, "tick").agg(F.expr("max_by(frame_no, struct(at, frame_no))").alias("frame_no"))
    rows = scan.segmented(shown, source, "tick")
    rows = scan.following(scan.previous(rows, "frame_no", "__b", "tick"), "tick", "__n", "tick")
    runs = rows.selectExpr(source, "tick as first", f"coalesce(__n.tick, {ticks}L) - 1 as last", "frame_no", "coalesce(frame_no = __b.frame_no, false) as repeated")
    return played(runs, source).selectExpr(source, "tick", f"tick * {every} as at", "frame_no", "repeated")


def played(runs: DataFrame, source: str = "source_id") -> DataFrame:
    """The ticks (source, tick, frame_no, repeated) of runs (source, first, last, frame_no, repeated: whether the first tick is a repeat)."""
    ticks = runs.selectExpr(source, "first", "frame_no", "repeated", "explode(sequence(first, last)) as tick")
    return ticks.selectExpr(source, "tick", "frame_no", "frame_no is not null and (repeated or tick > first) as repeated")


def preroll(rate: float) -> int:
    """Frames scheduled ahead: half a second, rounded half away from zero."""
    return int(rate / 2 + 0.5)


def results(completions: DataFrame) -> DataFrame:
    """One row: completions by result."""
    return completions.agg(*(F.count_if(F.col("result") == r).alias(r) for r in ("completed", "late", "dropped", "flushed")))


# ---- controls --------------------------------------------------------------------

#: Key, control and step (fixed values).
CONTROLS = {
    "left": ("yaw", -0.05), "right": ("yaw", 0.05), "up": ("pitch", -0.05), "down": ("pitch", 0.05),
    "x": ("cx", -10.0), "X": ("cx", 10.0), "y": ("cy", -10.0), "Y": ("cy", 10.0), "z": ("radius", -10.0), "Z": ("radius", 10.0),
}
QUIT = ("q", "Q")
LEAST_RADIUS = 20.0


def controls(keys: DataFrame, radius: float = 200.0) -> DataFrame:
    """(seq, yaw, pitch, cx, cy, radius) after each key of (source_id, seq, key), up to the first that ends the loop.

    Running sums; the radius, which never falls under its least, is the sum lifted by what the floor has cut off."""
    def step(name: str):
        out = F.lit(0.0)
        for k, (n, s) in CONTROLS.items():
            if n == name:
                out = F.when(F.col("key") == k, F.lit(s)).otherwise(out)
        return out

    names = ("yaw", "pitch", "cx", "cy", "radius")
    here, earlier = scan.up_to_here("seq"), scan.within("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = scan.segmented(keys, "source_id", "seq").withColumns({f"__{n}": step(n) for n in names} | {"__q": F.coalesce(F.col("key").isin(*QUIT), F.lit(False))})
    rows = rows.withColumns({n: F.sum(f"__{n}").over(here) for n in names} | {"__over": F.coalesce(F.max("__q").over(earlier), F.lit(False))})
    rows = rows.withColumn("__low", F.min("radius").over(here))
    each = scan.segments(rows, **{f"__c_{n}": F.sum(f"__{n}") for n in names}, __c_q=F.max("__q"), __c_low=F.min("radius"))
    zero = F.lit(0.0)
    each = each.withColumns({f"__b_{n}": F.coalesce(F.sum(f"__c_{n}").over(scan.before()), zero) for n in names} | {"__b_q": F.coalesce(F.max("__c_q").over(scan.before()), F.lit(False))})
    each = each.withColumn("__b_low", F.min(F.col("__b_radius") + F.col("__c_low")).over(scan.before()))
    each = each.select(scan.KEY, scan.SEGMENT, *(f"__b_{n}" for n in names), "__b_q", "__b_low")
    rows = scan.carried(rows, each).filter(~F.col("__over") & ~F.col("__b_q"))
    rows = rows.withColumns({n: F.col(n) + F.col(f"__b_{n}") for n in names} | {"__low": F.least("__b_low", F.col("__low") + F.col("__b_radius"))})
    cut = F.greatest(F.lit(LEAST_RADIUS - radius) - F.col("__low"), zero)  # a floor lifts everything after it by what it cut off
    return rows.withColumn("radius", F.lit(radius) + F.col("radius") + cut).select(*keys.columns, *names)
