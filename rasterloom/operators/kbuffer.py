"""The k-buffer: at most four tagged slots for each destination cell, in order of arrival.

A tag that has a slot adds to it; a new tag takes a free slot; with none free it takes
the slot whose first depth is farthest (the first of equals) and starts it anew.

Where no more than four tags are about, which a look at the pixels' tags says, slots
are two aggregations with partial sums.  Else cells are folded in order of arrival, as a stream.
Either way the warp is evaluated once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..consts import SLOTS, Background, WarpParams
from .resolve import over
from .warp import contribution, corners, place

KEYS = ["frame_id", "dx", "dy"]
_SUMS = (("lum", "slum"), ("cb", "scb"), ("cr", "scr"), ("w", "sw"))
_FIELDS = (("tag", pa.int16()), ("z", pa.int32()), ("slum", pa.int64()), ("scb", pa.int64()), ("scr", pa.int64()), ("sw", pa.int64()))
_SLOT = "struct<tag:smallint,z:int,slum:bigint,scb:bigint,scr:bigint,sw:bigint>"


def tag_count(pixels: DataFrame) -> int:
    """How many different tags pixels have, counted up to one over the slots; a scan of one column."""
    return pixels.select("tag").distinct().limit(SLOTS + 1).count() if "tag" in pixels.columns else 1


def slots(frags: DataFrame, params: WarpParams, order: list[str] | None = None, tags: int | None = None) -> DataFrame:
    """(frame_id, dx, dy, slots): occupied slots. order: columns of arrival (default layer if there, py, px, sy, sx); tags: how many there are, if known."""
    order = order or [c for c in ("layer", "py", "px", "sy", "sx") if c in frags.columns]
    c = corners(frags, params).withColumn("seq", F.struct(*order))
    c = place(c.selectExpr("frame_id", "cell", "tag", "z", "seq", *(f"{contribution(a)} as {b}" for a, b in _SUMS)), params)
    if tags is None or tags > SLOTS:
        return fold(c)
    each = c.groupBy(*KEYS, "tag").agg(F.min_by("z", "seq").alias("z"), F.min("seq").alias("seq"), *(F.sum(b).alias(b) for _, b in _SUMS))
    slot = F.struct("seq", F.struct("tag", "z", *(b for _, b in _SUMS)).alias("s"))
    cells = each.groupBy(*KEYS).agg(F.array_sort(F.collect_list(slot)).alias("all"))
    return cells.selectExpr(*KEYS, "transform(all, q -> q.s) as slots")


class _Slots:
    """Cells' slots as columns of a batch."""

    def __init__(self):
        self.cells: list[tuple[int, int, int]] = []
        self.sizes: list[int] = []
        self.slots: list[list[int]] = []

    def add(self, cell: tuple[int, int, int], slots: list[list[int]]) -> None:
        self.cells.append(cell)
        self.sizes.append(len(slots))
        self.slots += slots

    def batch(self) -> pa.RecordBatch:
        parts = np.array(self.slots, np.int64).reshape(-1, len(_FIELDS))
        struct = pa.StructArray.from_arrays([pa.array(parts[:, k], kind) for k, (_, kind) in enumerate(_FIELDS)], [n for n, _ in _FIELDS])
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(self.sizes)).astype(np.int32)), struct)
        cell = np.array(self.cells, np.int64).reshape(-1, 3)
        return pa.RecordBatch.from_arrays([pa.array(cell[:, 0]), pa.array(cell[:, 1], pa.int32()), pa.array(cell[:, 2], pa.int32()), lists], [*KEYS, "slots"])


def _taken(slots: list[list[int]], new: list[int]) -> None:
    """Adds a contribution to a cell's slots."""
    for s in slots:
        if s[0] == new[0]:
            for k in range(2, len(new)):
                s[k] += new[k]
            return
    if len(slots) < SLOTS:
        slots.append(new)
        return
    depths = [s[1] for s in slots]
    slots[depths.index(max(depths))] = new


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folds rows sorted by cell and arrival; holds one cell's slots between batches."""
    cell, slots = None, []
    for b in batches:
        if not b.num_rows:
            continue
        out = _Slots()
        columns = [np.asarray(b.column(c)).astype(np.int64) for c in (*KEYS, *(n for n, _ in _FIELDS))]
        new = np.ones(b.num_rows, bool)  # a cell's neighbours of one tag are one contribution: the first's depth, the sums of all
        new[1:] = np.any([c[1:] != c[:-1] for c in columns[:4]], axis=0)
        head = np.flatnonzero(new)
        runs = [c[head] for c in columns[:5]] + [np.add.reduceat(c, head) for c in columns[5:]]
        for frame, dx, dy, *run in zip(*(r.tolist() for r in runs)):
            if (frame, dx, dy) != cell:
                if cell is not None:
                    out.add(cell, slots)
                cell, slots = (frame, dx, dy), []
            _taken(slots, run)
        if out.cells:
            yield out.batch()
    if cell is not None:
        out = _Slots()
        out.add(cell, slots)
        yield out.batch()


def fold(contributions: DataFrame) -> DataFrame:
    """Slots of cells by folding their contributions in order of arrival (``seq``).

    One exchange by cell; a partition's rows are sorted, where Spark spills, and stream through four slots of state, so a cell
    may have any number of contributions."""
    parts = contributions.select(*KEYS, *(n for n, _ in _FIELDS), "seq").repartition(*KEYS).sortWithinPartitions(*KEYS, "seq").drop("seq")
    return parts.mapInArrow(_fold, f"frame_id long, dx int, dy int, slots array<{_SLOT}>")


def resolve(cells: DataFrame, mode: str, background: Background = Background()) -> DataFrame:
    """(frame_id, dx, dy, lum, cb, cr): opaque: the nearest slot by (z, tag) over the background; blend: all slots, far to near."""
    parts = {c: getattr(background, c) for c in ("lum", "cb", "cr")}
    by_depth = "array_sort(transform(slots, s -> struct(s.z as z, s.tag as tag, s as s)))"
    if mode == "opaque":
        df = cells.selectExpr(*KEYS, f"{by_depth}[0].s as s")
        return df.selectExpr(*KEYS, *(f"cast({over(f's.s{c}', 's.sw', str(b))} as int) as {c}" for c, b in parts.items()))
    if mode != "blend":
        raise ValueError(f"no mode {mode}")
    start = "named_struct(" + ", ".join(f"'{c}', {b}L" for c, b in parts.items()) + ")"
    step = "named_struct(" + ", ".join(f"'{c}', {over(f'q.s.s{c}', 'q.s.sw', f'acc.{c}')}" for c in parts) + ")"
    df = cells.selectExpr(*KEYS, f"aggregate(reverse({by_depth}), {start}, (acc, q) -> {step}) as c")
    return df.selectExpr(*KEYS, *(f"cast(c.{c} as int) as {c}" for c in parts))


def composite_kbuffer(frags: DataFrame, frames: DataFrame, params: WarpParams, tags: int | None = None) -> DataFrame:
    """Every destination cell of every frame, resolved in ``params.kbuffer`` mode."""
    got = resolve(slots(frags, params, tags=tags), params.kbuffer, params.background)
    grid = place(frames.selectExpr("frame_id", f"explode(sequence(0, {params.width * params.height - 1})) as cell"), params)
    b = params.background
    out = grid.join(got, KEYS, "left")
    return out.selectExpr(*KEYS, f"coalesce(lum, {b.lum}) as lum", f"coalesce(cb, {b.cb}) as cb", f"coalesce(cr, {b.cr}) as cr")
