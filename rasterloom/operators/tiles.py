"""The warp on vectors, tile by tile.

pixels --(source tiles with a border of one pixel)--> sub-samples, landing, corners
--blocks of sums--> exchange by (frame, destination tile) --vector addition--> cells

Positions, weights and colours go through the same operations in the same order as the
SQL expressions of ``warp``, on vectors, so they are the same to the bit.  What is exchanged is
one row for each destination tile that some source pixels reach: the places of its cells and
their sums as packed integers.  Such rows are sorted by tile and added up as they stream by; a task
holds some tiles' cells, whatever the number of frames.

Sub-samples lie between pixels, so with any magnification to expect, pixels go to their source
tile and, at its edges, to the neighbours as well: one exchange, after which a tile's colours are looked up
in a dense array.  Without (``Supersample(most=1)``), pixels are warped where they are.

A frame may have a lattice of its own (``lattices``): tiles and lattices meet by frame and tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..consts import LATTICE_MAX, SAMPLE_MAX, SUBPIXEL, WEIGHT_UNITY, Supersample, WarpParams
from . import lattice as L

SUMS = ("slum", "scb", "scr", "sw")
SOURCE_TILE = 128
ROWS = 1 << 17  # pixels of a block where they are warped in place
GROUPS = 256  # destination tiles that are added up at once
_BLOCK = "frame_id long, tile int, full boolean, cells binary, " + ", ".join(f"{s} binary" for s in SUMS)
_SCHEMA = pa.schema([("frame_id", pa.int64()), ("tile", pa.int32()), ("full", pa.bool_()), ("cells", pa.binary()), *((s, pa.binary()) for s in SUMS)])


def _axis(p: np.ndarray, size: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(cell, weights of the four neighbours, their derivatives) along one axis, as ``spline`` has them."""
    u = p * float(LATTICE_MAX) / float(size - 1) if size > 1 else np.zeros(len(p))
    u = np.clip(u, 0.0, float(LATTICE_MAX))
    cell = np.minimum(np.floor(u).astype(np.int64), LATTICE_MAX - 1)
    t = u - cell
    t2 = t * t
    t3 = t2 * t
    value = [-0.5 * t3 + t2 - 0.5 * t, 1.5 * t3 - 2.5 * t2 + 1.0, -1.5 * t3 + 2.0 * t2 + 0.5 * t, 0.5 * t3 - 0.5 * t2]
    slope = [-1.5 * t2 + 2.0 * t - 0.5, 4.5 * t2 - 5.0 * t, -4.5 * t2 + 4.0 * t + 0.5, 1.5 * t2 - t]
    return cell, value, slope


def half_up(x: np.ndarray) -> np.ndarray:
    """x clamped to 0..65535 and rounded half up."""
    x = np.clip(x, 0.0, float(SAMPLE_MAX))
    low = np.floor(x)
    return low.astype(np.int64) + (x - low >= 0.5)


def _surface(points: np.ndarray, px: np.ndarray, py: np.ndarray, width: int, height: int):
    """(x, y, determinant for one pixel) at source positions; points: x and y of the lattice, as ``padded``: with one before and two after."""
    ci, wu, du = _axis(px, width)
    cj, wv, dv = _axis(py, height)
    sums = [[0.0] * 3 for _ in points]
    for a in range(4):
        for b in range(4):
            weights = wv[a] * wu[b], wv[a] * du[b], dv[a] * wu[b]
            for c, plane in enumerate(points):
                p = plane[cj + a, ci + b]
                for k, w in enumerate(weights):
                    sums[c][k] = sums[c][k] + w * p
    su = float(LATTICE_MAX) / (width - 1) if width > 1 else 0.0
    sv = float(LATTICE_MAX) / (height - 1) if height > 1 else 0.0
    (x, xu, xv), (y, yu, yv) = sums
    return x, y, (xu * su) * (yv * sv) - (xv * sv) * (yu * su)


def padded(points: np.ndarray) -> np.ndarray:
    before, after = (1, 2) if points.shape[1] == LATTICE_MAX + 1 else (0, 1)  # with a margin, what is around is there
    return np.pad(points, ((0, 0), (before, after), (before, after)), mode="edge")


def factors(det: np.ndarray, s: Supersample) -> np.ndarray:
    """Samples along either axis of each pixel."""
    size = np.abs(det)
    return np.minimum(np.where(size > s.threshold_4x4, 4, np.where(size > s.threshold_2x2, 2, 1)), max(1, s.most))


def _contributions(x, y, det, share, colours, params: WarpParams):
    """(index of the sample, tile, place in the tile, the four contributions) of all corners that count."""
    t = params.tile
    across = -(-params.width // t)
    on = np.flatnonzero((x >= 0) & (x < params.width) & (y >= 0) & (y < params.height))
    x, y = x[on], y[on]
    with np.errstate(divide="ignore"):
        w = half_up(np.minimum(1.0 / np.abs(det[on]), params.max_k) * np.broadcast_to(share, det.shape)[on] * float(WEIGHT_UNITY))
    spots = {}
    for name, p, size in (("x", x, params.width), ("y", y, params.height)):
        base = np.floor(p).astype(np.int64)
        tile, inside, part = base // t, base % t, p - base
        for copy in (0, 1):
            q = half_up((inside + part - copy * t + 1.0) * float(SUBPIXEL)) - SUBPIXEL
            there = (inside == t - 1) & (tile + 1 < -(-size // t)) if copy else None
            for corner in (0, 1):
                at, far = (q >> 4) + corner, q & 15
                near = far if corner else SUBPIXEL - far
                ok = (near > 0) & (at >= 0) & (at < t) & ((tile + copy) * t + at < size)
                spots[name, copy, corner] = (ok if there is None else ok & there), tile + copy, at, near
    found = []
    for cy, j, cx, i in np.ndindex(2, 2, 2, 2):
        (okx, tx, ax, nx), (oky, ty, ay, ny) = spots["x", cx, i], spots["y", cy, j]
        k = np.flatnonzero(okx & oky)
        if len(k):
            found.append((k, ty[k] * across + tx[k], ay[k] * t + ax[k], nx[k] * ny[k]))
    if not found:
        return on[:0], on[:0], on[:0], [on[:0]] * 4
    k, tile, place, raw = (np.concatenate(c) for c in zip(*found))
    weighed = w[k] * raw
    return on[k], tile, place, [(c[on[k]] * weighed) >> 8 for c in colours] + [weighed >> 8]


def _packed(values: np.ndarray, heads: np.ndarray) -> pa.Array:
    """A binary value for each of the parts of values that begin at heads."""
    at = (np.append(heads, len(values)) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])


def _block(frames: np.ndarray, of: np.ndarray, tile: np.ndarray, place: np.ndarray, parts: list[np.ndarray], params: WarpParams) -> pa.RecordBatch:
    """Sums of contributions by frame (frames[of]), tile and place: a row for each tile."""
    t = params.tile
    tiles = -(-params.width // t) * -(-params.height // t)
    key = (of * tiles + tile) * (t * t) + place
    order = np.argsort(key)
    key = key[order]
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sums = [np.add.reduceat(p[order], head) for p in parts]
    key = key[head]
    own = key // (t * t)
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    own = own[first]
    columns = [pa.array(frames[own // tiles]), pa.array((own % tiles).astype(np.int32)), pa.array(np.zeros(len(own), bool)), _packed((key % (t * t)).astype(np.uint16), first), *(_packed(s, first) for s in sums)]
    return pa.RecordBatch.from_arrays(columns, ["frame_id", "tile", "full", "cells", *SUMS])


def _columns(data, *names: str) -> list[np.ndarray]:
    return [np.asarray(data.column(c)).astype(np.int64) for c in names]


# ---- pixels where they are ------------------------------------------------------


def _in_place(points: np.ndarray, width: int, height: int, params: WarpParams):
    def block(held: list[pa.RecordBatch]):
        data = pa.Table.from_batches(held)
        frame, px, py, *colours = _columns(data, "frame_id", "px", "py", "lum", "cb", "cr")
        frames, of = np.unique(frame, return_inverse=True)
        at, tile, place, parts = _contributions(*_surface(points, px.astype(np.float64), py.astype(np.float64), width, height), 1.0, colours, params)
        return _block(frames, of[at], tile, place, parts, params) if len(at) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= ROWS:
                got = block(held)
                if got is not None:
                    yield got
                held, n = [], 0
        if n:
            got = block(held)
            if got is not None:
                yield got

    return run


# ---- source tiles ---------------------------------------------------------------


def source_tiles(pixels: DataFrame, width: int, height: int, size: int = SOURCE_TILE) -> DataFrame:
    """pixels with ``src``, their source tile, and copies of those at an edge for the tiles beside it."""
    across, down = -(-width // size), -(-height // size)

    def spots(p: str, n: int) -> str:
        return f"filter(array({p} div {size}, if({p} % {size} = 0, {p} div {size} - 1, -1), if({p} % {size} = {size - 1}, {p} div {size} + 1, {n})), q -> q >= 0 and q < {n})"

    df = pixels.selectExpr("frame_id", "px", "py", "lum", "cb", "cr", f"explode({spots('px', across)}) as __tx")
    return df.selectExpr("frame_id", "px", "py", "lum", "cb", "cr", "__tx", f"explode({spots('py', down)}) as __ty").selectExpr("frame_id", f"cast(__ty * {across} + __tx as int) as src", "px", "py", "lum", "cb", "cr")


def _sampled(points, px, py, near, width: int, height: int, s: Supersample):
    """(x, y, determinant, share of a pixel, colours) of all sub-samples; near: the tile's colours and its border's, and where they begin."""
    planes, x0, y0 = near
    fx, fy = px.astype(np.float64), py.astype(np.float64)
    x, y, det = _surface(points, fx, fy, width, height)
    n = factors(det, s)
    one = np.flatnonzero(n == 1)
    out = [(x[one], y[one], det[one], np.ones(len(one)), [c[py[one] - y0, px[one] - x0] for c in planes])]
    for k in np.unique(n[n > 1]):
        at = np.flatnonzero(n == k)
        sub = np.tile(np.arange(k * k), len(at))
        at = np.repeat(at, k * k)
        sx = fx[at] - 0.5 + ((sub % k).astype(np.float64) + 0.5) / float(k)
        sy = fy[at] - 0.5 + ((sub // k).astype(np.float64) + 0.5) / float(k)
        cx, cy = np.clip(sx, 0.0, float(width - 1)), np.clip(sy, 0.0, float(height - 1))
        left, top = np.floor(cx).astype(np.int64), np.floor(cy).astype(np.int64)
        right, low = np.minimum(left + 1, width - 1) - x0, np.minimum(top + 1, height - 1) - y0
        ax, ay = cx - np.floor(cx), cy - np.floor(cy)
        left, top = left - x0, top - y0
        colours = []
        for c in planes:
            upper = c[top, left] * (1.0 - ax) + c[top, right] * ax
            lower = c[low, left] * (1.0 - ax) + c[low, right] * ax
            colours.append(half_up(upper * (1.0 - ay) + lower * ay))
        out.append((*_surface(points, sx, sy, width, height), np.full(len(at), 1.0 / float(k * k)), colours))
    x, y, det, share = (np.concatenate([o[i] for o in out]) for i in range(4))
    return x, y, det, share, [np.concatenate([o[4][c] for o in out]) for c in range(3)]


def _tile_warp(width: int, height: int, params: WarpParams, rows, size: int):
    """Blocks of one source tile (frame_id, src, px, py, lum, cb, cr), by the lattice ``points``."""
    across = -(-width // size)
    blank = [params.background.lum, params.background.cb, params.background.cr]

    def run(table: pa.Table, points: np.ndarray) -> pa.Table:
        frame, src, px, py, *colours = _columns(table, "frame_id", "src", "px", "py", "lum", "cb", "cr")
        tx, ty = int(src[0]) % across, int(src[0]) // across
        x0, y0 = tx * size - 1, ty * size - 1
        planes = []
        for value, c in zip(blank, colours):
            plane = np.full((size + 2, size + 2), value, np.int64)
            plane[py - y0, px - x0] = c
            planes.append(plane)
        own = (px // size == tx) & (py // size == ty)
        if rows is not None:
            own &= (py >= rows[0]) & (py < rows[1])
        x, y, det, share, colours = _sampled(points, px[own], py[own], (planes, x0, y0), width, height, params.supersample)
        at, tile, place, parts = _contributions(x, y, det, share, colours, params)
        return pa.Table.from_batches([_block(frame[:1], np.zeros(len(at), np.int64), tile, place, parts, params)] if len(at) else [], _SCHEMA)

    return run


def blocks(pixels: DataFrame, control: DataFrame, width: int, height: int, params: WarpParams, rows: tuple[int, int] | None = None) -> DataFrame:
    """Blocks of sums of a warp by one lattice for all frames; rows: only source rows in [start, end)."""
    points = padded(L.points(control)[:2])
    if params.supersample.most <= 1:
        if rows is not None:
            pixels = pixels.filter((F.col("py") >= rows[0]) & (F.col("py") < rows[1]))
        return pixels.select("frame_id", "px", "py", "lum", "cb", "cr").mapInArrow(_in_place(points, width, height, params), _BLOCK)
    if rows is not None:  # samples at a band's edge lie between its rows and those beside it
        pixels = pixels.filter((F.col("py") >= rows[0] - 1) & (F.col("py") <= rows[1]))
    one = _tile_warp(width, height, params, rows, SOURCE_TILE)
    return source_tiles(pixels, width, height).groupBy("frame_id", "src").applyInArrow(lambda table: one(table, points), _BLOCK)


def packed_lattices(lattices: DataFrame) -> DataFrame:
    """(lattice_id, points): each lattice's 2 x 129 x 129 coordinates in one row."""
    xy = F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    packed = lattices.groupBy("lattice_id").agg(xy.alias("p"))
    return packed.selectExpr("lattice_id", "concat(transform(p, q -> q.x), transform(p, q -> q.y)) as points")


def blocks_by_frame(pixels: DataFrame, lattices: DataFrame, choice: DataFrame, width: int, height: int, params: WarpParams) -> DataFrame:
    """Blocks of sums where every frame is warped by a lattice of its own.

    lattices: (lattice_id, row, col, x, y); choice: (frame_id, lattice_id).  Frames without a lattice land nowhere.
    A tile and its lattice meet in one task: 266 kB beside up to 16 900 pixels."""
    size = SOURCE_TILE
    tiles = -(-width // size) * -(-height // size)
    wanted = choice.join(packed_lattices(lattices), "lattice_id").selectExpr("cast(frame_id as bigint) as frame_id", f"explode(sequence(0, {tiles - 1})) as src", "points")
    one = _tile_warp(width, height, params, None, size)

    def run(table: pa.Table, lattice: pa.Table) -> pa.Table:
        if not table.num_rows or not lattice.num_rows:
            return _SCHEMA.empty_table()
        flat = np.asarray(lattice.column("points").combine_chunks().flatten())
        return one(table, padded(flat[: 2 * (LATTICE_MAX + 1) ** 2].reshape(2, LATTICE_MAX + 1, LATTICE_MAX + 1)))

    return source_tiles(pixels, width, height).groupBy("frame_id", "src").cogroup(wanted.groupBy("frame_id", "src")).applyInArrow(run, _BLOCK)


# ---- destination tiles ------------------------------------------------------------


class _Tiles:
    """Adds up blocks of up to ``GROUPS`` tiles and gives their cells."""

    def __init__(self, params: WarpParams):
        self.t, self.width, self.height = params.tile, params.width, params.height
        self.across = -(-params.width // params.tile)
        self.place = np.arange(self.t * self.t)

    def added(self, b: pa.RecordBatch, of: np.ndarray, n: int, start=None):
        """Sums and presence [tile, place]; of: each row's tile, start: what is known of the first."""
        size = self.t * self.t
        sums, there = np.zeros((4, n * size), np.int64), np.zeros(n * size, bool)
        if start is not None:
            sums[:, :size], there[:size] = start
        cells = [np.frombuffer(x.as_buffer(), np.uint16) for x in b.column("cells")]
        at = np.repeat(of * size, list(map(len, cells))) + (np.concatenate(cells).astype(np.int64) if cells else 0)
        there[at] = True
        full = np.asarray(b.column("full"))
        if full.any():
            there.reshape(n, size)[of[full]] = True
        for k, name in enumerate(SUMS):
            np.add.at(sums[k], at, np.frombuffer(b"".join(x.as_buffer() for x in b.column(name)), np.int64))
        return sums, there

    def rows(self, frame: np.ndarray, tile: np.ndarray, sums: np.ndarray, there: np.ndarray) -> pa.RecordBatch:
        t = self.t
        dx = ((tile % self.across) * t)[:, None] + (self.place % t)[None, :]
        dy = ((tile // self.across) * t)[:, None] + (self.place // t)[None, :]
        keep = np.flatnonzero(there & ((dx < self.width) & (dy < self.height)).ravel())
        columns = [np.repeat(frame, t * t)[keep], dx.ravel()[keep].astype(np.int32), dy.ravel()[keep].astype(np.int32), *(s[keep] for s in sums)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["frame_id", "dx", "dy", *SUMS])


def _fold(params: WarpParams):
    tiles = _Tiles(params)
    size = params.tile * params.tile

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = None  # (frame, tile, sums, presence) of the last tile, which may go on
        for whole in batches:
            frame, tile = _columns(whole, "frame_id", "tile")
            new = np.append(True, (frame[1:] != frame[:-1]) | (tile[1:] != tile[:-1])) if len(frame) else np.zeros(0, bool)
            heads = np.append(np.flatnonzero(new), len(frame))
            for i in range(0, len(heads) - 1, GROUPS):
                a, e = heads[i], heads[min(i + GROUPS, len(heads) - 1)]
                of = np.cumsum(new[a:e]) - 1
                n = int(of[-1]) + 1
                start = None
                if open_ is not None:
                    if open_[:2] == (frame[a], tile[a]):
                        start = open_[2:]
                    else:
                        yield tiles.rows(np.array(open_[:1]), np.array(open_[1:2]), *open_[2:])
                sums, there = tiles.added(whole.slice(a, e - a), of, n, start)
                first = a + np.flatnonzero(new[a:e])
                if n > 1:
                    done = (n - 1) * size
                    yield tiles.rows(frame[first[:-1]], tile[first[:-1]], sums[:, :done], there[:done])
                open_ = frame[first[-1]], tile[first[-1]], sums[:, (n - 1) * size :].copy(), there[(n - 1) * size :].copy()
        if open_ is not None:
            yield tiles.rows(np.array(open_[:1]), np.array(open_[1:2]), *open_[2:])

    return run


def summed(parts: DataFrame, params: WarpParams, frames: DataFrame | None = None) -> DataFrame:
    """Cells (frame_id, dx, dy, slum, scb, scr, sw) of blocks; frames: with a row for every destination cell of these.

    Empty tiles go through the same exchange, so no join with the grid is needed."""
    if frames is not None:
        tiles = -(-params.width // params.tile) * -(-params.height // params.tile)
        grid = frames.selectExpr("frame_id", f"explode(sequence(0, {tiles - 1})) as tile", "true as full", "X'' as cells", *(f"X'' as {s}" for s in SUMS))
        parts = parts.unionByName(grid)
    ordered = parts.repartition("frame_id", "tile").sortWithinPartitions("frame_id", "tile")
    return ordered.mapInArrow(_fold(params), "frame_id long, dx int, dy int, " + ", ".join(f"{s} long" for s in SUMS))
