"""Normalise, then blend: sums of cells become colours before anything is composited."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..consts import WEIGHT_UNITY, Background
from ..functions.fixed import wrap16

_PARTS = ("lum", "cb", "cr")


def normalised(c: str, w: str) -> str:
    """Rounded quotient, modulo 2**16 as the format stores it; only where w > 0."""
    return wrap16(f"({c} + {w} div 2) div nullif({w}, 0)")


def blended(colour: str, w: str, below: str) -> str:
    a = f"least(greatest({w}, 0L), {WEIGHT_UNITY}L)"
    return f"(({colour} * {a} + {below} * ({WEIGHT_UNITY}L - {a}) + {WEIGHT_UNITY // 2}L) div {WEIGHT_UNITY}L)"


def over(c: str, w: str, below: str) -> str:
    """A cell's colour over what is below it; below where the cell isn't covered."""
    return f"(case when coalesce({w}, 0L) > 0 then {blended(normalised(c, w), w, f'cast({below} as bigint)')} else cast({below} as bigint) end)"


def composite(cells: DataFrame, background: Background = Background(), keep: tuple[str, ...] = ()) -> DataFrame:
    """(frame_id, dx, dy, lum, cb, cr, w) of cells (slum, scb, scr, sw) over a flat background."""
    cols = [f"cast({over(f's{c}', 'sw', str(getattr(background, c)))} as int) as {c}" for c in _PARTS]
    return cells.selectExpr("frame_id", "dx", "dy", *cols, "sw as w", *keep)


def composite_layered(lower: DataFrame, upper: DataFrame, upper_tag: int, opaque_tag: int, background: Background = Background()) -> DataFrame:
    """Two full grids of cells: an opaque upper layer covers the lower one, else their sums are resolved together."""
    keys = ["frame_id", "dx", "dy"]
    both = lower.alias("a").join(upper.alias("b"), keys)
    if upper_tag == opaque_tag:
        cols = [f"cast({over(f'b.s{c}', 'b.sw', over(f'a.s{c}', 'a.sw', str(getattr(background, c))))} as int) as {c}" for c in _PARTS]
    else:
        cols = [f"cast({over(f'(a.s{c} + b.s{c})', '(a.sw + b.sw)', str(getattr(background, c)))} as int) as {c}" for c in _PARTS]
    return both.selectExpr(*keys, *cols)


def sum_cells(*layers: DataFrame) -> DataFrame:
    """Component sums of cells of any number of layers: a union and one aggregation."""
    out = layers[0]
    for x in layers[1:]:
        out = out.unionByName(x)
    return out.groupBy("frame_id", "dx", "dy").agg(*(F.sum(x).alias(x) for x in ("slum", "scb", "scr", "sw")))


def coverage_grey(w: str) -> str:
    """Coverage as 0..255."""
    return f"cast(case when coalesce({w}, 0L) <= 0 then 0 when {w} >= {WEIGHT_UNITY} then 255 else {w} * 255 div {WEIGHT_UNITY} end as int)"
