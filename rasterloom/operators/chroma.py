"""Chroma resampling between half and full horizontal rate: short filters as window expressions.

Rows are independent: one exchange by (frame, row), one sort.  Taps beyond an end
take the end's sample; results wrap at 16 bits as the format does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import wrap16


def _taps(df: DataFrame, x: str, names: list[str], offsets: list[int]) -> DataFrame:
    order = Window.partitionBy("frame_id", "y").orderBy(x)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cols = {}
    for n in names:
        for k in offsets:
            near = F.lead(n, k).over(order) if k > 0 else F.lag(n, -k).over(order)
            end = F.last(n).over(whole) if k > 0 else F.first(n).over(whole)
            cols[f"{n}{'p' if k > 0 else 'm'}{abs(k)}"] = F.coalesce(near, end)
    return df.withColumns(cols)


def upsample(chroma: DataFrame) -> DataFrame:
    """chroma422 (frame_id, cx, y, cb, cr) to (frame_id, x, y, cb, cr) at full rate."""
    t = _taps(chroma, "cx", ["cb", "cr"], [-1, 1, 2])

    def between(c: str) -> str:
        return wrap16(f"shiftright(-{c}m1 + 9 * {c} + 9 * {c}p1 - {c}p2 + 8, 4)")

    pairs = f"inline(array(named_struct('x', cx * 2, 'cb', cb, 'cr', cr), named_struct('x', cx * 2 + 1, 'cb', {between('cb')}, 'cr', {between('cr')})))"
    return t.selectExpr("frame_id", "y", pairs).select("frame_id", "x", "y", "cb", "cr")


def downsample(full: DataFrame) -> DataFrame:
    """(frame_id, x, y, cb, cr) at full rate to chroma422."""
    t = _taps(full, "x", ["cb", "cr"], [-5, -3, -1, 1, 3, 5]).filter("x % 2 = 0")

    def of(c: str) -> str:
        return wrap16(f"shiftright(3 * {c}m5 - 25 * {c}m3 + 150 * {c}m1 + 256 * {c} + 150 * {c}p1 - 25 * {c}p3 + 3 * {c}p5 + 256, 9)")

    return t.selectExpr("frame_id", "cast(x div 2 as int) as cx", "y", f"{of('cb')} as cb", f"{of('cr')} as cr")
