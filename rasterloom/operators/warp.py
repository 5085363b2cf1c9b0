"""The forward warp: every source pixel is sent to where the lattice puts it, and gathered there.

pixels --stencil join, Jacobian--> sub-samples --on-raster filter--> fragments
--corners--> one integer aggregation by destination cell --> composited pixels

The stencil table has a fixed size and is broadcast; the only exchange of a plain warp
is that of the aggregation, with partial sums before it.  Sums are integers, so results
are the same for any partitioning.

``cells`` does the same steps on vectors (see ``tiles``), to the same bits; the expressions here
serve what needs single fragments: the k-buffer and statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..consts import LATTICE_MAX, SUBPIXEL, Supersample, WarpParams
from ..functions import spline
from ..functions.fixed import rounded, weight
from . import lattice as L
from . import tiles

FRAGMENT = ["frame_id", "tx", "ty", "qx", "qy", "lum", "cb", "cr", "w", "z", "tag"]
SEQ = ["py", "px", "sy", "sx"]
_SUMS = (("lum", "slum"), ("cb", "scb"), ("cr", "scr"), ("w", "sw"))


def _pixel_jacobian(df: DataFrame, width: int, height: int) -> DataFrame:
    """x and y partials for one pixel instead of one lattice cell; z partials aren't scaled."""
    su = f"{float(LATTICE_MAX) / (width - 1)!r}D" if width > 1 else "0D"
    sv = f"{float(LATTICE_MAX) / (height - 1)!r}D" if height > 1 else "0D"
    return df.withColumns({c: F.expr(f"{c} * {su if c.endswith('du') else sv}") for c in ("dxdu", "dxdv", "dydu", "dydv")})


def factor(det: str, s: Supersample) -> str:
    n = f"(case when abs({det}) > {s.threshold_4x4!r}D then 4 when abs({det}) > {s.threshold_2x2!r}D then 2 else 1 end)"
    return f"least({n}, {max(1, s.most)})"


def _neighbourhoods(pixels: DataFrame) -> DataFrame:
    """pixels with tap: the 3 x 3 samples around each pixel, row by row; null beyond an edge, where no tap is taken."""
    v = F.struct("lum", "cb", "cr")
    x, y = Window.partitionBy("frame_id", "py").orderBy("px"), Window.partitionBy("frame_id", "px").orderBy("py")
    df = pixels.select("*", F.array(F.lag(v).over(x), v, F.lead(v).over(x)).alias("__row"))
    return df.select("*", F.array(F.lag("__row").over(y), F.col("__row"), F.lead("__row").over(y)).alias("tap")).drop("__row")


def fragments(pixels: DataFrame, stencil: DataFrame, width: int, height: int, params: WarpParams, rows: tuple[int, int] | None = None) -> DataFrame:
    """Fragments of every sub-sample that lands on the destination, with the order they arise in (py, px, sy, sx).

    Columns ``tag`` and ``depth`` of pixels, where there, stand for the warp's tag and the lattice's z.
    rows: only source rows in [start, end); positions and samples between rows don't change, so bands add up to the whole."""
    s, t = params.supersample, params.tile
    source = pixels
    if s.most > 1:
        if rows is not None:  # samples at a band's edge lie between its rows and those beside it
            source = source.filter((F.col("py") >= rows[0] - 1) & (F.col("py") <= rows[1]))
        source = _neighbourhoods(source)
    if rows is not None:
        source = source.filter((F.col("py") >= rows[0]) & (F.col("py") < rows[1]))
    at = L.located(source, stencil, spline.lattice_coordinate("px", width), spline.lattice_coordinate("py", height))
    if s.most <= 1:  # no pixel is magnified: the centre is the only sample
        one = L.evaluated(at)
        one = _pixel_jacobian(L.spent(one), width, height).selectExpr("*", "1 as n", "0 as sy", "0 as sx")
        return _landed(one, params, t)
    centre = _pixel_jacobian(L.spent(L.evaluated(at, point=False)), width, height)
    centre = centre.withColumn("n", F.expr(factor(L.DETERMINANT, s))).drop("dxdu", "dxdv", "dydu", "dydv", "dzdu", "dzdv")
    sub = centre.selectExpr("*", "explode(sequence(0, n * n - 1)) as __s").selectExpr("*", "cast(__s div n as int) as sy", "cast(__s % n as int) as sx").drop("__s")
    sub = sub.selectExpr("*", *(f"cast(p{a} as double) - 0.5D + (cast(s{a} as double) + 0.5D) / cast(n as double) as sub{a}" for a in "xy"))
    at = L.located(sub, stencil, spline.lattice_coordinate("subx", width), spline.lattice_coordinate("suby", height))
    sub = _pixel_jacobian(L.spent(L.evaluated(at)), width, height)
    return _landed(_bilinear(sub, width, height), params, t)


def _bilinear(df: DataFrame, width: int, height: int) -> DataFrame:
    """Colours of sub-samples between pixels: four taps, first along x, then along y; at a pixel's centre its own."""
    for a, size in (("x", width), ("y", height)):
        df = df.selectExpr("*", f"least(greatest(sub{a}, 0D), {float(size - 1)}D) as c{a}")
        df = df.selectExpr("*", f"cast(floor(c{a}) as int) as {a}0", f"least(cast(floor(c{a}) as int) + 1, {size - 1}) as {a}1", f"c{a} - floor(c{a}) as f{a}")

    def tap(x: str, y: str, c: str) -> str:
        return f"cast(get(get(tap, {y} - py + 1), {x} - px + 1).{c} as double)"

    cols = {}
    for c in ("lum", "cb", "cr"):
        top = f"({tap('x0', 'y0', c)} * (1.0D - fx) + {tap('x1', 'y0', c)} * fx)"
        low = f"({tap('x0', 'y1', c)} * (1.0D - fx) + {tap('x1', 'y1', c)} * fx)"
        cols[c] = F.expr(rounded(f"{top} * (1.0D - fy) + {low} * fy"))
    return df.withColumns(cols).drop("tap", "subx", "suby", *(f"{p}{a}" for a in "xy" for p in ("c", "f")), "x0", "x1", "y0", "y1")


def _landed(df: DataFrame, params: WarpParams, t: int) -> DataFrame:
    on = f"x >= 0D and x < {float(params.width)}D and y >= 0D and y < {float(params.height)}D"
    k = L.density(L.DETERMINANT, params.max_k)
    depth = "cast(depth as int)" if "depth" in df.columns else rounded("z")
    tag = "tag" if "tag" in df.columns else str(params.tag)
    df = df.selectExpr("*", f"{weight(f'{k} * (1.0D / cast(n * n as double))')} as w", f"{depth} as zq", "cast(floor(x) as int) as bx", "cast(floor(y) as int) as by")
    df = df.selectExpr("*", *(f"cast(b{a} div {t} as int) as t{a}" for a in "xy"), *(f"b{a} % {t} as l{a}" for a in "xy"), "x - cast(bx as double) as fx", "y - cast(by as double) as fy")
    tiles = {"x": -(-params.width // t), "y": -(-params.height // t)}
    reach = {a: f"(l{a} = {t - 1} and t{a} + 1 < {tiles[a]})" for a in "xy"}
    copies = f"filter(array(struct(0 as cx, 0 as cy), struct(1 as cx, 0 as cy), struct(0 as cx, 1 as cy), struct(1 as cx, 1 as cy)), c -> (c.cx = 0 or {reach['x']}) and (c.cy = 0 or {reach['y']}))"
    # off the raster there are no copies: a generator drops those rows, where a filter would copy x and y into constraints
    copies = f"case when {on} then {copies} else cast(array() as array<struct<cx:int,cy:int>>) end"
    df = df.selectExpr("*", f"inline({copies})")
    place = {a: rounded(f"(cast(l{a} as double) + f{a} - cast(c{a} * {t} as double) + 1.0D) * {float(SUBPIXEL)}D") for a in "xy"}
    return df.selectExpr(
        "frame_id", "tx + cx as tx", "ty + cy as ty", f"{place['x']} as qx", f"{place['y']} as qy",
        "lum", "cb", "cr", "w", "zq as z", f"cast({tag} as smallint) as tag", *SEQ, "cx + cy > 0 as replica",
    )


def corners(frags: DataFrame, params: WarpParams) -> DataFrame:
    """Up to four weighted contributions of each fragment copy, inside its own tile and the destination: cell (dy * width + dx) and raw (over 0).

    Corners that don't count have cell -1 until a filter, which the generator keeps from moving down."""
    t = params.tile
    df = frags.selectExpr("*", "(qx - 16) >> 4 as bx", "(qx - 16) & 15 as fx", "(qy - 16) >> 4 as by", "(qy - 16) & 15 as fy")
    four = []
    for j in (0, 1):
        for i in (0, 1):
            raw = f"({'fx' if i else '(16 - fx)'} * {'fy' if j else '(16 - fy)'})"
            dx, dy = f"(tx * {t} + bx + {i})", f"(ty * {t} + by + {j})"
            inside = f"{raw} > 0 and bx + {i} between 0 and {t - 1} and by + {j} between 0 and {t - 1} and {dx} < {params.width} and {dy} < {params.height}"
            four.append(f"struct(case when {inside} then {dy} * {params.width} + {dx} else -1 end as cell, {raw} as raw)")
    return df.selectExpr("*", f"inline(array({', '.join(four)}))").filter("cell >= 0")


def contribution(c: str) -> str:
    """Floored for each contribution, before the sum."""
    return f"((cast({c} as bigint) * w * raw) >> 8)" if c != "w" else "((cast(w as bigint) * raw) >> 8)"


def place(cells: DataFrame, params: WarpParams) -> DataFrame:
    """cells with dx and dy instead of their cell."""
    rest = [c for c in cells.columns if c not in ("frame_id", "cell")]
    return cells.selectExpr("frame_id", f"cast(cell % {params.width} as int) as dx", f"cast(cell div {params.width} as int) as dy", *rest)


def _summed(parts: DataFrame, params: WarpParams, frames: DataFrame | None) -> DataFrame:
    """Cells of partial sums (frame_id, cell, slum, scb, scr, sw); frames: with a row for every destination cell of these.

    Empty cells go into the same aggregation, so no join with the grid is needed."""
    if frames is not None:
        grid = frames.selectExpr("frame_id", f"explode(sequence(0, {params.width * params.height - 1})) as cell")
        parts = parts.unionByName(grid.selectExpr("*", *(f"0L as {b}" for _, b in _SUMS)))
    return place(parts.groupBy("frame_id", "cell").agg(*(F.sum(b).alias(b) for _, b in _SUMS)), params)


def splat(frags: DataFrame, params: WarpParams, frames: DataFrame | None = None) -> DataFrame:
    """Cells (frame_id, dx, dy, slum, scb, scr, sw): colour and weight sums; frames: with a row for every destination cell of these."""
    c = corners(frags, params).selectExpr("frame_id", "cell", *(f"{contribution(a)} as {b}" for a, b in _SUMS))
    return _summed(c, params, frames)


def bin_stats(pixels: DataFrame, stencil: DataFrame, width: int, height: int, params: WarpParams) -> DataFrame:
    """One row: source samples, primary and replica fragments, samples dropped off the raster."""
    s = params.supersample
    at = L.located(pixels, stencil, spline.lattice_coordinate("px", width), spline.lattice_coordinate("py", height))
    centre = _pixel_jacobian(L.spent(L.evaluated(at, point=False)), width, height).selectExpr(f"{factor(L.DETERMINANT, s)} as n")
    samples = centre.agg(F.coalesce(F.sum(F.expr("cast(n * n as bigint)")), F.lit(0)).alias("source_samples"))
    kept = fragments(pixels, stencil, width, height, params).agg(F.count_if(~F.col("replica")).alias("primary_fragments"), F.count_if(F.col("replica")).alias("replica_fragments"))
    both = samples.join(kept)  # one row each
    return both.selectExpr("source_samples", "primary_fragments", "replica_fragments", "source_samples - primary_fragments as dropped_off_raster")


def cells(pixels: DataFrame, control: DataFrame, width: int, height: int, params: WarpParams, frames: DataFrame | None = None, rows: tuple[int, int] | None = None) -> DataFrame:
    """Colour and weight sums of a warp by the lattice ``control``; frames: with a row for every destination cell of these; rows: only source rows in [start, end)."""
    return tiles.summed(tiles.blocks(pixels, control, width, height, params, rows), params, frames)


def cells_by_frame(pixels: DataFrame, lattices: DataFrame, choice: DataFrame, width: int, height: int, params: WarpParams, frames: DataFrame | None = None) -> DataFrame:
    """``cells`` where each frame has a lattice of its own: lattices (lattice_id, row, col, x, y), choice (frame_id, lattice_id)."""
    return tiles.summed(tiles.blocks_by_frame(pixels, lattices, choice, width, height, params), params, frames)
