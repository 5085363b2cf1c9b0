"""Lattices: 129 x 129 control points, their shapes, and the stencil table that warps join.

Beyond its edge a lattice repeats its outermost points, which bends the surface within the outermost
cells.  One with a margin has points of its own there (rows and columns -1 and 129) and goes on as its shape does.

A shape is a pair of SQL expressions in (row, col) and their parameters; user shapes
are registered with ``register``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..consts import LATTICE_MAX
from ..functions import spline

N = LATTICE_MAX
HUGE = 8000
SHAPES: dict[str, Callable[..., tuple[str, str, str]]] = {}


def register(name: str):
    """Registers a shape: a function of keyword parameters that gives SQL for (x, y, z) in s, t (0..1), row and col."""

    def add(f):
        SHAPES[name] = f
        return f

    return add


@register("affine")
def affine(width: int, height: int, scale_x: float = 1.0, scale_y: float = 1.0, offset_x: float = 0.0, offset_y: float = 0.0):
    kx, ky = scale_x * (width - 1) / float(N), scale_y * (height - 1) / float(N)
    return f"({offset_x!r}D + {kx!r}D * col)", f"({offset_y!r}D + {ky!r}D * row)", "0D"


@register("cylinder")
def cylinder(radius: float = 200.0, span: float = math.pi / 2, height: float = 400.0, cx: float = 0.0, cy: float = 0.0):
    a = f"((s - 0.5D) * {span!r}D)"
    return f"({cx!r}D + {radius!r}D * sin({a}))", f"({cy!r}D + (t - 0.5D) * {height!r}D)", f"({radius!r}D * (1.0D - cos({a})))"


@register("sphere")
def sphere(radius: float = 200.0, span_h: float = math.pi / 2, span_v: float = math.pi / 2, cx: float = 0.0, cy: float = 0.0):
    a, b = f"((s - 0.5D) * {span_h!r}D)", f"((t - 0.5D) * {span_v!r}D)"
    return f"({cx!r}D + {radius!r}D * sin({a}) * cos({b}))", f"({cy!r}D + {radius!r}D * sin({b}))", f"({radius!r}D * (1.0D - cos({a}) * cos({b})))"


def _sql(x: float | str) -> str:
    """A parameter as SQL: a number, or an expression over the columns of ``build_each``'s table."""
    return f"({x})" if isinstance(x, str) else f"{float(x)!r}D"


@register("page_turn")
def page_turn(width: float | str = 400.0, height: float | str = 400.0, radius: float | str = 60.0, progress: float | str = 0.0, cx: float | str = 0.0, cy: float | str = 0.0):
    width, height, radius, progress, cx, cy = map(_sql, (width, height, radius, progress, cx, cy))
    spine, flat = f"({cx} - {width} / 2.0D)", f"((1.0D - {progress}) * {width})"
    sx = f"(s * {width})"
    a = f"(({sx} - {flat}) / {radius})"
    x = f"(case when {sx} <= {flat} then {spine} + {sx} else {spine} + {flat} + {radius} * sin({a}) end)"
    z = f"(case when {sx} <= {flat} then 0D else {radius} * (1.0D - cos({a})) end)"
    return x, f"({cy} + (t - 0.5D) * {height})", z


def build(spark: SparkSession, shape: str, margin: bool = False, **params) -> DataFrame:
    """(row, col, x, y, z); margin: with the points around it."""
    x, y, z = SHAPES[shape](**params)
    first, n = (-1, N + 3) if margin else (0, N + 1)
    grid = spark.range(n**2).selectExpr(f"cast(id div {n} + {first} as int) as row", f"cast(id % {n} + {first} as int) as col")
    grid = grid.selectExpr("row", "col", f"col / {float(N)}D as s", f"row / {float(N)}D as t")
    return grid.selectExpr("row", "col", f"{x} as x", f"{y} as y", f"{z} as z")


def build_each(settings: DataFrame, shape: str, **params) -> DataFrame:
    """(lattice_id, row, col, x, y, z): a lattice for each row of settings (lattice_id, ...), whose columns parameters may name."""
    x, y, z = SHAPES[shape](**params)
    grid = settings.selectExpr("*", f"explode(sequence(0, {(N + 1) ** 2 - 1})) as __i")
    grid = grid.selectExpr("*", f"cast(__i div {N + 1} as int) as row", f"cast(__i % {N + 1} as int) as col")
    grid = grid.selectExpr("*", f"col / {float(N)}D as s", f"row / {float(N)}D as t")
    return grid.selectExpr("lattice_id", "row", "col", f"{x} as x", f"{y} as y", f"{z} as z")


def rotate(lattice: DataFrame, yaw: float, pitch: float, px: float, py: float, pz: float) -> DataFrame:
    """Rigid rotation about a pivot: yaw in (x, z), then pitch in (y, z)."""
    cy, sy, cp, sp = math.cos(yaw), math.sin(yaw), math.cos(pitch), math.sin(pitch)
    d = lattice.selectExpr("row", "col", f"x - {px!r}D as a", f"y - {py!r}D as b", f"z - {pz!r}D as c")
    d = d.selectExpr("row", "col", "b", f"a * {cy!r}D + c * {sy!r}D as a", f"c * {cy!r}D - a * {sy!r}D as c")
    d = d.selectExpr("row", "col", "a", f"b * {cp!r}D - c * {sp!r}D as b", f"b * {sp!r}D + c * {cp!r}D as c")
    return d.selectExpr("row", "col", f"{px!r}D + a as x", f"{py!r}D + b as y", f"{pz!r}D + c as z")


def morph(start: DataFrame, end: DataFrame, t: float) -> DataFrame:
    """Each point at start * (1 - t) + end * t; t isn't clamped."""
    u = 1.0 - t
    both = start.alias("a").join(end.alias("b"), ["row", "col"])
    return both.selectExpr("row", "col", *(f"a.{c} * {u!r}D + b.{c} * {float(t)!r}D as {c}" for c in "xyz"))


def quantised(lattice: DataFrame, bits: int = 20) -> DataFrame:
    """The lattice, or lattices, with every coordinate rounded to a multiple of 2 ** -bits."""
    return lattice.selectExpr(*(c for c in lattice.columns if c not in "xyz"), *(f"round({c} * {float(1 << bits)!r}D) / {float(1 << bits)!r}D as {c}" for c in "xyz"))


def points(lattice: DataFrame) -> np.ndarray:
    """[x y z, row, col] of a lattice on the driver: 129 x 129 points, or 131 x 131 with a margin, whatever the frames."""
    got = lattice.select("row", "col", "x", "y", "z").limit((N + 3) ** 2 + 1).toArrow()
    if got.num_rows not in ((N + 1) ** 2, (N + 3) ** 2):
        raise ValueError(f"a lattice has {N + 1} x {N + 1} points, or {N + 3} x {N + 3} with a margin")
    margin = int(got.num_rows > (N + 1) ** 2)
    out = np.zeros((3, N + 1 + 2 * margin, N + 1 + 2 * margin))
    row, col = (np.asarray(got.column(c)) + margin for c in ("row", "col"))
    for k, c in enumerate("xyz"):
        out[k, row, col] = np.asarray(got.column(c))
    return out


def stencils(lattice: DataFrame) -> DataFrame:
    """(ci, cj, lx, ly, lz): for each of 128 x 128 cells the 16 points around it, edges repeated where there is no margin.

    16 384 rows whatever the frames, so warps broadcast it; one partition, so it is built
    without an exchange."""
    spark = lattice.sparkSession
    cells = spark.range(0, N * N, 1, 1).selectExpr(f"cast(id % {N} as int) as ci", f"cast(id div {N} as int) as cj", "explode(sequence(0, 15)) as k")
    spots = cells.selectExpr("ci", "cj", "k", "cast(cj - 1 + k div 4 as int) as __r", "cast(ci - 1 + k % 4 as int) as __c")
    spots = spots.selectExpr("*", *(f"least(greatest(__{c[0]}, 0), {N}) as {c}" for c in ("row", "col")))
    outer = lattice.filter(f"row in (-1, {N + 1}) or col in (-1, {N + 1})").selectExpr("row as __r", "col as __c", "struct(x, y, z) as __p")
    got = spots.join(F.broadcast(lattice), ["row", "col"]).join(F.broadcast(outer), ["__r", "__c"], "left")  # 16 641 points, and 520 of a margin
    got = got.selectExpr("ci", "cj", "k", *(f"coalesce(__p.{c}, {c}) as {c}" for c in "xyz"))
    got = got.groupBy("ci", "cj").agg(F.array_sort(F.collect_list(F.struct("k", "x", "y", "z"))).alias("p"))
    return got.selectExpr("ci", "cj", *(f"transform(p, q -> q.{c}) as l{c}" for c in "xyz"))


def _small_methods(spark: SparkSession) -> None:
    """The JVM doesn't compile methods over 8000 bytes of bytecode, and the spline's sums make such methods in
    whole-stage code.  With this limit Spark evaluates them by split functions: three times as fast here.
    The setting stays for the session; it changes the speed of other queries with very large methods, not results."""
    key = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(key)) > HUGE:
        spark.conf.set(key, HUGE)


def located(df: DataFrame, stencil: DataFrame, u: str, v: str) -> DataFrame:
    """df joined with the stencil of the cell of (u, v), and the powers of the offsets in it."""
    _small_methods(df.sparkSession)
    df = df.selectExpr("*", f"{spline.clamped(u)} as __u", f"{spline.clamped(v)} as __v", f"{spline.cell(u)} as ci", f"{spline.cell(v)} as cj")
    df = df.selectExpr("*", "__u - cast(ci as double) as tu", "__v - cast(cj as double) as tv").drop("__u", "__v")
    df = df.join(F.broadcast(stencil), ["ci", "cj"]).selectExpr("*", "tu * tu as tu2", "tv * tv as tv2")
    return df.selectExpr("*", "tu2 * tu as tu3", "tv2 * tv as tv3")


_SPENT = ["ci", "cj", "tu", "tv", "tu2", "tv2", "tu3", "tv3"]
_WEIGHTS = [f"{w}{k}" for w in ("wu", "wv", "du", "dv") for k in range(4)]


def evaluated(df: DataFrame, point: bool = True, derivatives: bool = True) -> DataFrame:
    """df (from ``located``) with x, y, z and/or dxdu, dxdv, dydu, dydv, dzdu, dzdv in lattice units."""
    w = {f"wu{k}": e for k, e in enumerate(spline.basis("tu"))} | {f"wv{k}": e for k, e in enumerate(spline.basis("tv"))}
    if derivatives:
        w |= {f"du{k}": e for k, e in enumerate(spline.basis_derivative("tu"))} | {f"dv{k}": e for k, e in enumerate(spline.basis_derivative("tv"))}
    df = df.selectExpr("*", *(f"{e} as {n}" for n, e in w.items()))
    out = []
    if point:
        out += [f"{spline.blended('wv', 'wu', f'l{c}')} as {c}" for c in "xyz"]
    if derivatives:
        out += [f"{spline.blended('wv', 'du', f'l{c}')} as d{c}du" for c in "xyz"] + [f"{spline.blended('dv', 'wu', f'l{c}')} as d{c}dv" for c in "xyz"]
    return df.selectExpr("*", *out).drop(*w)


def spent(df: DataFrame) -> DataFrame:
    return df.drop(*_SPENT, "lx", "ly", "lz")


# ---- quantities of the Jacobian ----------------------------------------------

DETERMINANT = "(dxdu * dydv - dxdv * dydu)"


def density(det: str, max_k: float) -> str:
    """1 / |det|, at most max_k (also where det is 0: try_divide is null there and least skips nulls)."""
    return f"least(try_divide(1D, abs({det})), {float(max_k)!r}D)"


def footprint(df: DataFrame) -> DataFrame:
    """df with the axes and angle of the filter ellipse."""
    df = df.selectExpr("*", "dxdu * dxdu + dxdv * dxdv as __p", "dydu * dydu + dydv * dydv as __q", "dxdu * dydu + dxdv * dydv as __r")
    df = df.selectExpr("*", "sqrt((0.5D * (__p - __q)) * (0.5D * (__p - __q)) + __r * __r) as __f", "0.5D * (__p + __q) as __e")
    return df.selectExpr("*", "sqrt(greatest(__e + __f, 0D)) as major", "sqrt(greatest(__e - __f, 0D)) as minor", "case when __f > 0D then 0.5D * atan2(2.0D * __r, __p - __q) else 0D end as angle").drop("__p", "__q", "__r", "__f", "__e")


NORMAL = {"nx": "dydv * dzdu - dzdv * dydu", "ny": "dzdv * dxdu - dxdv * dzdu", "nz": "dxdv * dydu - dydv * dxdu"}
