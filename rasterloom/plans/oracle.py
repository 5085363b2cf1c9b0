"""DuckDB SQL for the queries, written apart from the Spark plans.

A fragment's way through tile, position and corners is spelled out on its own here;
only the parameters are shared with ``queries``.
"""

from __future__ import annotations

import math


def d(x: float) -> str:
    return f"'{float(x)!r}'::DOUBLE"


PX = """
ht as (select ((count(*) + 99) // 100)::int as h from events),
px as (
  select (event_id % 100)::int as px, (event_id // 100)::int as py,
         ((4 + floor(value * 100)::bigint % 1016) * 64)::int as lum,
         ((4 + (user_id * 7) % 1016) * 64)::int as cb,
         ((4 + (event_id * 31) % 1016) * 64)::int as cr
  from events
  union all
  select (i % 100)::int, (i // 100)::int, 4096, 32768, 32768
  from range((select count(*) from events), (select (count(*) + 99) // 100 * 100 from events)) t(i)
)"""
GRID = "grid as (select (i // 129)::int as r, (i % 129)::int as c, (i % 129)::double / 128 as s, (i // 129)::double / 128 as t from range(16641) g(i))"


def affine(sx: float, sy: float, ox: float = 0.0, oy: float = 0.0) -> str:
    return f"select r, c, {d(ox)} + ({d(sx)} * 99::double / 128::double) * c as x, {d(oy)} + ({d(sy)} * (h - 1)::double / 128::double) * r as y, 0::double as z from grid, ht"


def cylinder(radius: str, span: str, height: str, cx: str, cy: str) -> str:
    return f"select r, c, {cx} + {radius} * sin((s - '0.5'::DOUBLE) * {span}) as x, {cy} + (t - '0.5'::DOUBLE) * {height} as y, {radius} * (1 - cos((s - '0.5'::DOUBLE) * {span})) as z from grid, ht"


def sphere(radius: str, sh: str, sv: str, cx: str, cy: str) -> str:
    a, b = f"((s - '0.5'::DOUBLE) * {sh})", f"((t - '0.5'::DOUBLE) * {sv})"
    return f"select r, c, {cx} + {radius} * sin({a}) * cos({b}) as x, {cy} + {radius} * sin({b}) as y, {radius} * (1 - cos({a}) * cos({b})) as z from grid, ht"


def page_turn(width: str, height: str, radius: str, progress: float, cx: str, cy: str) -> str:
    flat = f"((1 - {d(progress)}) * {width})"
    bend = f"((s * {width} - {flat}) / {radius})"
    return f"""select r, c, case when s * {width} <= {flat} then {cx} - {width} / 2 + s * {width} else {cx} - {width} / 2 + {flat} + {radius} * sin({bend}) end as x,
      {cy} + (t - '0.5'::DOUBLE) * {height} as y, case when s * {width} <= {flat} then 0::double else {radius} * (1 - cos({bend})) end as z from grid, ht"""


def quantised(lat: str) -> str:
    return f"select r, c, round(x * 1048576::double) / 1048576::double as x, round(y * 1048576::double) / 1048576::double as y, round(z * 1048576::double) / 1048576::double as z from ({lat})"


def _cells(lat: str, name: str = "") -> str:
    """The 16 points around each cell, in rows."""
    return f"""lat{name} as ({lat}),
cells{name} as (
  select i, j, list(x order by k) as lx, list(y order by k) as ly, list(z order by k) as lz
  from (select u.i, v.j, k, least(greatest(v.j - 1 + k // 4, 0), 128) as r, least(greatest(u.i - 1 + k % 4, 0), 128) as c
        from range(128) u(i), range(128) v(j), range(16) w(k)) q join lat{name} using (r, c)
  group by i, j
)"""


def _h(t: str) -> list[str]:
    t2, t3 = f"({t} * {t})", f"(({t} * {t}) * {t})"
    return [
        f"({d(-0.5)} * {t3} + {d(1)} * {t2} - {d(0.5)} * {t})",
        f"({d(1.5)} * {t3} - {d(2.5)} * {t2} + {d(1)})",
        f"({d(-1.5)} * {t3} + {d(2)} * {t2} + {d(0.5)} * {t})",
        f"({d(0.5)} * {t3} - {d(0.5)} * {t2})",
    ]


def _dh(t: str) -> list[str]:
    t2 = f"({t} * {t})"
    return [
        f"({d(-1.5)} * {t2} + {d(2)} * {t} - {d(0.5)})",
        f"({d(4.5)} * {t2} - {d(5)} * {t})",
        f"({d(-4.5)} * {t2} + {d(4)} * {t} + {d(0.5)})",
        f"({d(1.5)} * {t2} - {d(1)} * {t})",
    ]


def _sum(wv: str, wu: str, p: str) -> str:
    s = "0::double"
    for k in range(16):
        s = f"({s} + ({wv}[{k // 4 + 1}] * {wu}[{k % 4 + 1}]) * {p}[{k + 1}])"
    return s


def _surface(source: str, x: str, y: str, name: str) -> str:
    """CTEs ``name``: source.* with sx, sy, sz and the partials for one pixel, at (x, y)."""
    lu, lv = f"({x} * 128::double / 99::double)", f"(case when h > 1 then {y} * 128::double / (h - 1)::double else 0::double end)"
    scale = {"u": "(128::double / 99::double)", "v": "(case when h > 1 then 128::double / (h - 1)::double else 0::double end)"}
    return f"""{name}_a as (select q.*, h, least(greatest({lu}, 0::double), 128::double) as uu, least(greatest({lv}, 0::double), 128::double) as vv from {source} q, ht),
{name}_b as (select *, least(floor(uu)::int, 127) as ci, least(floor(vv)::int, 127) as cj from {name}_a),
{name}_c as (select *, uu - ci as tu, vv - cj as tv from {name}_b),
{name}_w as (select *, [{', '.join(_h('tu'))}] as wu, [{', '.join(_h('tv'))}] as wv, [{', '.join(_dh('tu'))}] as eu, [{', '.join(_dh('tv'))}] as ev from {name}_c),
{name} as (
  select q.* exclude (uu, vv, ci, cj, tu, tv, wu, wv, eu, ev), {_sum('wv', 'wu', 'lx')} as sx, {_sum('wv', 'wu', 'ly')} as sy, {_sum('wv', 'wu', 'lz')} as sz,
    {_sum('wv', 'eu', 'lx')} * {scale['u']} as xu, {_sum('ev', 'wu', 'lx')} * {scale['v']} as xv,
    {_sum('wv', 'eu', 'ly')} * {scale['u']} as yu, {_sum('ev', 'wu', 'ly')} * {scale['v']} as yv,
    {_sum('wv', 'eu', 'lx')} as rxu, {_sum('ev', 'wu', 'lx')} as rxv, {_sum('wv', 'eu', 'ly')} as ryu, {_sum('ev', 'wu', 'ly')} as ryv,
    {_sum('wv', 'eu', 'lz')} as rzu, {_sum('ev', 'wu', 'lz')} as rzv
  from {name}_w q join cells on i = ci and j = cj
)"""


def _fragments(dw: str, dh: str, samples: bool, tag: str = "0", z: str = "least(greatest(sz, 0), 65535)") -> str:
    """CTE frag: fragment copies in their tiles. samples: magnified pixels are sampled between pixels."""
    if samples:
        pre = f"""{_surface('px', 'px::double', 'py::double', 'mid')},
many as (select *, case when abs(xu * yv - xv * yu) > {d(4.000001)} then 4 when abs(xu * yv - xv * yu) > {d(1.000001)} then 2 else 1 end as n from mid),
subs as (
  select px, py, n, jy, jx, px::double - {d(0.5)} + (jx::double + {d(0.5)}) / n::double as qx, py::double - {d(0.5)} + (jy::double + {d(0.5)}) / n::double as qy
  from many, range(4) a(jy), range(4) b(jx) where jy < n and jx < n
),
{_surface('subs', 'qx', 'qy', 'hit')},
spot as (select *, least(greatest(qx, 0), 99::double) as ax, least(greatest(qy, 0), (h - 1)::double) as ay from hit),
tap as (select *, floor(ax)::int as x0, least(floor(ax)::int + 1, 99) as x1, floor(ay)::int as y0, least(floor(ay)::int + 1, h - 1) as y1, ax - floor(ax) as gx, ay - floor(ay) as gy from spot),
shot as (
  select tap.* {''.join(f''', round(least(greatest((a.{c} * (1 - gx) + b.{c} * gx) * (1 - gy) + (e.{c} * (1 - gx) + f.{c} * gx) * gy, 0), 65535))::int as {c}''' for c in ('lum', 'cb', 'cr'))}
  from tap join px a on a.px = x0 and a.py = y0 join px b on b.px = x1 and b.py = y0 join px e on e.px = x0 and e.py = y1 join px f on f.px = x1 and f.py = y1
)"""
    else:
        pre = f"{_surface('px', 'px::double', 'py::double', 'mid')},\nshot as (select *, 1 as n, 0 as jy, 0 as jx from mid)"
    return f"""{pre},
land as (
  select *, {dw} as dw, {dh} as dh, floor(sx)::int as fbx, floor(sy)::int as fby,
    round(least(greatest((least(1::double / abs(xu * yv - xv * yu), 1000::double) * (1::double / (n * n)::double)) * 32768::double, 0), 65535))::bigint as w
  from shot where sx >= 0 and sy >= 0 and sx < {dw} and sy < {dh}
),
frag as (
  select px, py, jy, jx, dw, dh, lum, cb, cr, w, round({z})::int as z, {tag} as tag, ox, oy, fbx // 32 + ox as tx, fby // 32 + oy as ty,
    round(((fbx % 32)::double + (sx - fbx) - ox * 32 + 1) * 16)::int - 16 as vx, round(((fby % 32)::double + (sy - fby) - oy * 32 + 1) * 16)::int - 16 as vy
  from land, range(2) a(ox), range(2) b(oy)
  where (ox = 0 or (fbx % 32 = 31 and fbx // 32 + 1 < (dw + 31) // 32)) and (oy = 0 or (fby % 32 = 31 and fby // 32 + 1 < (dh + 31) // 32))
)"""


CORNERS = """
part as (
  select *, (vx >> 4) + kx as ex, (vy >> 4) + ky as ey, (case kx when 0 then 16 - (vx & 15) else vx & 15 end) * (case ky when 0 then 16 - (vy & 15) else vy & 15 end) as raw
  from frag, range(2) c(kx), range(2) e(ky)
),
hitcell as (select *, (tx * 32 + ex)::int as dx, (ty * 32 + ey)::int as dy from part where raw > 0 and ex between 0 and 31 and ey between 0 and 31 and tx * 32 + ex < dw and ty * 32 + ey < dh)"""
SUMS = "sum((lum::bigint * w * raw) >> 8)::bigint as l, sum((cb::bigint * w * raw) >> 8)::bigint as b, sum((cr::bigint * w * raw) >> 8)::bigint as r, sum((w * raw) >> 8)::bigint as w"


def _paint(sum_: str, w: str, below: str) -> str:
    norm = f"((({sum_} + {w} // 2) // {w}) & 65535)"
    a = f"least({w}, 32768)"
    return f"(case when coalesce({w}, 0) > 0 then ({norm} * {a} + {below} * (32768 - {a}) + 16384) // 32768 else {below} end)"


BLACK = {"l": ("lum", 4096), "b": ("cb", 32768), "r": ("cr", 32768)}


def _composite(prefix: str = "", w: str = "w") -> str:
    return ", ".join(f"{_paint(prefix + s, w, str(bg))}::int as {n}" for s, (n, bg) in BLACK.items())


def _warp(lat: str, dw: str, dh: str, samples: bool) -> str:
    return f"""with {PX}, {GRID}, {_cells(lat)}, {_fragments(dw, dh, samples)}, {CORNERS},
acc as (select dx, dy, {SUMS} from hitcell group by dx, dy),
dest as (select x::int as dx, y::int as dy from range({dw}) a(x), range((select max({dh}) from ht)) b(y))
select dx, dy, {_composite()}, coalesce(w, 0)::bigint as w from dest left join acc using (dx, dy)"""


HALF = _warp(affine(0.5, 0.5), "50", "(select greatest(1, h // 2) from ht)", False)


def _projected(lat: str) -> str:
    return f"""with {PX}, {GRID}, {_cells(lat)}, {_surface('px', 'px::double', 'py::double', 'hit')}
select px, py, round(sx, 6) + 0 as x, round(sy, 6) + 0 as y, round(sz, 6) + 0 as z from hit"""


CYLINDER = cylinder(d(60), d(1.8), f"({d(0.9)} * h)", d(48.5), "(h / 2::double)")
SPHERE = sphere(d(45), d(2), d(1.5), d(50.25), "(h / 2::double)")
PAGE = page_turn(d(90), f"({d(0.8)} * h)", d(15), 0.5, d(50), "(h / 2::double)")

MORPHED = f"select a.r, a.c, {', '.join(f'a.{k} * {d(0.625)} + b.{k} * {d(0.375)} as {k}' for k in 'xyz')} from ({PAGE}) a join ({CYLINDER}) b using (r, c)"
_TURN = f"select r, c, (x - {d(50.25)}) * {d(math.cos(0.3))} + (z - 45) * {d(math.sin(0.3))} as x, y - h / 2::double as y, (z - 45) * {d(math.cos(0.3))} - (x - {d(50.25)}) * {d(math.sin(0.3))} as z from ({SPHERE}) q, ht"
TURNED = f"select r, c, {d(50.25)} + x as x, h / 2::double + (y * {d(math.cos(-0.2))} - z * {d(math.sin(-0.2))}) as y, 45 + (y * {d(math.sin(-0.2))} + z * {d(math.cos(-0.2))}) as z from ({_TURN}) q, ht"
SLANTED = f"select r, c, {d(100)} * ({d(0.8)} * s + {d(0.15)} * t) as x, h::double * ({d(0.9)} * t + {d(0.05)} * s) as y, s * t as z from grid, ht"

JACOBIAN = f"""with {PX}, {GRID}, {_cells(PAGE)}, {_surface('px', 'px::double', 'py::double', 'hit')},
e as (select *, rxu * ryv - rxv * ryu as det, rxu * rxu + rxv * rxv as p, ryu * ryu + ryv * ryv as q, rxu * ryu + rxv * ryv as o from hit),
f as (select *, sqrt((p - q) * (p - q) / 4 + o * o) as f from e)
select px, py, round(det, 4) + 0 as det, round(least(1::double / abs(det), 1000::double), 4) + 0 as k, round(sqrt(greatest((p + q) / 2 + f, 0)), 4) + 0 as major, round(sqrt(greatest((p + q) / 2 - f, 0)), 4) + 0 as minor,
  case when f > 0 and sqrt(greatest((p + q) / 2 + f, 0)) - sqrt(greatest((p + q) / 2 - f, 0)) > {d(0.001)} then round(cos(atan2(2 * o, p - q)), 4) + 0 else 0 end as axis_cos,
  case when f > 0 and sqrt(greatest((p + q) / 2 + f, 0)) - sqrt(greatest((p + q) / 2 - f, 0)) > {d(0.001)} then round(sin(atan2(2 * o, p - q)), 4) + 0 else 0 end as axis_sin,
  round(ryv * rzu - rzv * ryu, 4) + 0 as nx, round(rzv * rxu - rxv * rzu, 4) + 0 as ny, round(rxv * ryu - ryv * rxu, 4) + 0 as nz from f"""

CODE = "least(greatest(({} + 32) >> 6, 4), 1019)"
_ORDER = ("b0", "y0", "r0", "y1", "b1", "y2", "r1", "y3", "b2", "y4", "r2", "y5")


def _pack() -> str:
    def of(n: str) -> str:
        x = f"px = g * 6 + {n[1]}" if n[0] == "y" else f"px = g * 6 + {2 * int(n[1])}"
        col, pad = {"y": ("lum", 64), "b": ("cb", 512), "r": ("cr", 512)}[n[0]]
        return f"coalesce(max({CODE.format(col)}) filter (where {x}), {pad})::bigint as {n}"

    words = []
    for k in range(4):
        a, b, c = _ORDER[3 * k : 3 * k + 3]
        w = f"({a} + {b} * 1024 + {c} * 1048576)"
        words.append(" || ".join(f"printf('%02x', ({w} >> {s}) & 255)" for s in (0, 8, 16, 24)))
    return f"""with {PX}, six as (select py, px // 6 as g, {', '.join(map(of, _ORDER))} from (select *, px // 6 as g from px) group by py, px // 6)
select py as row_no, string_agg({' || '.join(words)}, '' order by g) as packed from six group by py"""


UNPACK = f"""with {PX}
select px as x, py as y, ({CODE.format('lum')} * 64)::int as v, case when px % 2 = 0 then ({CODE.format('cb')} * 64)::int end as cb, case when px % 2 = 0 then ({CODE.format('cr')} * 64)::int end as cr from px"""


def _chroma_up() -> str:
    def tap(c: str, k: int) -> str:
        return f"{c}[least(greatest(i + {k}, 0), 49) + 1]"

    def odd(c: str) -> str:
        return f"((-{tap(c, -1)} + 9 * {tap(c, 0)} + 9 * {tap(c, 1)} - {tap(c, 2)} + 8) >> 4) & 65535"

    return f"""with {PX}, rowlist as (select py, list(cb order by px) as b, list(cr order by px) as r from px where px % 2 = 0 group by py)
select (2 * i)::int as x, py as y, b[i + 1] as cb, r[i + 1] as cr from rowlist, range(50) g(i)
union all select (2 * i + 1)::int, py, ({odd('b')})::int, ({odd('r')})::int from rowlist, range(50) g(i)"""


def _chroma_down() -> str:
    taps = {-5: 3, -3: -25, -1: 150, 0: 256, 1: 150, 3: -25, 5: 3}

    def of(c: str) -> str:
        return "((" + " + ".join(f"({w}) * {c}[least(greatest(2 * i + {k}, 0), 99) + 1]" for k, w in taps.items()) + " + 256) >> 9) & 65535"

    return f"""with {PX}, rowlist as (select py, list(cb order by px) as b, list(cr order by px) as r from px group by py)
select i::int as cx, py as y, ({of('b')})::int as cb, ({of('r')})::int as cr from rowlist, range(50) g(i)"""


HEIGHT = "range((select (count(*) + 99) // 100 from events))"


def _ramp() -> str:
    def code(x: str, span: int) -> str:
        return f"((4 + ({x} * 1015 + {(span - 1) // 2}) // {span - 1}) * 64)::int"

    return f"""select 'luma' as plane, x::int as x, y::int as y, {code('x', 100)} as a, 0 as b from range(100) a(x), {HEIGHT} b(y)
union all select 'chroma', x::int, y::int, {code('x', 50)}, {code('x', 50)} from range(50) a(x), {HEIGHT} b(y)"""


ZONE = f"""with ht as (select ((count(*) + 99) // 100)::double as h from events),
r as (select x, y, h, (x - {d(49.5)}) * (x - {d(49.5)}) + (y - (h - 1) / 2) * (y - (h - 1) / 2) as r2 from range(100) a(x), {HEIGHT} b(y), ht)
select 'luma' as plane, x::int as x, y::int as y, (round(least(greatest({d(502)} + {d(438)} * cos({d(8 * math.pi)} / ({d(49.5)} * {d(49.5)} + (h - 1) / 2 * ((h - 1) / 2)) * r2), 64), 940))::int * 64)::int as a, 0 as b from r
union all select 'chroma', x::int, y::int, 32768, 32768 from range(50) a(x), {HEIGHT} b(y)"""

EXCURSION = f"""select 'luma' as plane, x::int as x, y::int as y, ([4, 20, 64, 940, 1000, 1019][x % 6 + 1] * 64)::int as a, 0 as b from range(100) a(x), {HEIGHT} b(y)
union all select 'chroma', x::int, y::int, ([4, 20, 64, 940, 1000, 1019][x % 6 + 1] * 64)::int, ([4, 20, 64, 940, 1000, 1019][x % 6 + 1] * 64)::int from range(50) a(x), {HEIGHT} b(y)"""

BINS = f"""with {PX}, {GRID}, {_cells(affine(1.5, 1.25, -4.0, 5.0))}, {_fragments('130', '(select h from ht)', True)}
select (select count(*) from subs)::bigint as source_samples, count(*) filter (where ox + oy = 0)::bigint as primary_fragments, count(*) filter (where ox + oy > 0)::bigint as replica_fragments,
  ((select count(*) from subs) - count(*) filter (where ox + oy = 0))::bigint as dropped_off_raster from frag"""


def _layer(n: int, lat: str) -> str:
    """One layer's sums over the full grid, as a subquery of its own."""
    return f"""layer{n} as (
  with {GRID}, {_cells(lat)}, {_fragments('100', '(select h from ht)', False)}, {CORNERS},
  acc as (select dx, dy, {SUMS} from hitcell group by dx, dy)
  select px as dx, py as dy, coalesce(l, 0) as l, coalesce(b, 0) as b, coalesce(r, 0) as r, coalesce(w, 0) as w from (select px, py from px) p left join acc on dx = px and dy = py
)"""


_LAYERS = f"with {PX}, {_layer(1, affine(0.75, 0.75, 2.0, 1.0))}, {_layer(2, affine(0.5, 0.5, 10.0, 5.0))}"
OPAQUE = f"""{_LAYERS}
select dx, dy, {', '.join(f"{_paint('b.' + s, 'b.w', _paint('a.' + s, 'a.w', str(bg)))}::int as {n}" for s, (n, bg) in BLACK.items())} from layer1 a join layer2 b using (dx, dy)"""
SUMMED = f"""{_LAYERS}, both_ as (select dx, dy, a.l + b.l as l, a.b + b.b as b, a.r + b.r as r, a.w + b.w as w from layer1 a join layer2 b using (dx, dy))
select dx, dy, {_composite()} from both_"""

GREY = f"select dx, dy, (case when w <= 0 then 0 when w >= 32768 then 255 else w * 255 // 32768 end)::int as grey from ({HALF})"


def _kslots(tags: int) -> str:
    z = "((py * 100 + px)::bigint * 7919) % 60000"
    tag = f"(select ((user_id + event_id * 3) % {tags})::int from events ev where ev.event_id = land.py * 100 + land.px)"
    return f"""with {PX}, {GRID}, {_cells(affine(0.75, 0.75))}, {_fragments('100', '(select h from ht)', False, tag, z)}, {CORNERS},
slot as (select dx, dy, tag, arg_min(z, py * 100 + px) as z, {SUMS} from hitcell group by dx, dy, tag)"""


NEAREST = f"""{_kslots(4)}, one as (select *, row_number() over (partition by dx, dy order by z, tag) as n from slot)
select dx, dy, {_composite()} from one where n = 1"""


def _blend() -> str:
    # one step for each slot, far to near, so that each result is computed once
    parts = ", ".join(f"max({c}) filter (where n = {k}) as {c}{k}" for k in (1, 2, 3, 4) for c in "lbrw")
    sql = f"{_kslots(4)}, one as (select *, row_number() over (partition by dx, dy order by z, tag) as n from slot), flat as (select dx, dy, {parts} from one group by dx, dy), t5 as (select *, 4096 as l5, 32768 as b5, 32768 as r5 from flat)"
    for k in (4, 3, 2, 1):
        sql += f", t{k} as (select * {''.join(f', {_paint(f'{s}{k}', f'w{k}', f'{s}p')} as {s}q' for s in 'lbr')} from (select * exclude (l5, b5, r5), l5 as lp, b5 as bp, r5 as rp from t{k + 1}))"
        sql += f", u{k} as (select * exclude (lp, bp, rp, lq, bq, rq), lq as l5, bq as b5, rq as r5 from t{k})"
        sql = sql.replace(f"from t{k + 1}))", f"from {'t5' if k == 4 else f'u{k + 1}'}))")
    return f"{sql} select dx, dy, l5::int as lum, b5::int as cb, r5::int as cr from u1"


def _evicted() -> str:
    """Contributions of each cell one by one, in order of arrival."""
    new = "struct_pack(tag := a.tag, z := a.z, l := a.l, b := a.b, r := a.r, w := a.w)"
    added = "struct_pack(tag := x.tag, z := x.z, l := x.l + a.l, b := x.b + a.b, r := x.r + a.r, w := x.w + a.w)"
    farthest = "list_position(list_transform(s, lambda q: q.z), list_max(list_transform(s, lambda q: q.z)))"
    sql = _kslots(7).replace("with ", "with recursive ", 1)
    return f"""{sql},
arr as materialized (
  select dx, dy, row_number() over (partition by dx, dy order by py, px, jy, jx) as n, tag, z, (lum::bigint * w * raw) >> 8 as l, (cb::bigint * w * raw) >> 8 as b, (cr::bigint * w * raw) >> 8 as r, (w * raw) >> 8 as w
  from hitcell
),
run as (
  select dx, dy, n, [{new}] as s from arr a where n = 1
  union all
  select a.dx, a.dy, a.n,
    case when list_contains(list_transform(s, lambda q: q.tag), a.tag) then list_transform(s, lambda x: case when x.tag = a.tag then {added} else x end)
         when len(s) < 4 then list_append(s, {new})
         else list_transform(s, lambda x, i: case when i = {farthest} then {new} else x end) end
  from run join arr a on a.dx = run.dx and a.dy = run.dy and a.n = run.n + 1
),
held as (select dx, dy, unnest(arg_max(s, n)) as e from run group by dx, dy),
one as (select dx, dy, e.l as l, e.b as b, e.r as r, e.w as w, row_number() over (partition by dx, dy order by e.z, e.tag) as n from held)
select dx, dy, {_composite()} from one where n = 1"""


FRAMES = """
ev as (
  select event_id // 2000 as frame_id, (event_id % 100)::int as px, ((event_id // 100) % 20)::int as py,
         ((4 + floor(value * 100)::bigint % 1016) * 64)::int as lum, ((4 + (user_id * 7) % 1016) * 64)::int as cb, ((4 + (event_id * 31) % 1016) * 64)::int as cr
  from events
),
pxs as (
  select f::bigint as frame_id, x::int as px, y::int as py, coalesce(lum, 4096) as lum, coalesce(cb, 32768) as cb, coalesce(cr, 32768) as cr
  from range((select (count(*) + 1999) // 2000 from events)) a(f), range(100) b(x), range(20) c(y) left join ev on ev.frame_id = f and ev.px = x and ev.py = y
)"""
FILES = f"with {FRAMES} select frame_id, px as x, py as y, ({CODE.format('lum')} * 64)::int as v from pxs"


def _animated() -> str:
    """Every frame's own lattice: what a single frame's SQL does, with the frame as a further key."""
    flat = f"((1 - p) * {d(90)})"
    bend = f"((s * {d(90)} - {flat}) / {d(15)})"
    lattice = f"""setting as (select event_id as moment, floor(value * 100)::bigint % 1000 as v from events where event_type = 'purchase'),
picked as (select f.frame_id, coalesce(arg_max(v, moment), 0)::double / 1000 as p from (select distinct frame_id from pxs) f left join setting on moment <= f.frame_id * 2000 + 1999 group by f.frame_id),
raw as (
  select frame_id, r, c, case when s * {d(90)} <= {flat} then {d(50)} - {d(90)} / 2 + s * {d(90)} else {d(50)} - {d(90)} / 2 + {flat} + {d(15)} * sin({bend}) end as x,
    {d(10)} + (t - {d(0.5)}) * {d(16)} as y from grid, picked
),
lat as (select frame_id, r, c, round(x * 1048576::double) / 1048576::double as x, round(y * 1048576::double) / 1048576::double as y, 0::double as z from raw),
cells as (
  select frame_id, i, j, list(x order by k) as lx, list(y order by k) as ly, list(z order by k) as lz
  from (select u.i, v.j, k, least(greatest(v.j - 1 + k // 4, 0), 128) as r, least(greatest(u.i - 1 + k % 4, 0), 128) as c
        from range(128) u(i), range(128) v(j), range(16) w(k)) q join lat using (r, c)
  group by frame_id, i, j
)"""
    steps = f"{_fragments('100', '20', True)}, {CORNERS}".replace("from px q", "from pxs q").replace("on i = ci and j = cj", "on i = ci and j = cj and cells.frame_id = q.frame_id").replace("select px, py, n, jy", "select frame_id, px, py, n, jy")
    for k in "abef":
        steps = steps.replace(f"join px {k} on {k}.px", f"join pxs {k} on {k}.frame_id = tap.frame_id and {k}.px")
    steps = steps.replace("select px, py, jy, jx, dw", "select frame_id, px, py, jy, jx, dw")
    return f"""with ht as (select 20 as h), {FRAMES}, {GRID}, {lattice}, {steps},
acc as (select frame_id, dx, dy, {SUMS} from hitcell group by frame_id, dx, dy),
dest as (select frame_id, px as dx, py as dy from pxs)
select frame_id, dx, dy, {_composite()}, coalesce(w, 0)::bigint as w from dest left join acc using (frame_id, dx, dy)"""


def _warped_files() -> str:
    """Half-size frames as they come out of files: codes of what a frame's own SQL gives."""
    steps = f"{_fragments('50', '10', False)}, {CORNERS}".replace("from px q", "from lumas q").replace("select px, py, jy, jx, dw", "select frame_id, px, py, jy, jx, dw")
    return f"""with ht as (select 20 as h), {FRAMES}, {GRID}, {_cells(affine(0.5, 0.5))},
lumas as (select frame_id, px, py, ({CODE.format('lum')} * 64)::int as lum, cb, cr from pxs), {steps},
acc as (select frame_id, dx, dy, {SUMS} from hitcell group by frame_id, dx, dy),
dest as (select frame_id, px as dx, py as dy from pxs where px < 50 and py < 10),
out as (select frame_id, dx, dy, {_composite()} from dest left join acc using (frame_id, dx, dy))
select frame_id, dx as x, dy as y, ({CODE.format('lum')} * 64)::int as v from out"""


KFRAME = f"""select dx, dy, coalesce(lum, 4096)::int as lum, coalesce(cb, 32768)::int as cb, coalesce(cr, 32768)::int as cr
from (select x::int as dx, y::int as dy from range(100) a(x), range((select (count(*) + 99) // 100 from events)) b(y)) g left join ({_blend()}) k using (dx, dy)"""

CAPTURE = "cap as (select user_id as source_id, event_id as frame_no, event_type <> 'click' as has_signal, event_id as at from events), kept as (select * from (select *, lag(has_signal, 1, false) over (partition by source_id order by frame_no) as before from cap) where has_signal and before)"
RING = """with recursive e as (select user_id as source_id, event_id as seq, case when event_type = 'click' then 'pop' else 'push' end as kind, row_number() over (partition by user_id order by event_id) as n from events),
run as (
  select source_id, n, seq, kind, case kind when 'push' then 1 else 0 end as depth, kind = 'push' as ok from e where n = 1
  union all
  select e.source_id, e.n, e.seq, e.kind, case e.kind when 'push' then least(run.depth + 1, 3) else greatest(run.depth - 1, 0) end, case e.kind when 'push' then run.depth < 3 else run.depth > 0 end
  from run join e on e.source_id = run.source_id and e.n = run.n + 1
)
select source_id, seq, kind, ok, depth::int as depth from run"""
REPEAT = f"""with {CAPTURE}, tick as (select source_id, t::bigint as tick, (t * 200)::bigint as "at" from (select distinct source_id from cap), range((select greatest(1, count(*) // 200) from events)) b(t)),
shown as (select t.source_id, t.tick, t."at", max(k.frame_no) as frame_no from tick t left join kept k on k.source_id is not distinct from t.source_id and k."at" <= t."at" group by all)
select source_id, tick, "at", frame_no, coalesce(frame_no = lag(frame_no) over (partition by source_id order by tick), false) as repeated from shown"""
LATEST = f"with {CAPTURE} select source_id, max(frame_no) as frame_no, arg_max(has_signal, frame_no) as has_signal from cap group by source_id"
AS_OF = f"""with {CAPTURE}, s as (select user_id as source_id, event_id as at, floor(value * 100)::bigint as value from events where event_type = 'purchase')
select cap.source_id, cap.frame_no, s.value from cap asof left join s on cap.source_id = s.source_id and cap.at >= s.at"""
ROUND_TRIP = f"with {PX} select px as x, py as y, ({CODE.format('lum')} * 64)::int as v from px"

COUNTERS = f"""select source_id, (count(*) filter (where kind = 'push'))::bigint as pushed, (count(*) filter (where kind = 'push' and not ok))::bigint as dropped,
  (count(*) filter (where kind = 'pop'))::bigint as popped, (count(*) filter (where kind = 'pop' and not ok))::bigint as empty from ({RING}) group by source_id"""
_KEYS = "['left', 'right', 'up', 'down', 'x', 'X', 'y', 'Y', 'z', 'Z', 'z', 'q', 'other']"
CONTROLS = f"""with recursive e as (select user_id as source_id, event_id as seq, {_KEYS}[((event_id * 5 + user_id) % 13)::int + 1] as key, row_number() over (partition by user_id order by event_id) as n from events),
run as (
  select source_id, n, seq, key, false as over_, 0::double as yaw, 0::double as pitch, 0::double as cx, 0::double as cy, 40::double as radius from (select source_id, 0 as n, 0::bigint as seq, '' as key from e group by source_id)
  union all
  select e.source_id, e.n, e.seq, e.key, run.over_ or run.key = 'q',
    yaw + case e.key when 'left' then {d(-0.05)} when 'right' then {d(0.05)} else 0 end, pitch + case e.key when 'up' then {d(-0.05)} when 'down' then {d(0.05)} else 0 end,
    cx + case e.key when 'x' then -10 when 'X' then 10 else 0 end, cy + case e.key when 'y' then -10 when 'Y' then 10 else 0 end,
    case e.key when 'z' then greatest(20, radius - 10) when 'Z' then radius + 10 else radius end
  from run join e on e.source_id = run.source_id and e.n = run.n + 1
)
select source_id, seq, key, round(yaw, 6) + 0 as yaw, round(pitch, 6) + 0 as pitch, round(cx, 6) + 0 as cx, round(cy, 6) + 0 as cy, round(radius, 6) + 0 as radius from run where n > 0 and not over_"""
GEOMETRY = "select w::int as width, w % 2 = 0 as supported, (w // 2)::int as chroma_width, ((w + 5) // 6)::int as groups, ((w + 5) // 6 * 16)::int as row_bytes, (((w + 5) // 6 * 16 + 127) // 128 * 128)::int as row_bytes_aligned from (select distinct user_id as w from events where user_id > 0)"
BLACK_FRAME = "select x::int as x, y::int as y, 4096 as v, case when x % 2 = 0 then 32768 end as cb, case when x % 2 = 0 then 32768 end as cr from range(100) a(x), range((select (count(*) + 99) // 100 from events)) b(y)"

ORACLE_SQL = {
    "warp_affine_half": HALF,
    "warp_identity": _warp(affine(1.0, 1.0), "100", "(select h from ht)", True),
    "warp_magnify2x": _warp(affine(1.5, 1.25, 3.0, 5.0), "150", "(select h from ht)", True),
    "warp_cylinder": _warp(quantised(CYLINDER), "100", "(select h from ht)", True),
    "project_cylinder": _projected(CYLINDER),
    "warp_sphere": _warp(quantised(SPHERE), "100", "(select h from ht)", True),
    "project_sphere": _projected(SPHERE),
    "warp_page_turn": _warp(quantised(PAGE), "100", "(select h from ht)", True),
    "project_page_turn": _projected(PAGE),
    "row_bands": _warp(affine(1.5, 1.25, 3.0, 5.0), "150", "(select h from ht)", True),
    "lattice_morph": _warp(quantised(MORPHED), "100", "(select h from ht)", True),
    "shape_registered": _warp(SLANTED, "100", "(select h from ht)", True),
    "v210_geometry": GEOMETRY,
    "black_frame": BLACK_FRAME,
    "lattice_rotate": _warp(quantised(TURNED), "100", "(select h from ht)", True),
    "jacobian_quantities": JACOBIAN,
    "v210_pack": _pack(),
    "v210_unpack": UNPACK,
    "chroma_up": _chroma_up(),
    "chroma_down": _chroma_down(),
    "pattern_ramp": _ramp(),
    "pattern_zoneplate": ZONE,
    "pattern_excursion": EXCURSION,
    "bin_stats": BINS,
    "layered_opaque": OPAQUE,
    "layered_sum": SUMMED,
    "union_sum": SUMMED,
    "coverage_grey": GREY,
    "kbuffer_opaque": NEAREST,
    "kbuffer_blend": _blend(),
    "kbuffer_evict": _evicted(),
    "kbuffer_frame": KFRAME,
    "capture_stream_counts": f"with {CAPTURE} select source_id, count(*)::bigint as frames, sum(frame_no)::bigint as numbers from kept group by source_id",
    "consume_stream": "select got, count(*)::bigint as frames, sum(event_id)::bigint as numbers from events, (values ('sink'), ('coverage')) t(got) where event_type <> 'click' group by got",
    "consumer_counts": "select count(*)::bigint as popped, (count(*) filter (where event_type <> 'purchase' and user_id % 5 <> 0))::bigint as processed, (count(*) filter (where event_type = 'purchase' or user_id % 5 = 0))::bigint as failed from events",
    "ring_counters": COUNTERS,
    "playback_results": "select " + ", ".join(f"(count(*) filter (where (event_id * 7 + user_id) % 4 = {i}))::bigint as {r}" for i, r in enumerate(("completed", "late", "dropped", "flushed"))) + " from events",
    "controls_fold": CONTROLS,
    "frame_bytes": ROUND_TRIP,
    "frame_file": ROUND_TRIP,
    "frames_files": FILES,
    "frames_files_warp": _warped_files(),
    "warp_animated": _animated(),
    "frames_sink": f"select f::bigint as frame_id, row_no, packed from ({_pack()}) p, range(3) t(f)",
    "consume_warp": f"select frame_id, dx, dy, lum, w from ({_animated()}) where frame_id % 4 <> 3",
    "capture_late_stream": f"with {CAPTURE} select source_id, frame_no from kept",
    "playback_stream": REPEAT,
    "capture_gate": f"with {CAPTURE} select source_id, frame_no from kept",
    "ring_drop": RING,
    "stream_latest_repeat": REPEAT,
    "latest_frame": LATEST,
    "settings_as_of": AS_OF,
    "frame_round_trip": ROUND_TRIP,
    "determinism": "select 0::bigint as different",
}
