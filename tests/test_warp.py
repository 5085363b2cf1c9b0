import math
import random

import pytest
from pyspark.sql import functions as F

from rasterloom.consts import Background, Supersample, WarpParams
from rasterloom.functions import spline
from rasterloom.operators import kbuffer, resolve, warp
from rasterloom.operators import lattice as L
from rasterloom.plans import pipeline
from rasterloom.sources import patterns, v210


def raster(spark, w, h, f=lambda x, y: (x, y, 0)):
    return spark.createDataFrame([(0, x, y, *f(x, y)) for y in range(h) for x in range(w)], "frame_id long, px int, py int, lum int, cb int, cr int")


def fragments(spark, scale, cap=4, w=3, h=3, off=(0.0, 0.0), dest=64, where="true"):
    control = L.build(spark, "affine", width=w, height=h, scale_x=scale, scale_y=scale, offset_x=off[0], offset_y=off[1])
    return warp.bin_stats(raster(spark, w, h).filter(where), L.stencils(control), w, h, WarpParams(dest, dest, supersample=Supersample(most=cap))).first()


@pytest.mark.parametrize("det, cap, want", [(1, 4, 1), (1.5, 4, 4), (4, 4, 4), (4.004, 4, 16), (25, 4, 16), (25, 2, 4), (25, 1, 1)])
def test_supersample_count(spark, det, cap, want):
    # slopes are damped within a lattice cell of an edge, so the middle pixel counts
    assert fragments(spark, math.sqrt(det), cap, where="px = 1 and py = 1")["source_samples"] == want


def test_off_raster(spark):
    got = fragments(spark, 1.0, w=9, h=9, off=(-4.0, 0.0))
    assert (got["dropped_off_raster"], got["primary_fragments"]) == (36, 45)


def test_replicas_reach_the_next_tile(spark):
    """Two columns and two rows lie last in a tile that has a next one; where they cross there are three copies."""
    control = L.build(spark, "affine", width=65, height=65)
    got = warp.bin_stats(raster(spark, 65, 65), L.stencils(control), 65, 65, WarpParams(65, 65, supersample=Supersample(most=1))).first()
    assert (got["primary_fragments"], got["replica_fragments"]) == (65 * 65, 4 * 65 + 4)


def test_jacobian_against_differences(spark):
    control = L.build(spark, "sphere", radius=100.0, span_h=2.0, span_v=1.6)
    r = random.Random(1)
    spots = [(i, r.uniform(3, 125), r.uniform(3, 125)) for i in range(40)]
    step = 1e-4
    rows = [(i, k, u + a * step, v + b * step) for i, u, v in spots for k, (a, b) in enumerate([(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)])]
    df = L.evaluated(L.located(spark.createDataFrame(rows, "i int, k int, u double, v double"), L.stencils(control), "u", "v"))
    got = {(x["i"], x["k"]): x for x in df.collect()}
    for i, _, _ in spots:
        for c in "xyz":
            du = (got[i, 1][c] - got[i, 2][c]) / (2 * step)
            dv = (got[i, 3][c] - got[i, 4][c]) / (2 * step)
            assert got[i, 0][f"d{c}du"] == pytest.approx(du, abs=1e-5) and got[i, 0][f"d{c}dv"] == pytest.approx(dv, abs=1e-5)


def test_control_points_are_met(spark):
    control = L.build(spark, "page_turn", progress=0.4)
    df = control.selectExpr("row", "col", "x as ex", "y as ey", "cast(col as double) as u", "cast(row as double) as v")
    df = L.evaluated(L.located(df, L.stencils(control), "u", "v"), derivatives=False)
    assert df.filter("abs(x - ex) > 1e-9 or abs(y - ey) > 1e-9").isEmpty()


def test_shapes(spark):
    c = L.build(spark, "cylinder", radius=100.0, span=2.0, height=50.0)
    assert c.filter("abs(x * x + (z - 100D) * (z - 100D) - 10000D) > 1e-6").isEmpty()
    s = L.build(spark, "sphere", radius=100.0)
    assert s.filter("abs(x * x + y * y + (z - 100D) * (z - 100D) - 10000D) > 1e-6").isEmpty()
    p = L.build(spark, "page_turn", progress=0.0)
    assert p.filter("z <> 0D").isEmpty()
    m = L.morph(c, s, 1.0).alias("m").join(s.alias("s"), ["row", "col"])
    assert m.filter("m.x <> s.x or m.y <> s.y or m.z <> s.z").isEmpty()
    back = L.rotate(L.rotate(s, 0.4, 0.0, 1.0, 2.0, 3.0), -0.4, 0.0, 1.0, 2.0, 3.0).alias("b").join(s.alias("s"), ["row", "col"])
    assert back.filter("abs(b.x - s.x) > 1e-9 or abs(b.z - s.z) > 1e-9").isEmpty()


def test_footprint_and_normal(spark):
    df = spark.createDataFrame([(3.0, 0.0, 0.0, 2.0, 0.5, 0.25), (0.0, -1.0, 1.0, 0.0, 0.0, 0.0), (1.0, 1.0, 1.0, 1.0, 0.0, 0.0)], "dxdu double, dxdv double, dydu double, dydv double, dzdu double, dzdv double")
    got = L.footprint(df).selectExpr("major", "minor", "angle", *(f"{e} as {n}" for n, e in L.NORMAL.items()), f"{L.density(L.DETERMINANT, 7.0)} as k").collect()
    assert (got[0]["major"], got[0]["minor"], got[0]["angle"]) == (3.0, 2.0, 0.0) and got[0]["nz"] == -6.0
    assert (got[1]["major"], got[1]["minor"]) == (1.0, 1.0)
    assert got[2]["k"] == 7.0 and got[2]["minor"] == pytest.approx(0.0, abs=1e-7)


def test_identity_file(spark, tmp_path):
    """A ramp through the whole file path with the identity lattice: luma is the same to the bit."""
    luma, c = patterns.ramp(spark, 24, 10)
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    assert v210.write_v210_file(luma, c, 24, 10, a)
    control = L.build(spark, "affine", width=24, height=10)
    assert pipeline.run_frame_file(spark, control, a, 24, 10, WarpParams(24, 10), b)
    got, _ = v210.read_v210_file(spark, b, 24, 10)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, luma.select("frame_id", "x", "y", "v").collect()))
    assert not pipeline.run_frame_file(spark, control, str(tmp_path / "none"), 24, 10, WarpParams(24, 10), b)
    image = v210.images_of(v210.pack(luma, c, 24), 24, 100)
    out = pipeline.run_frame_bytes(image, control, 24, 10, WarpParams(24, 10), 100)
    with open(b, "rb") as f:
        assert bytes(out.first()["bytes"]) == f.read()


def test_partitions_and_bands_do_not_matter(spark):
    r = random.Random(7)
    px = raster(spark, 40, 30, lambda x, y: (r.randrange(65536), r.randrange(65536), r.randrange(65536)))
    stencil = L.stencils(L.build(spark, "cylinder", radius=25.0, span=2.4, height=28.0, cx=20.0, cy=15.0))
    p = WarpParams(40, 30, supersample=Supersample(most=1))
    whole = sorted(map(tuple, warp.splat(warp.fragments(px, stencil, 40, 30, p), p).collect()))
    parts = [warp.fragments(px.repartition(5), stencil, 40, 30, p, (a, b)) for a, b in ((0, 7), (7, 8), (8, 30))]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    assert sorted(map(tuple, warp.splat(both, p).collect())) == whole


def test_bands_of_a_magnified_frame(spark):
    """Sub-samples at a band's edge lie between its rows and the next band's."""
    r = random.Random(8)
    px = raster(spark, 12, 12, lambda x, y: (r.randrange(65536), r.randrange(65536), r.randrange(65536)))
    stencil = L.stencils(L.build(spark, "affine", width=12, height=12, scale_x=1.9, scale_y=1.9))
    p = WarpParams(22, 22)
    whole = sorted(map(tuple, warp.splat(warp.fragments(px, stencil, 12, 12, p), p).collect()))
    for cuts in ((0, 5, 12), (0, 1, 2, 11, 12)):
        bands = [warp.splat(warp.fragments(px, stencil, 12, 12, p, b), p) for b in zip(cuts, cuts[1:])]
        assert sorted(map(tuple, resolve.sum_cells(*bands).collect())) == whole


@pytest.mark.parametrize("shape, params", [
    ("affine", {"width": 40, "height": 30, "scale_x": 0.7, "scale_y": 1.3, "offset_x": -3.3, "offset_y": 2.1}),
    ("cylinder", {"radius": 25.0, "span": 2.4, "height": 28.0, "cx": 20.0, "cy": 15.0}),
    ("sphere", {"radius": 14.0, "span_h": 6.0, "span_v": 3.0, "cx": 35.0, "cy": 33.0}),
    ("page_turn", {"width": 60.0, "height": 50.0, "radius": 6.0, "progress": 0.6, "cx": 30.0, "cy": 30.0}),
])
def test_vectors_like_expressions(spark, shape, params):
    """Sums on Arrow batches are those of the SQL expressions to the bit: folds, off-raster parts, tiles, several frames."""
    r = random.Random(9)
    px = raster(spark, 40, 30, lambda x, y: (r.randrange(65536), r.randrange(65536), r.randrange(65536))).selectExpr("explode(array(3L, 9L)) as frame_id", "px", "py", "(lum + frame_id) % 65536 as lum", "cb", "cr")
    px = px.withColumn("lum", F.col("lum").cast("int"))
    control = L.build(spark, shape, **params)
    for size, log2, most in ((70, 5, 1), (41, 3, 1), (70, 4, 4), (90, 7, 2)):
        p = WarpParams(size, size + 3, supersample=Supersample(most=most), tile_log2=log2, max_k=3.0)
        want = warp.splat(warp.fragments(px, L.stencils(control), 40, 30, p), p)
        got = warp.cells(px.repartition(5), control, 40, 30, p)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_source_tiles_meet(spark):
    """Small source tiles: taps come from a tile's border, also in bands; and small groups of destination tiles."""
    from rasterloom.operators import tiles

    r = random.Random(11)
    px = raster(spark, 35, 21, lambda x, y: (r.randrange(65536), r.randrange(65536), r.randrange(65536)))
    control = L.build(spark, "affine", width=35, height=21, scale_x=2.3, scale_y=1.6, offset_x=-2.5)
    p = WarpParams(80, 34, tile_log2=3)
    want = sorted(map(tuple, warp.splat(warp.fragments(px, L.stencils(control), 35, 21, p), p).collect()))
    assert tiles.source_tiles(px, 35, 21, 8).count() > 35 * 21
    one, points = tiles._tile_warp(35, 21, p, None, 8), tiles.padded(L.points(control)[:2])
    small = tiles.source_tiles(px, 35, 21, 8).groupBy("frame_id", "src").applyInArrow(lambda t: one(t, points), tiles._BLOCK)
    assert sorted(map(tuple, tiles.summed(small, p).collect())) == want
    bands = [warp.cells(px, control, 35, 21, p, rows=b) for b in ((0, 7), (7, 8), (8, 21))]
    assert sorted(map(tuple, resolve.sum_cells(*bands).collect())) == want


def test_tiles_go_on_from_batch_to_batch(spark):
    """Blocks of one tile in many Arrow batches, and frames that get nothing but the grid."""
    from rasterloom.operators import tiles

    r = random.Random(12)
    px = raster(spark, 30, 30, lambda x, y: (r.randrange(65536), 0, 65535)).repartition(40)
    control = L.build(spark, "affine", width=30, height=30, scale_x=0.2, scale_y=0.2)
    p = WarpParams(70, 40, supersample=Supersample(most=1))
    frames = spark.createDataFrame([(0,), (5,)], "frame_id long")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, 3)
    try:
        got = {tuple(x[:3]): tuple(x[3:]) for x in tiles.summed(tiles.blocks(px, control, 30, 30, p), p, frames).collect()}
    finally:
        spark.conf.set(key, was)
    want = {tuple(x[:3]): tuple(x[3:]) for x in warp.splat(warp.fragments(px, L.stencils(control), 30, 30, p), p, frames).collect()}
    assert got == want and len(got) == 2 * 70 * 40


def test_tags_from_pixels(spark):
    """A whole k-buffer frame: two crossing pages, the nearer wins; by two aggregations and by folding."""
    px = raster(spark, 8, 6, lambda x, y: (1000 * x, 0, 0)).selectExpr("*", "cast(px % 2 as smallint) as tag", "10 - px as depth")
    control = L.build(spark, "affine", width=8, height=6, scale_x=0.5, scale_y=0.5)
    p = WarpParams(6, 5, supersample=Supersample(most=1), kbuffer="opaque")
    out = pipeline.run_frame(px, control, 8, 6, p)
    frags = warp.fragments(px, L.stencils(control), 8, 6, p)
    both = [sorted(map(str, kbuffer.resolve(kbuffer.slots(frags, p, tags=t), "opaque").collect())) for t in (2, None)]
    assert both[0] == both[1] and out.count() == 30 and kbuffer.tag_count(px) == 2
    assert out.filter("dx = 5").select("lum", "cb", "cr").distinct().collect() == [(p.background.lum, p.background.cb, p.background.cr)]


def test_hull(spark):
    """Half covered cells stay between the colour and the background."""
    cell = spark.createDataFrame([(0, 0, 0, 900 * 64 * 16384 // 1, 150 * 64 * 16384, 850 * 64 * 16384, 16384), (0, 1, 0, 5, 5, 5, 0)], "frame_id long, dx int, dy int, slum long, scb long, scr long, sw long")
    got = resolve.composite(cell).orderBy("dx").collect()
    assert 4096 < got[0]["lum"] < 900 * 64 and 150 * 64 < got[0]["cb"] < 32768 and 32768 < got[0]["cr"] < 850 * 64
    assert (got[1]["lum"], got[1]["cb"], got[1]["cr"]) == (4096, 32768, 32768)
    low = spark.createDataFrame([(0, 0, 0, 81918, 0, 0, 1)], "frame_id long, dx int, dy int, slum long, scb long, scr long, sw long")
    assert low.selectExpr(f"{resolve.normalised('slum', 'sw')} as n").first()["n"] == 16382  # wraps


def frags(spark, rows):
    """(x, y in sixteenths from the cell, lum, w, z, tag) in order."""
    data = [(0, 0, 0, qx + 16, qy + 16, lum, 30000, 31000, w, z, tag, 0, i, 0, 0) for i, (qx, qy, lum, w, z, tag) in enumerate(rows)]
    return spark.createDataFrame(data, "frame_id long, tx int, ty int, qx int, qy int, lum int, cb int, cr int, w int, z int, tag smallint, py int, px int, sy int, sx int")


def brute_slots(rows, params):
    cells = {}
    for qx, qy, lum, w, z, tag in rows:
        bx, fx, by, fy = qx >> 4, qx & 15, qy >> 4, qy & 15
        for ox, oy in ((0, 0), (1, 0), (0, 1), (1, 1)):
            raw = (fx if ox else 16 - fx) * (fy if oy else 16 - fy)
            x, y = bx + ox, by + oy
            if not raw or not (0 <= x < min(params.tile, params.width) and 0 <= y < min(params.tile, params.height)):
                continue
            add = [(c * w * raw) >> 8 for c in (lum, 30000, 31000)] + [(w * raw) >> 8]
            slots = cells.setdefault((x, y), [])
            own = next((s for s in slots if s[0] == tag), None)
            if own:
                own[2:] = [p + q for p, q in zip(own[2:], add)]
            elif len(slots) < 4:
                slots.append([tag, z, *add])
            else:
                k = max(range(4), key=lambda i: (slots[i][1], -i))
                slots[k] = [tag, z, *add]
    return cells


def test_kbuffer(spark):
    r = random.Random(3)
    p = WarpParams(20, 20, kbuffer="blend")
    rows = [(r.randrange(-16, 150), r.randrange(0, 150), r.randrange(65536), r.choice([0, 1, 5000, 32768, 65535]), r.randrange(40), r.randrange(7)) for _ in range(900)]
    got = {(x["dx"], x["dy"]): [list(s) for s in x["slots"]] for x in kbuffer.slots(frags(spark, rows), p).collect()}
    want = brute_slots(rows, p)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}

    def over(s, below):
        c, w = s
        if w <= 0:
            return below
        n, a = ((c + w // 2) // w) & 65535, min(w, 32768)
        return (n * a + below * (32768 - a) + 16384) // 32768

    cells = kbuffer.slots(frags(spark, rows), p)
    blend = {(x["dx"], x["dy"]): x["lum"] for x in kbuffer.resolve(cells, "blend").collect()}
    near = {(x["dx"], x["dy"]): x["lum"] for x in kbuffer.resolve(cells, "opaque").collect()}
    for k, slots in want.items():
        slots = sorted(slots, key=lambda s: (s[1], s[0]))
        assert near[k] == over((slots[0][2], slots[0][5]), 4096)
        below = 4096
        for s in reversed(slots):
            below = over((s[2], s[5]), below)
        assert blend[k] == below


def test_eviction(spark):
    rows = [(0, 0, 100 * (t + 1), 1000 * (t + 1), 1000 * (t + 1), t) for t in range(6)]
    got = kbuffer.slots(frags(spark, rows), WarpParams(8, 8)).first()["slots"]
    assert sorted(s["tag"] for s in got) == [0, 1, 2, 5]


def test_layers(spark):
    schema = "frame_id long, dx int, dy int, slum long, scb long, scr long, sw long"
    low = spark.createDataFrame([(0, 0, 0, 10000 * 32768, 0, 0, 32768)], schema)
    up = spark.createDataFrame([(0, 0, 0, 50000 * 16384, 0, 0, 16384)], schema)
    assert resolve.composite_layered(low, up, 1, 1).first()["lum"] == 30000
    summed = resolve.composite_layered(low, up, 0, 1).first()
    assert summed["lum"] == resolve.composite(resolve.sum_cells(low, up)).first()["lum"]
    assert resolve.composite(up, Background(0, 0, 0)).first()["lum"] == 25000


def test_register(spark):
    L.register("plane")(lambda k=1.0: (f"({k!r}D * s)", "t", "0D"))
    assert L.build(spark, "plane", k=3.0).agg(F.max("x")).first()[0] == 3.0
    assert spline.lattice_coordinate("px", 1) == "0D"
    with pytest.raises(ValueError):
        WarpParams(0, 3)


def test_a_lattice_for_each_frame(spark):
    """Animated lattices give what each frame's own lattice gives; a frame without one shows the background."""
    r = random.Random(13)
    px = raster(spark, 30, 22, lambda x, y: (r.randrange(65536), r.randrange(65536), r.randrange(65536)))
    px = px.drop("frame_id").selectExpr("explode(array(0L, 1L, 2L, 7L)) as frame_id", "px", "py", "lum", "cb", "cr")
    p = WarpParams(33, 25)
    settings = spark.createDataFrame([(10, 0.0), (11, 0.35), (12, 0.8)], "lattice_id long, turned double")
    lattices = L.build_each(settings, "page_turn", width=28.0, height=20.0, radius=5.0, progress="turned", cx=15.0, cy=11.0)
    choice = spark.createDataFrame([(0, 11), (1, 12), (2, 11)], "frame_id long, lattice_id long")
    got = {tuple(x[:3]): tuple(x[3:]) for x in pipeline.run_frames(px, lattices, choice, 30, 22, p).collect()}
    assert len(got) == 4 * 33 * 25
    for frame, progress in ((0, 0.35), (1, 0.8), (2, 0.35)):
        control = L.build(spark, "page_turn", width=28.0, height=20.0, radius=5.0, progress=progress, cx=15.0, cy=11.0)
        want = pipeline.run_frame(px.filter(f"frame_id = {frame}"), control, 30, 22, p).collect()
        assert all(got[tuple(x[:3])] == tuple(x[3:]) for x in want)
    assert all(v == (4096, 32768, 32768, 0) for k, v in got.items() if k[0] == 7)


def test_fold_goes_on_from_batch_to_batch(spark):
    """Arrivals of a cell in many batches and tags that come back after their slot was taken."""
    r = random.Random(14)
    rows = [(0, r.choice([3, 3, 3, 4]), 0, r.randrange(9), r.randrange(50), i, r.randrange(99), 1, 2, 3) for i in range(700)]
    df = spark.createDataFrame(rows, "frame_id long, dx int, dy int, tag int, z int, i int, slum long, scb long, scr long, sw long").selectExpr("frame_id", "dx", "dy", "cast(tag as smallint) as tag", "z", "struct(i) as seq", "slum", "scb", "scr", "sw")
    want = {}
    for _, x, _, tag, z, _, *sums in rows:
        slots = want.setdefault(x, [])
        at = next((k for k, s in enumerate(slots) if s[0] == tag), None)
        if at is not None:
            slots[at] = (tag, slots[at][1], *(a + b for a, b in zip(slots[at][2:], sums)))
        elif len(slots) < 4:
            slots.append((tag, z, *sums))
        else:
            slots[max(range(4), key=lambda k: (slots[k][1], -k))] = (tag, z, *sums)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    try:
        for size in (5, 10_000):
            spark.conf.set(key, size)
            got = {x["dx"]: [tuple(s) for s in x["slots"]] for x in kbuffer.fold(df.repartition(6)).collect()}
            assert got == want
    finally:
        spark.conf.set(key, was)
