"""Queries of the raster engine over the driver's tables; their SQL is in ``oracle``."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..consts import Background, Supersample, WarpParams
from ..functions import spline
from ..operators import chroma, kbuffer, resolve, warp
from ..operators import lattice as L
from ..sources import patterns, v210, v210_files
from ..sources.frames import events_frame, events_frames, planes
from ..sources.paths import scratch
from ..streaming import consumer, live, ordered
from . import pipeline
from .oracle import ORACLE_SQL  # noqa: F401

PLAIN = Supersample(most=1)
BEGIN = 1_000  # second at which the events' stream begins


def _one(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.col("id").alias("frame_id"))


def _out(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(names or ("dx", "dy", "lum", "cb", "cr", "w")))


def _warp(spark, sf_dir, control, params: WarpParams, frame=None) -> DataFrame:
    pixels, w, h = frame or events_frame(spark, sf_dir)
    return pipeline.run_frame(pixels, control, w, h, params, _one(spark))


def warp_affine_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the events frame at half size."""
    frame = events_frame(spark, sf_dir)
    _, w, h = frame
    control = L.build(spark, "affine", width=w, height=h, scale_x=0.5, scale_y=0.5)
    return _out(_warp(spark, sf_dir, control, WarpParams(w // 2, max(1, h // 2), supersample=PLAIN), frame))


def warp_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = events_frame(spark, sf_dir)
    _, w, h = frame
    return _out(_warp(spark, sf_dir, L.build(spark, "affine", width=w, height=h), WarpParams(w, h), frame))


def _magnified(spark: SparkSession, w: int, h: int) -> tuple[DataFrame, WarpParams]:
    return L.build(spark, "affine", width=w, height=h, scale_x=1.5, scale_y=1.25, offset_x=3.0, offset_y=5.0), WarpParams(150, h)


def warp_magnify2x(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = events_frame(spark, sf_dir)
    return _out(_warp(spark, sf_dir, *_magnified(spark, *frame[1:]), frame))


def row_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The magnified frame in three bands of source rows, each warped by itself and their cells added up."""
    pixels, w, h = events_frame(spark, sf_dir)
    control, params = _magnified(spark, w, h)
    cuts = [0, h // 3, h // 3 + 1, h]
    bands = [warp.cells(pixels, control, w, h, params, None if b[0] else _one(spark), rows=b) for b in zip(cuts, cuts[1:])]  # the first has every cell
    return _out(resolve.composite(resolve.sum_cells(*bands)))


def _curved(w: int, h: int) -> dict[str, dict]:
    return {
        "cylinder": {"radius": 60.0, "span": 1.8, "height": 0.9 * h, "cx": 48.5, "cy": h / 2.0},
        "sphere": {"radius": 45.0, "span_h": 2.0, "span_v": 1.5, "cx": 50.25, "cy": h / 2.0},
        "page_turn": {"width": 90.0, "height": 0.8 * h, "radius": 15.0, "progress": 0.5, "cx": 50.0, "cy": h / 2.0},
    }


def _warp_curved(shape: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The picture, off-raster parts and folds included; control points lie on a grid of 2 ** -20, as sines of different engines differ in the last bit."""
        frame = events_frame(spark, sf_dir)
        _, w, h = frame
        control = L.quantised(L.build(spark, shape, **_curved(w, h)[shape]))
        return _out(_warp(spark, sf_dir, control, WarpParams(w, h), frame))

    return run


def _project(shape: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Where the curved lattice sends every pixel, rounded."""
        pixels, w, h = events_frame(spark, sf_dir)
        stencil = L.stencils(L.build(spark, shape, **_curved(w, h)[shape]))
        at = L.located(pixels, stencil, spline.lattice_coordinate("px", w), spline.lattice_coordinate("py", h))
        return L.spent(L.evaluated(at, derivatives=False)).selectExpr("px", "py", *(f"round({c}, 6) + 0D as {c}" for c in "xyz"))

    return run


def lattice_morph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events frame between a page and a cylinder."""
    frame = events_frame(spark, sf_dir)
    _, w, h = frame
    a, b = (L.build(spark, shape, **_curved(w, h)[shape]) for shape in ("page_turn", "cylinder"))
    return _out(_warp(spark, sf_dir, L.quantised(L.morph(a, b, 0.375)), WarpParams(w, h), frame))


def lattice_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events frame on a sphere that is turned about its centre."""
    frame = events_frame(spark, sf_dir)
    _, w, h = frame
    turned = L.rotate(L.build(spark, "sphere", **_curved(w, h)["sphere"]), 0.3, -0.2, 50.25, h / 2.0, 45.0)
    return _out(_warp(spark, sf_dir, L.quantised(turned), WarpParams(w, h), frame))


def shape_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events frame in a shape of the user's own."""
    frame = events_frame(spark, sf_dir)
    _, w, h = frame
    L.register("slanted")(lambda width, height: (f"({float(width)!r}D * (0.8D * s + 0.15D * t))", f"({float(height)!r}D * (0.9D * t + 0.05D * s))", "(s * t)"))
    return _out(_warp(spark, sf_dir, L.build(spark, "slanted", width=w, height=h), WarpParams(w, h), frame))


def jacobian_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Determinant, density, ellipse and normal; the ellipse's angle by cosine and sine of its double, 0 where it is a circle."""
    pixels, w, h = events_frame(spark, sf_dir)
    stencil = L.stencils(L.build(spark, "page_turn", **_curved(w, h)["page_turn"]))
    at = L.located(pixels, stencil, spline.lattice_coordinate("px", w), spline.lattice_coordinate("py", h))
    j = L.footprint(L.spent(L.evaluated(at, point=False)))
    cols = {"det": L.DETERMINANT, "k": L.density(L.DETERMINANT, 1000.0), "major": "major", "minor": "minor"} | L.NORMAL
    cols |= {f"axis_{f}": f"case when major - minor > 0.001D then {f}(2D * angle) else 0D end" for f in ("cos", "sin")}
    return j.selectExpr("px", "py", *(f"round({e}, 4) + 0D as {n}" for n, e in cols.items()))


def v210_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layout of packed rows as wide as any user's number in the events table."""
    widths = spark.read.parquet(f"{sf_dir}/events.parquet").filter("user_id > 0").select(F.col("user_id").cast("int").alias("width")).distinct()
    return v210.geometry(widths)


def v210_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels, w, _ = events_frame(spark, sf_dir)
    return v210.pack(*planes(pixels), w).selectExpr("row_no", "lower(hex(bytes)) as packed")


def v210_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed and unpacked again: the frame with its codes clamped."""
    pixels, w, _ = events_frame(spark, sf_dir)
    luma, c = v210.unpack(v210.pack(*planes(pixels), w), w)
    return luma.selectExpr("x", "y", "v", "x div 2 as cx", "x % 2 as odd").join(c, ["cx", "y"], "left").selectExpr("x", "y", "v", "case when odd = 0 then cb end as cb", "case when odd = 0 then cr end as cr")


def black_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Black of the events frame's size."""
    _, w, h = events_frame(spark, sf_dir)
    luma, c = v210.unpack(v210.black_frame(spark, w, h), w)
    return luma.join(c.selectExpr("cx * 2 as x", "y", "cb", "cr"), ["x", "y"], "left").select("x", "y", "v", "cb", "cr")


def chroma_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels, _, _ = events_frame(spark, sf_dir)
    return chroma.upsample(planes(pixels)[1]).select("x", "y", "cb", "cr")


def chroma_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels, _, _ = events_frame(spark, sf_dir)
    return chroma.downsample(pixels.selectExpr("frame_id", "px as x", "py as y", "cb", "cr")).select("cx", "y", "cb", "cr")


def _pattern(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The pattern in the events frame's size."""
        luma, c = patterns.pattern(spark, name, *events_frame(spark, sf_dir)[1:])
        a = luma.selectExpr("'luma' as plane", "x", "y", "v as a", "0 as b")
        return a.unionByName(c.selectExpr("'chroma' as plane", "cx as x", "y", "cb as a", "cr as b"))

    return run


def bin_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels, w, h = events_frame(spark, sf_dir)
    control = L.build(spark, "affine", width=w, height=h, scale_x=1.5, scale_y=1.25, offset_x=-4.0, offset_y=5.0)
    return warp.bin_stats(pixels, L.stencils(control), w, h, WarpParams(130, h))


def _layers(spark: SparkSession, sf_dir: str):
    pixels, w, h = events_frame(spark, sf_dir)
    params = WarpParams(w, h, supersample=PLAIN)
    cells = []
    for scale, off in ((0.75, 2.0), (0.5, 10.0)):
        control = L.build(spark, "affine", width=w, height=h, scale_x=scale, scale_y=scale, offset_x=off, offset_y=off / 2)
        cells.append(warp.cells(pixels, control, w, h, params, _one(spark)))
    return cells


def layered_opaque(spark: SparkSession, sf_dir: str) -> DataFrame:
    lower, upper = _layers(spark, sf_dir)
    return _out(resolve.composite_layered(lower, upper, 1, 1), "dx", "dy", "lum", "cb", "cr")


def layered_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    lower, upper = _layers(spark, sf_dir)
    return _out(resolve.composite_layered(lower, upper, 0, 1), "dx", "dy", "lum", "cb", "cr")


def union_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both layers' cells in one aggregation: the same pixels as ``layered_sum``."""
    return _out(resolve.composite(resolve.sum_cells(*_layers(spark, sf_dir))), "dx", "dy", "lum", "cb", "cr")


def coverage_grey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warp_affine_half(spark, sf_dir).selectExpr("dx", "dy", f"{resolve.coverage_grey('w')} as grey")


def _tagged(spark: SparkSession, sf_dir: str, tags: int):
    """The events frame, tagged and at depths by user, its lattice at three quarters, and parameters."""
    extra = {"tag": f"cast((user_id + event_id * 3) % {tags} as smallint)", "depth": "cast((event_id * 7919) % 60000 as int)"}
    pixels, w, h = events_frame(spark, sf_dir, extra=extra)
    params = WarpParams(w, h, supersample=PLAIN, kbuffer="blend", background=Background(4096, 32768, 32768))
    return pixels, L.build(spark, "affine", width=w, height=h, scale_x=0.75, scale_y=0.75), params


def _kbuffer(mode: str, tags: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Covered cells."""
        pixels, control, params = _tagged(spark, sf_dir, tags)
        frags = warp.fragments(pixels, L.stencils(control), params.width, params.height, params)
        cells = kbuffer.slots(frags, params, tags=kbuffer.tag_count(pixels))
        return _out(kbuffer.resolve(cells, mode, params.background), "dx", "dy", "lum", "cb", "cr")

    return run


def kbuffer_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole picture, from tagged pixels at depths."""
    pixels, control, params = _tagged(spark, sf_dir, 4)
    return _out(pipeline.run_frame(pixels, control, params.width, params.height, params, _one(spark)), "dx", "dy", "lum", "cb", "cr")


def _capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.selectExpr("user_id as source_id", "event_id as frame_no", "event_type <> 'click' as has_signal", "event_id as at")


def capture_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.captured(_capture(spark, sf_dir)).select("source_id", "frame_no")


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of frames."""
    path = f"{sf_dir}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[t]")  # a pattern that only this table matches
    return events.selectExpr("user_id as source_id", "event_id as frame_no", "event_type <> 'click' as has_signal")


def capture_stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source, how many frames the streaming gate lets through, and the sum of their numbers."""
    at = scratch(spark, "captured")
    writer = live.captured_stream(_streamed(spark, sf_dir)).writeStream.format("parquet").option("path", f"{at}/frames").option("checkpointLocation", f"{at}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema("source_id long, frame_no long").parquet(f"{at}/frames")
    return got.groupBy("source_id").agg(F.count(F.lit(1)).alias("frames"), F.sum("frame_no").alias("numbers"))


def consume_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with a signal through the consumer: what the sink and what the coverage callback got."""
    at = scratch(spark, "consumed")

    def into(name: str):
        sink = live.keyed(f"{at}/{name}")
        return lambda df, n: sink(df.select("frame_no"), n)

    query = live.consume(_streamed(spark, sf_dir), lambda df: df.filter("has_signal"), into("sink"), into("coverage"))
    query.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    got = [spark.read.parquet(f"{at}/{name}").selectExpr(f"'{name}' as got", "frame_no") for name in ("sink", "coverage")]
    return got[0].unionByName(got[1]).groupBy("got").agg(F.count(F.lit(1)).alias("frames"), F.sum("frame_no").alias("numbers"))


def _ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id as source_id", "event_id as seq", "case when event_type = 'click' then 'pop' else 'push' end as kind")
    return live.admitted(events, 3)


def ring_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ring of three frames; each click takes one."""
    return _ring(spark, sf_dir)


def ring_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.ring_counters(_ring(spark, sf_dir))


def consumer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames in two formats and two widths; 1920 wide in the packed format is what the consumer takes."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    frames = events.selectExpr("case when event_type = 'purchase' then 'rgb' else 'v210' end as mode", "case when user_id % 5 = 0 then 720 else 1920 end as width", "1080 as height")
    return live.consumer_stats(frames, 1920, 1080)


def playback_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = ", ".join(f"'{r}'" for r in ("completed", "late", "dropped", "flushed"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return live.results(events.selectExpr(f"element_at(array({results}), cast((event_id * 7 + user_id) % 4 as int) + 1) as result"))


def controls_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source's keys, up to the one that ends its loop; the radius starts near its floor."""
    keys = ", ".join(f"'{k}'" for k in (*live.CONTROLS, "z", "q", "other"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    got = live.controls(events.selectExpr("user_id as source_id", "event_id as seq", f"element_at(array({keys}), cast((event_id * 5 + user_id) % 13 as int) + 1) as key"), radius=40.0)
    return got.selectExpr("source_id", "seq", "key", *(f"round({c}, 6) + 0D as {c}" for c in ("yaw", "pitch", "cx", "cy", "radius")))


def stream_latest_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Playback of every source of the n events: ticks every 200 numbers, against the frames captured."""
    capture = _capture(spark, sf_dir)
    return live.playback_every(live.captured(capture), capture.select("source_id").distinct(), 200, max(1, capture.count() // 200))


def latest_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.latest(_capture(spark, sf_dir)).selectExpr("source_id", "frame.frame_no as frame_no", "frame.has_signal as has_signal")


def settings_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame with the last value that its source had set (by a purchase) up to it."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    settings = events.filter("event_type = 'purchase'").selectExpr("user_id as source_id", "event_id as at", "cast(floor(value * 100D) as bigint) as value")
    return live.as_of(_capture(spark, sf_dir), settings).select("source_id", "frame_no", "value")


def _identity(spark: SparkSession, w: int, h: int):
    """With a margin, so the edges aren't bent: every pixel comes to lie where it was, however large the frame."""
    return L.build(spark, "affine", margin=True, width=w, height=h), w, h, WarpParams(w, h)


def frame_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed rows through the identity warp: luma comes back to the bit."""
    pixels, w, h = events_frame(spark, sf_dir)
    out = pipeline.run_frame_rows(v210.pack(*planes(pixels), w), *_identity(spark, w, h))
    return v210.unpack(out, w)[0].select("x", "y", "v")


def frame_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole image whose rows begin every 384 bytes to one whose rows begin every 512."""
    pixels, w, h = events_frame(spark, sf_dir)
    image = v210.images_of(v210.pack(*planes(pixels), w), w, 384)
    out = pipeline.run_frame_bytes(image, *_identity(spark, w, h), 384, 512)
    return v210.unpack(v210.image_rows(out, w, h, 512), w)[0].select("x", "y", "v")


def frame_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A packed file, warped into another, read back."""
    pixels, w, h = events_frame(spark, sf_dir)
    at = scratch(spark, "frames")
    if not v210.write_v210_file(*planes(pixels), w, h, f"{at}/a.v210"):
        raise RuntimeError("the frame could not be written")
    control, _, _, params = _identity(spark, w, h)
    if not pipeline.run_frame_file(spark, control, f"{at}/a.v210", w, h, params, f"{at}/b.v210"):
        raise RuntimeError("the frame could not be warped")
    return v210.read_v210_file(spark, f"{at}/b.v210", w, h)[0].select("x", "y", "v")


def frames_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three packed frames through the distributed sink."""
    pixels, w, _ = events_frame(spark, sf_dir)
    rows = v210.pack(*planes(pixels), w).selectExpr("explode(array(0L, 1L, 2L)) as frame_id", "row_no", "bytes")
    at = scratch(spark, "sink")
    v210.write_frames(rows, f"{at}/frames")
    return spark.read.parquet(f"{at}/frames").selectExpr("cast(frame_id as bigint) as frame_id", "row_no", "lower(hex(bytes)) as packed")


def frames_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame of the events table as a packed file in a folder, read back."""
    pixels, w, h = events_frames(spark, sf_dir)
    at = scratch(spark, "packed")
    v210_files.write_frames(v210.pack(*planes(pixels), w), f"{at}/frames", w, h)
    return v210.unpack(v210_files.read_frames(spark, f"{at}/frames", w, h), w)[0].select("frame_id", "x", "y", "v")


def frames_files_warp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of packed frames through a lattice into another folder, whose rows are returned."""
    pixels, w, h = events_frames(spark, sf_dir)
    at = scratch(spark, "packed")
    v210_files.write_frames(v210.pack(*planes(pixels), w), f"{at}/source", w, h)
    control = L.build(spark, "affine", width=w, height=h, scale_x=0.5, scale_y=0.5)
    pipeline.run_frame_files(spark, control, f"{at}/source", w, h, WarpParams(w // 2, h // 2, supersample=PLAIN), f"{at}/target")
    return v210.unpack(v210_files.read_frames(spark, f"{at}/target", w // 2, h // 2), w // 2)[0].select("frame_id", "x", "y", "v")


def _progress(spark: SparkSession, sf_dir: str, frames: DataFrame, per_frame: int) -> DataFrame:
    """(frame_id, lattice_id): for each frame the last setting up to its end, in thousandths (at most 999); 0 before the first."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    settings = events.filter("event_type = 'purchase'").selectExpr("0L as source_id", "event_id as at", "cast(floor(value * 100D) as bigint) % 1000 as value")
    taken = frames.selectExpr("0L as source_id", "frame_id as frame_no", f"frame_id * {per_frame} + {per_frame - 1} as at")
    return live.as_of(taken, settings).selectExpr("frame_no as frame_id", "coalesce(value, 0L) as lattice_id")


def _pages(choice: DataFrame, h: int) -> DataFrame:
    return L.build_each(choice.select("lattice_id").distinct(), "page_turn", width=90.0, height=0.8 * h, radius=15.0, progress="lattice_id / 1000D", cx=50.0, cy=h / 2.0)


def warp_animated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames of the events table under a turning page: each frame's lattice is the page at the progress last set before the frame's end."""
    pixels, w, h = events_frames(spark, sf_dir)
    frames = pixels.select("frame_id").distinct()
    choice = _progress(spark, sf_dir, frames, w * h)
    out = pipeline.run_frames(pixels, L.quantised(_pages(choice, h)), choice, w, h, WarpParams(w, h), frames)
    return _out(out, "frame_id", "dx", "dy", "lum", "cb", "cr", "w")


def consume_warp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames of the events table as a stream of packed images, of which every fourth has another format: each is warped by the page in force."""
    pixels, w, h = events_frames(spark, sf_dir)
    at = scratch(spark, "consumed")
    images = v210.images_of(v210.pack(*planes(pixels), w), w)
    frames = images.selectExpr("frame_id", "if(frame_id % 4 = 3, 'rgb', 'v210') as mode", f"{w} as width", f"{h} as height", "bytes")
    frames.repartitionByRange(4, "frame_id").write.parquet(f"{at}/in")

    def in_force(ids: DataFrame) -> tuple[DataFrame, DataFrame]:
        choice = _progress(spark, sf_dir, ids, w * h)
        return L.quantised(_pages(choice, h)), choice

    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    query = consumer.warp_consumer(stream, in_force, w, h, WarpParams(w, h), f"{at}/out")
    query.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return consumer.published(spark, f"{at}/out").select("frame_id", "dx", "dy", "lum", "w")


def _timed_stream(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    """The capture events, one a second, as a stream of four files in which events come up to two blocks of 250 late.  A row of no source follows, later than all."""
    events = _capture(spark, sf_dir).selectExpr("source_id", "frame_no", "has_signal", f"timestamp_seconds(at + {BEGIN}) as ts")
    count, files = events.count(), 4
    events = events.withColumn("file", F.expr(f"(frame_no div 250 + pmod(hash(frame_no), 2)) * {files} div ({count} div 250 + 2)"))
    for k in range(files):  # one after another: a stream takes files in the order of their times
        events.filter(F.col("file") == k).drop("file").repartition(1).write.mode("append").parquet(f"{at}/in")
    end = spark.range(1).selectExpr("cast(null as long) as source_id", "id as frame_no", "false as has_signal", f"timestamp_seconds({count + 2000 + BEGIN}) as ts")
    end.write.mode("append").parquet(f"{at}/in")
    schema = "source_id long, frame_no long, has_signal boolean, ts timestamp"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")


def _streamed_out(df: DataFrame, at: str) -> DataFrame:
    query = df.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    query.start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{at}/out")


def capture_late_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that capture pushes, from a stream in which they come late and out of order."""
    at = scratch(spark, "late")
    return _streamed_out(ordered.captured_late(_timed_stream(spark, sf_dir, at), "1500 seconds"), at)


def playback_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Playback of that stream: a tick every 200 seconds for every source."""
    at = scratch(spark, "played")
    last = max(1, spark.read.parquet(f"{sf_dir}/events.parquet").count() // 200) - 1
    got = _streamed_out(ordered.playback_runs(_timed_stream(spark, sf_dir, at), 200_000, "1500 seconds", last, start=BEGIN * 1000), at)
    return live.played(got.filter("source_id is not null")).selectExpr("source_id", "tick", "tick * 200 as at", "frame_no", "repeated")


def determinism(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the flagship that change with the partitioning of its input: none."""
    pixels, w, h = events_frame(spark, sf_dir)
    control = L.build(spark, "affine", width=w, height=h, scale_x=0.5, scale_y=0.5)
    params = WarpParams(w // 2, max(1, h // 2), supersample=PLAIN)
    a, b = (pipeline.run_frame(pixels.repartition(n, *by), control, w, h, params, _one(spark)) for n, by in ((3, ["py"]), (7, ["px"])))
    return a.exceptAll(b).agg(F.count(F.lit(1)).alias("different"))


QUERIES = {
    "warp_affine_half": warp_affine_half,
    "warp_identity": warp_identity,
    "warp_magnify2x": warp_magnify2x,
    "row_bands": row_bands,
    **{f"warp_{s}": _warp_curved(s) for s in ("cylinder", "sphere", "page_turn")},
    **{f"project_{s}": _project(s) for s in ("cylinder", "sphere", "page_turn")},
    "lattice_morph": lattice_morph,
    "lattice_rotate": lattice_rotate,
    "shape_registered": shape_registered,
    "jacobian_quantities": jacobian_quantities,
    "v210_geometry": v210_geometry,
    "v210_pack": v210_pack,
    "v210_unpack": v210_unpack,
    "black_frame": black_frame,
    "chroma_up": chroma_up,
    "chroma_down": chroma_down,
    "pattern_ramp": _pattern("ramp"),
    "pattern_zoneplate": _pattern("zoneplate"),
    "pattern_excursion": _pattern("excursion"),
    "bin_stats": bin_stats,
    "layered_opaque": layered_opaque,
    "layered_sum": layered_sum,
    "union_sum": union_sum,
    "coverage_grey": coverage_grey,
    "kbuffer_opaque": _kbuffer("opaque", 4),
    "kbuffer_blend": _kbuffer("blend", 4),
    "kbuffer_evict": _kbuffer("opaque", 7),
    "kbuffer_frame": kbuffer_frame,
    "capture_gate": capture_gate,
    "capture_stream_counts": capture_stream_counts,
    "consume_stream": consume_stream,
    "consumer_counts": consumer_counts,
    "ring_drop": ring_drop,
    "ring_counters": ring_counters,
    "stream_latest_repeat": stream_latest_repeat,
    "latest_frame": latest_frame,
    "settings_as_of": settings_as_of,
    "playback_results": playback_results,
    "controls_fold": controls_fold,
    "frame_round_trip": frame_round_trip,
    "frame_bytes": frame_bytes,
    "frame_file": frame_file,
    "frames_sink": frames_sink,
    "frames_files": frames_files,
    "frames_files_warp": frames_files_warp,
    "warp_animated": warp_animated,
    "consume_warp": consume_warp,
    "capture_late_stream": capture_late_stream,
    "playback_stream": playback_stream,
    "determinism": determinism,
}
