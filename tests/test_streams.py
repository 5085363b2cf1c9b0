"""Late frames, streaming playback and the consumer that survives a failure."""

import random

import pytest
from pyspark.errors import StreamingQueryException

from rasterloom.consts import Supersample, WarpParams
from rasterloom.operators import lattice as L
from rasterloom.plans import pipeline
from rasterloom.sources import v210
from rasterloom.sources.frames import planes
from rasterloom.streaming import consumer, live, ordered

SCHEMA = "source_id long, frame_no long, has_signal boolean, ts timestamp"


def written(spark, at, batches):
    """A stream of one file a micro-batch of rows (source, frame number, signal, second); then one that lets the watermark pass."""
    for rows in [*batches, [(None, 0, False, 10_000)]]:
        df = spark.createDataFrame(rows, "source_id long, frame_no long, has_signal boolean, s long").selectExpr("source_id", "frame_no", "has_signal", "timestamp_seconds(s) as ts")
        df.coalesce(1).write.mode("append").parquet(at)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(at)


def run(df, at):
    q = df.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{at}/out").collect(), q


def test_late_frames(spark, tmp_path):
    """Frames in shuffled order over micro-batches are placed if they come within the delay; one beyond is dropped and counted."""
    r = random.Random(31)
    rows = [(s, i, r.random() < 0.7, i + 5) for s in (1, 2, 3) for i in range(200)]
    want = {(x["source_id"], x["frame_no"]) for x in live.captured(spark.createDataFrame([x[:3] for x in rows], "source_id long, frame_no long, has_signal boolean")).collect()}
    shuffled = sorted(rows, key=lambda x: x[3] + r.random() * 40)
    batches = [shuffled[i : i + 75] for i in range(0, 600, 75)]
    got, q = run(ordered.captured_late(written(spark, f"{tmp_path}/a/in", batches), "60 seconds"), f"{tmp_path}/a")
    assert sorted((x["source_id"], x["frame_no"]) for x in got) == sorted(want) and ordered.dropped_late(q) == 0
    late = [*batches, [(1, 500, True, 20)], [(1, 501, True, 600), (1, 502, True, 601)]]
    got, q = run(ordered.captured_late(written(spark, f"{tmp_path}/b/in", late), "60 seconds"), f"{tmp_path}/b")
    more = {(1, 501)} if rows[199][2] else set()
    assert {(x["source_id"], x["frame_no"]) for x in got} == want | more | {(1, 502)} and ordered.dropped_late(q) == 1


def test_playback_goes_on_without_frames(spark, tmp_path):
    """Ticks of all sources, also of one whose frames stop and of one that begins late; black before, repeats after."""
    first = [(1, n, True, 10 + n) for n in (0, 1, 2, 3)] + [(2, n, n != 6, 10 + n) for n in range(9)]
    then = [(1, 4, True, 31), (3, 0, True, 38), (3, 1, True, 39), (2, 9, True, 19)]
    stream = written(spark, f"{tmp_path}/in", [first, then])
    got, _ = run(ordered.playback_stream(stream, 5_000, "30 seconds", last=9, preroll=2, start=5_000), tmp_path)
    frames = spark.createDataFrame([x[:3] + (x[3],) for x in first + then], "source_id long, frame_no long, has_signal boolean, at long")
    ticks = spark.createDataFrame([(s, k, 5 + 5 * k) for s in (1, 2, 3) for k in range(10)], "source_id long, tick long, at long")
    want = {(x["source_id"], x["tick"]): (x["frame_no"], x["repeated"]) for x in live.playback(live.captured(frames), ticks).collect()}
    mine = {(x["source_id"], x["tick"]): (x["frame_no"], x["repeated"]) for x in got if x["source_id"] is not None}
    assert {k: v for k, v in mine.items() if k[1] >= 0} == want and len(got) == len(mine) + 12
    assert {k: v for k, v in mine.items() if k[1] < 0} == {(s, t): (None, False) for s in (1, 2, 3) for t in (-2, -1)}
    assert any(x for _, x in want.values())


def test_consumer_publishes_once(spark, tmp_path):
    """It fails after the sink of its second micro-batch and is started again: each frame is there once, warped by the lattice in force."""
    w, h = 12, 8
    r = random.Random(33)
    px = spark.createDataFrame([(f, x, y, 64 * r.randrange(4, 1020), 32768, 32768) for f in range(6) for y in range(h) for x in range(w)], "frame_id long, px int, py int, lum int, cb int, cr int")
    images = v210.images_of(v210.pack(*planes(px), w), w)
    frames = images.selectExpr("frame_id", "if(frame_id = 4, cast(null as string), 'v210') as mode", f"if(frame_id = 1, 14, {w}) as width", f"{h} as height", "bytes")
    for k in range(3):
        frames.filter(f"frame_id div 2 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    lattices = L.build_each(spark.createDataFrame([(0, 0.0), (1, 0.5)], "lattice_id long, turned double"), "page_turn", width=11.0, height=7.0, radius=2.0, progress="turned", cx=6.0, cy=4.0)
    asked, calls = [], []

    def in_force(ids):
        asked.append(1)
        return lattices, ids.selectExpr("frame_id", "frame_id % 2 as lattice_id")

    def after(df, n):
        calls.append((n, df.count()))
        if len(calls) == 2:
            raise RuntimeError("the view failed")

    def start():
        stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = consumer.warp_consumer(stream, in_force, w, h, p, f"{tmp_path}/out", after=after)
        return query.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()

    p = WarpParams(w, h, supersample=Supersample(most=2))
    with pytest.raises(StreamingQueryException):
        start().awaitTermination()
    start().awaitTermination()
    assert calls == [(0, w * h), (1, 2 * w * h), (1, 2 * w * h), (2, w * h)] and len(asked) == 4
    got = consumer.published(spark, f"{tmp_path}/out").drop("batch")
    assert got.count() == 4 * w * h and tuple(consumer.totals(spark, f"{tmp_path}/out").first()) == (6, 4, 2)
    want = pipeline.run_frames(px.filter("frame_id in (0, 2, 3, 5)"), *in_force(px.select("frame_id").distinct()), w, h, p)
    keys = ["frame_id", "dx", "dy", "lum", "w"]
    assert sorted(map(tuple, got.select(keys).collect())) == sorted(map(tuple, want.select(keys).collect()))
