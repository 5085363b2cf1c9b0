"""Playback by runs: what is written follows the frames, not the ticks."""

import random

from rasterloom.streaming import live, ordered


def test_regular_ticks(spark, monkeypatch):
    """As ``playback`` over a table of the ticks, also of sources without frames; a million ticks take no rows of their own."""
    r = random.Random(41)
    rows = [(s, 100 * s + k // 2, r.randrange(-60, 900)) for s in (1, 2, 3) for k in range(25)] + [(None, 7, 40), (None, 8, 41), (5, 1, 80), (5, 2, 80)]
    frames = spark.createDataFrame(rows, "source_id long, frame_no long, at long").repartition(4)
    sources = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,), (None,)], "source_id long")
    ticks = sources.crossJoin(spark.range(45).selectExpr("id as tick", "id * 20 as at"))
    want = sorted(map(tuple, live.playback(frames, ticks).collect()), key=str)
    assert sorted(map(tuple, live.playback_every(frames, sources, 20, 45).collect()), key=str) == want
    sizes, write = [], live.scan.written
    monkeypatch.setattr(live.scan, "written", lambda df, name: sizes.append(df.count()) or write(df, name))
    assert live.playback_every(frames, sources, 20, 1_000_000).count() == 6_000_000 and sum(sizes) < 100


def test_streamed_runs(spark, tmp_path):
    """A source whose frames stop sends one run a micro-batch, not its ticks."""
    for rows in ([(1, n, True, 10 + n) for n in range(4)], [(None, 0, False, 4_000_000)]):
        df = spark.createDataFrame(rows, "source_id long, frame_no long, has_signal boolean, s long").selectExpr("source_id", "frame_no", "has_signal", "timestamp_seconds(s) as ts")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("source_id long, frame_no long, has_signal boolean, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    runs = ordered.playback_runs(stream, 5_000, "30 seconds", last=500_000)
    runs.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(runs.schema).parquet(f"{tmp_path}/out").filter("source_id = 1")
    assert got.count() < 10 and live.played(got).count() == 500_001
    assert live.played(got).filter("repeated").count() == 500_001 - 3 - 1  # black at 0, 1 and 2; frame 3 at its first
