import os
import random

import pytest
from pyspark.errors import StreamingQueryException

from rasterloom.streaming import live


def brute_ring(kinds, capacity):
    """(ok, depth) after each event."""
    depth, out = 0, []
    for k in kinds:
        ok = depth < capacity if k == "push" else depth > 0
        depth += ok if k == "push" else -ok
        out.append((ok, depth))
    return out


def test_admitted_like_a_ring(spark):
    r = random.Random(3)
    for capacity, block in ((1, 4), (3, 5), (8, 256)):
        rows = [(s, i * 3 - 700 + s, r.choice(["push", "push", "pop"] if s % 2 else ["push", "pop"])) for s in (1, 2, 3) for i in range(400)] + [(None, i, "push") for i in range(5)]
        events = spark.createDataFrame(rows, "source_id long, seq long, kind string").repartition(5)
        got = live.admitted(events, capacity, block=block)
        for s in (1, 2, 3, None):
            own = sorted((q, k) for x, q, k in rows if x == s)
            mine = got.filter(got["source_id"].eqNullSafe(s)).orderBy("seq").collect()
            assert [(x["ok"], x["depth"]) for x in mine] == brute_ring([k for _, k in own], capacity)
        counts = {x["source_id"]: x for x in live.ring_counters(got).collect()}
        for s in (1, 2, 3, None):
            kinds = [k for _, k in sorted((q, k) for x, q, k in rows if x == s)]
            ok = [o for o, _ in brute_ring(kinds, capacity)]
            want = (kinds.count("push"), sum(k == "push" and not o for k, o in zip(kinds, ok)), kinds.count("pop"), sum(k == "pop" and not o for k, o in zip(kinds, ok)))
            assert tuple(counts[s])[1:] == want


SIGNAL = [True, True, False, True, True, True, False, False, True]


def test_capture(spark):
    rows = [(s, i, x) for s in (1, 2) for i, x in enumerate(SIGNAL)]
    got = live.captured(spark.createDataFrame(rows, "source_id long, frame_no long, has_signal boolean")).orderBy("source_id", "frame_no").collect()
    assert [x["frame_no"] for x in got if x["source_id"] == 1] == [1, 4, 5] and len(got) == 6


def test_capture_stream(spark, tmp_path):
    """The same over micro-batches, cut anywhere."""
    at = str(tmp_path / "in")
    for k in range(3):
        df = spark.createDataFrame([(s, i, SIGNAL[i]) for s in (1, 2) for i in range(3 * k, 3 * k + 3)], "source_id long, frame_no long, has_signal boolean")
        df.coalesce(1).write.mode("append").parquet(at)
        os.sync()
    stream = spark.readStream.schema("source_id long, frame_no long, has_signal boolean").option("maxFilesPerTrigger", 1).parquet(at)
    q = live.captured_stream(stream).writeStream.format("memory").queryName("captured_frames").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.table("captured_frames").collect()
    assert sorted((x["source_id"], x["frame_no"]) for x in got) == [(s, n) for s in (1, 2) for n in (1, 4, 5)]


def test_shuffled_stream(spark, tmp_path):
    """Frames out of order in a micro-batch of several Arrow chunks: as the batch form; out of order between micro-batches: an error."""
    r = random.Random(1)
    rows = [(s, i, r.random() < 0.7) for s in (1, 2) for i in range(3000)]
    schema = "source_id long, frame_no long, has_signal boolean"
    want = sorted((x["source_id"], x["frame_no"]) for x in live.captured(spark.createDataFrame(rows, schema)).collect())
    r.shuffle(rows)
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))

    def run(name, **options):
        stream = spark.readStream.schema(schema).options(**options).parquet(str(tmp_path / "in"))
        q = live.captured_stream(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, 1000)
    try:
        run("shuffled")
        assert sorted((x["source_id"], x["frame_no"]) for x in spark.table("shuffled").collect()) == want
        spark.createDataFrame([(1, 5, True)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        with pytest.raises(StreamingQueryException):
            run("late", maxFilesPerTrigger=1, latestFirst="false")
    finally:
        spark.conf.set(key, old)


def test_consume(spark, tmp_path):
    at = str(tmp_path / "in")
    spark.range(5).selectExpr("id as frame_no").write.parquet(at)
    seen, covered = [], []
    stream = spark.readStream.schema("frame_no long").parquet(at)
    q = live.consume(stream, lambda df: df.selectExpr("frame_no * 2 as f"), lambda df, n: seen.extend(x["f"] for x in df.collect()), lambda df, n: covered.append(df.count())).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(seen) == [0, 2, 4, 6, 8] and sum(covered) == 5


def test_playback_and_settings(spark):
    frames = spark.createDataFrame([(1, 10, 5), (1, 11, 12), (1, 12, 13)], "source_id long, frame_no long, at long")
    ticks = spark.createDataFrame([(1, t, 4 * t) for t in range(6)], "source_id long, tick long, at long")
    got = live.playback(frames, ticks).orderBy("tick").collect()
    assert [(x["frame_no"], x["repeated"]) for x in got] == [(None, False), (None, False), (10, False), (11, False), (12, False), (12, True)]
    settings = spark.createDataFrame([(1, 5, 7), (1, 13, 8)], "source_id long, at long, value long")
    assert [x["value"] for x in live.as_of(frames, settings).orderBy("frame_no").collect()] == [7, 7, 8]
    assert live.latest(frames).first()["frame"]["frame_no"] == 12
    assert (live.preroll(25.0), live.preroll(50.0)) == (13, 25)


def test_stats_and_controls(spark):
    f = spark.createDataFrame([("v210", 8, 2), ("v210", 6, 2), ("rgb", 8, 2), (None, 8, 2)], "mode string, width int, height int")
    assert tuple(live.consumer_stats(f, 8, 2).first()) == (4, 1, 3)
    c = spark.createDataFrame([("completed",), ("completed",), ("late",), ("flushed",)], "result string")
    assert tuple(live.results(c).first()) == (2, 1, 0, 1)
    keys = ["left", "X", "z", "z", "Z", "up", "q"]
    k = spark.createDataFrame([(1, i, x) for i, x in enumerate(keys)], "source_id long, seq long, key string")
    got = live.controls(k, radius=35.0).orderBy("seq").collect()
    assert [x["radius"] for x in got] == [35.0, 35.0, 25.0, 20.0, 30.0, 30.0, 30.0]
    more = spark.createDataFrame([(1, i, x) for i, x in enumerate([*keys, "left", "Z"])], "source_id long, seq long, key string")
    assert live.controls(more, radius=35.0).count() == len(keys)  # what comes after q has no effect
    assert got[-1]["yaw"] == -0.05 and got[-1]["cx"] == 10.0 and got[-1]["pitch"] == -0.05
