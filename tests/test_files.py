import os

import pytest
from pyspark.errors import PySparkException

from rasterloom.consts import Supersample, WarpParams
from rasterloom.operators import lattice as L
from rasterloom.plans import pipeline
from rasterloom.sources import v210, v210_files


def packed(spark, frames, height=5):
    """Rows of 8 pixels (32 bytes) for each of ``frames``."""
    df = spark.createDataFrame([(f, r) for f in frames for r in range(height)], "frame_id long, row_no int")
    return df.selectExpr("frame_id", "row_no", "unhex(repeat(lpad(hex((frame_id * 7 + row_no) % 256), 2, '0'), 32)) as bytes")


def rows(df):
    return sorted((x["frame_id"], x["row_no"], bytes(x["bytes"])) for x in df.collect())


def test_folder_round_trip(spark, tmp_path):
    df = packed(spark, [3, 4, 90, 12345]).repartition(7)
    v210_files.write_frames(df, str(tmp_path / "a"), 8, 5)
    assert sorted(os.listdir(tmp_path / "a")) == [f"frame-{f:012d}.v210" for f in (3, 4, 90, 12345)]
    assert all(os.path.getsize(tmp_path / "a" / f) == 5 * 32 for f in os.listdir(tmp_path / "a"))
    for split in (32, 64, 1000, 1 << 20):  # parts of files, and several in a partition
        got = v210_files.read_frames(spark, f"file://{tmp_path}/a", 8, 5, split=split)
        assert rows(got) == rows(df)
    reader = v210_files.V210Reader({"path": str(tmp_path / "a"), "width": "8", "height": "5", "split": "96"})
    parts = reader.partitions()
    assert [sum(e - a for _, _, a, e in p.parts) for p in parts] == [3] * 6 + [2]
    v210_files.write_frames(packed(spark, [7]), str(tmp_path / "a"), 8, 5, mode="append")
    assert len(os.listdir(tmp_path / "a")) == 5
    v210_files.write_frames(packed(spark, [8]), str(tmp_path / "a"), 8, 5)
    assert os.listdir(tmp_path / "a") == ["frame-000000000008.v210"]


def test_strides_and_long_files(spark, tmp_path):
    df = packed(spark, [0])
    v210_files.write_frames(df, str(tmp_path / "a"), 8, 5, stride=128)
    name = tmp_path / "a" / "frame-000000000000.v210"
    assert os.path.getsize(name) == 5 * 128
    assert rows(v210_files.read_frames(spark, str(tmp_path / "a"), 8, 5, stride=128, split=300)) == rows(df)
    name.write_bytes(name.read_bytes() + b"more than a frame")
    assert rows(v210_files.read_frames(spark, str(name), 8, 5, stride=128)) == rows(df)


def test_short_files_are_refused(spark, tmp_path):
    v210_files.write_frames(packed(spark, [0, 1]), str(tmp_path / "a"), 8, 5)
    name = tmp_path / "a" / "frame-000000000001.v210"
    name.write_bytes(name.read_bytes()[:-1])
    with pytest.raises(PySparkException, match="shorter"):
        v210_files.read_frames(spark, str(tmp_path / "a"), 8, 5).count()
    with pytest.raises(PySparkException, match="no frames of 7"):
        v210_files.read_frames(spark, str(tmp_path / "a"), 7, 5).count()
    with pytest.raises(PySparkException, match="height"):
        v210_files.register(spark)
        spark.read.format("v210").option("width", 8).load(str(tmp_path)).count()


def test_failed_writes_leave_nothing(spark, tmp_path):
    """A frame with a missing row fails the job: no file of any frame appears, and what was there stays."""
    v210_files.write_frames(packed(spark, [5]), str(tmp_path / "a"), 8, 5)
    bad = packed(spark, [1, 2, 3]).filter("not (frame_id = 2 and row_no = 3)")
    with pytest.raises(PySparkException, match="frame 2"):
        v210_files.write_frames(bad, str(tmp_path / "a"), 8, 5)
    assert os.listdir(tmp_path / "a") == ["frame-000000000005.v210"]
    writer = v210_files.V210Writer({"path": str(tmp_path / "b"), "width": "8", "height": "5"}, False)
    batch = packed(spark, [1]).orderBy("row_no").toArrow().to_batches()
    first, again = writer.write(iter(batch)), writer.write(iter(batch))  # a task that ran twice
    writer.commit([again])
    assert os.listdir(tmp_path / "b") == ["frame-000000000001.v210"] and first.files != again.files
    writer.write(iter(batch))
    writer.abort([None])
    assert os.listdir(tmp_path / "b") == ["frame-000000000001.v210"]


def test_empty_folder_and_no_frames(spark, tmp_path):
    v210_files.write_frames(packed(spark, [0]).limit(0), str(tmp_path / "a"), 8, 5)
    assert v210_files.read_frames(spark, str(tmp_path / "a"), 8, 5).count() == 0


def test_folder_through_a_lattice(spark, tmp_path):
    luma = spark.range(4 * 24 * 10).selectExpr("id div 240 as frame_id", "cast(id % 24 as int) as x", "cast(id div 24 % 10 as int) as y", "cast((4 + id * 37 % 1016) * 64 as int) as v")
    chroma = luma.filter("x % 2 = 0").selectExpr("frame_id", "cast(x div 2 as int) as cx", "y", "32768 as cb", "v as cr")
    v210_files.write_frames(v210.pack(luma, chroma, 24), str(tmp_path / "a"), 24, 10)
    pipeline.run_frame_files(spark, L.build(spark, "affine", width=24, height=10), str(tmp_path / "a"), 24, 10, WarpParams(24, 10, supersample=Supersample(most=1)), str(tmp_path / "b"))
    assert len(os.listdir(tmp_path / "b")) == 4
    got = v210.unpack(v210_files.read_frames(spark, str(tmp_path / "b"), 24, 10), 24)[0]
    assert sorted(map(tuple, got.select("frame_id", "x", "y", "v").collect())) == sorted(map(tuple, luma.collect()))
