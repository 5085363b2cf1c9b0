import random

import pytest

from rasterloom import consts
from rasterloom.operators import chroma
from rasterloom.sources import patterns, v210

# Fixed value of the format: one packed group.
KNOWN = bytes.fromhex("01 09 34 10 04 15 64 10 07 21 94 10 0A 2D C4 10")


def rows(spark, data: list[bytes]):
    return spark.createDataFrame([(0, i, bytearray(b)) for i, b in enumerate(data)], "frame_id long, row_no int, bytes binary")


def test_geometry():
    assert [consts.row_bytes_min(w) for w in (720, 1920, 8, 2)] == [1920, 5120, 32, 16]
    assert [consts.row_bytes_aligned(w) for w in (720, 1920, 8, 2)] == [1920, 5120, 128, 128]
    assert [consts.supported_width(w) for w in (720, 721, 0, -6)] == [True, False, False, False]


def test_known_group(spark):
    luma, c = v210.unpack(rows(spark, [KNOWN]), 6)
    assert [x["v"] >> 6 for x in luma.orderBy("x").collect()] == [0x102, 0x104, 0x106, 0x108, 0x10A, 0x10C]
    assert [(x["cb"] >> 6, x["cr"] >> 6) for x in c.orderBy("cx").collect()] == [(0x101, 0x103), (0x105, 0x107), (0x109, 0x10B)]
    assert bytes(v210.pack(luma, c, 6).first()["bytes"]) == KNOWN


@pytest.mark.parametrize("width", [2, 4, 8, 14])
def test_round_trip(spark, width):
    r = random.Random(width)
    luma = [(0, x, y, r.randrange(65536)) for y in range(3) for x in range(width)]
    c = [(0, x, y, r.randrange(65536), r.randrange(65536)) for y in range(3) for x in range(width // 2)]
    a, b = spark.createDataFrame(luma, "frame_id long, x int, y int, v int"), spark.createDataFrame(c, "frame_id long, cx int, y int, cb int, cr int")
    packed = v210.pack(a, b, width)
    assert all(len(x["bytes"]) == consts.row_bytes_min(width) for x in packed.collect())
    code = lambda s: min(max((s + 32) >> 6, 4), 1019) << 6
    la, cb = v210.unpack(packed, width)
    assert sorted(map(tuple, la.collect())) == sorted((f, x, y, code(v)) for f, x, y, v in luma)
    assert sorted(map(tuple, cb.collect())) == sorted((f, x, y, code(p), code(q)) for f, x, y, p, q in c)


def _chroma(spark, values):
    return spark.createDataFrame([(0, i, 0, v, v) for i, v in enumerate(values)], "frame_id long, cx int, y int, cb int, cr int")


def test_upsample(spark):
    # fixed values: the filter's impulse and step responses
    got = [x["cb"] for x in chroma.upsample(_chroma(spark, [0, 0, 0, 16, 0, 0, 0, 0])).orderBy("x").collect()]
    assert got == [0, 0, 0, 65535, 0, 9, 16, 9, 0, 65535, 0, 0, 0, 0, 0, 0]
    got = [x["cr"] for x in chroma.upsample(_chroma(spark, [10000] * 4 + [42000] * 4)).orderBy("x").collect()]
    assert (got[5], got[7], got[9]) == (8000, 26000, 44000)


# fixed values: the filter's responses to an impulse at an even and at an odd column
@pytest.mark.parametrize("at, want", [(12, [0] * 6 + [256] + [0] * 5), (13, [0, 0, 0, 0, 3, 65511, 150, 150, 65511, 3, 0, 0])])
def test_downsample(spark, at, want):
    full = spark.createDataFrame([(0, i, 0, 512 * (i == at), 512 * (i == at)) for i in range(24)], "frame_id long, x int, y int, cb int, cr int")
    assert [x["cb"] for x in chroma.downsample(full).orderBy("cx").collect()] == want


def test_files(spark, tmp_path):
    luma, c = patterns.ramp(spark, 8, 2)
    path = str(tmp_path / "ramp.v210")
    assert v210.write_v210_file(luma, c, 8, 2, path)
    la, cb = v210.read_v210_file(spark, path, 8, 2)
    assert sorted(map(tuple, la.collect())) == sorted(map(tuple, luma.select("frame_id", "x", "y", "v").collect()))
    assert v210.read_v210_file(spark, path, 8, 1) is not None  # a longer file is read as far as needed
    assert v210.read_v210_file(spark, path, 8, 3) is None and v210.read_v210_file(spark, path, 7, 2) is None
    assert v210.read_v210_file(spark, str(tmp_path / "none"), 8, 2) is None
    assert not v210.write_v210_file(luma, c, 8, 2, str(tmp_path / "no" / "x"))
    codes = [x["v"] >> 6 for x in luma.filter("y = 0").orderBy("x").collect()]
    assert codes[0] == 4 and codes[-1] == 1019


def test_frames_sink(spark, tmp_path):
    rows = v210.black_frame(spark, 8, 3).selectExpr("explode(array(4L, 7L)) as frame_id", "row_no", "bytes")
    v210.write_frames(rows, str(tmp_path / "frames"))
    got = spark.read.parquet(str(tmp_path / "frames")).selectExpr("cast(frame_id as bigint) as frame_id", "row_no", "bytes")
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.collect())) and (tmp_path / "frames" / "frame_id=4").is_dir()


def test_strides_and_black(spark):
    black = v210.black_frame(spark, 8, 3)
    image = v210.images_of(black, 8, 40)
    assert len(image.first()["bytes"]) == 120
    again = v210.image_rows(image, 8, 3, 40)
    assert sorted(map(str, again.collect())) == sorted(map(str, black.select("frame_id", "row_no", "bytes").collect()))
    luma, c = v210.unpack(black, 8)
    assert {x["v"] for x in luma.collect()} == {consts.LUMA_BLACK} and {(x["cb"], x["cr"]) for x in c.collect()} == {(consts.CHROMA_ZERO,) * 2}


def test_pattern_command(tmp_path):
    assert patterns.main([]) == 2 and patterns.main(["none", "x"]) == 2 and patterns.main(["ramp", "x", "7", "2"]) == 2


def test_pattern_files(spark, tmp_path):
    assert patterns.main(["all", str(tmp_path), "14", "4"]) == 0
    for name in patterns.NAMES:
        luma, c = patterns.pattern(spark, name, 14, 4)
        la, cb = v210.read_v210_file(spark, f"{tmp_path}/{name}.v210", 14, 4)
        assert sorted(map(tuple, la.collect())) == sorted(map(tuple, luma.select("frame_id", "x", "y", "v").collect()))
        assert sorted(map(tuple, cb.collect())) == sorted(map(tuple, c.select("frame_id", "cx", "y", "cb", "cr").collect()))
