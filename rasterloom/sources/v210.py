"""Packed 10-bit 4:2:2 frames: six pixels in four little-endian 32-bit words.

Word order (three 10-bit fields each, lowest first; fixed values of the format):
    w0 = Cb0 Y0 Cr0    w1 = Y1 Cb1 Y2    w2 = Cr1 Y3 Cb2    w3 = Y4 Cr2 Y5
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..consts import CODE_BLACK, CODE_CHROMA_ZERO, CODE_MAX, CODE_MIN, CODE_SHIFT, chroma_width, groups, row_bytes_min, supported_width
from . import v210_files
from .paths import filesystem

_AT_ONCE = 1 << 20  # samples of a block
WORDS = (("b0", "y0", "r0"), ("y1", "b1", "y2"), ("r1", "y3", "b2"), ("y4", "r2", "y5"))


_NAMES = [n for w in WORDS for n in w]


def _fields(data: np.ndarray) -> np.ndarray:
    """[group, word, place] 10-bit codes of packed words; top bits are ignored."""
    return np.stack([(data >> (10 * j)) & 1023 for j in range(3)], axis=-1)


def _unpacked(width: int, chroma: bool):
    size = row_bytes_min(width)
    spots = {n: divmod(k, 3) for k, n in enumerate(_NAMES)}

    def samples(kind: str, fields: np.ndarray, n: int) -> np.ndarray:
        per = 6 if kind == "y" else 3
        codes = np.stack([fields[:, spots[f"{kind}{i}"][0], spots[f"{kind}{i}"][1]] for i in range(per)], axis=1)
        return (codes.reshape(n, -1)[:, : width if kind == "y" else chroma_width(width)].astype(np.int32) << CODE_SHIFT).ravel()

    def block(b: pa.RecordBatch) -> pa.RecordBatch:
        n = b.num_rows
        data = b"".join(x[:size].ljust(size, b"\0") for x in map(_bytes_of, b.column("bytes")))
        fields = _fields(np.frombuffer(data, "<u4").reshape(-1, 4))
        across = chroma_width(width) if chroma else width
        frame, y = (np.repeat(np.asarray(b.column(c)), across) for c in ("frame_id", "row_no"))
        x = np.tile(np.arange(across, dtype=np.int32), n)
        values = [samples(k, fields, n) for k in ("br" if chroma else "y")]
        order = [frame, x, y, *values]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in order], ["frame_id", "cx" if chroma else "x", "y", *(("cb", "cr") if chroma else ("v",))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, _AT_ONCE // width)
        for whole in batches:
            for i in range(0, whole.num_rows, step):
                yield block(whole.slice(i, step))

    return run


def _bytes_of(x: pa.BinaryScalar) -> bytes:
    return x.as_buffer().to_pybytes() if x.is_valid else b""


def unpack(rows: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(luma422, chroma422) of rows (frame_id, row_no, bytes); a short last group is cut, top bits are ignored, nothing is clamped, missing bytes are zeros."""
    rows = rows.selectExpr("cast(frame_id as bigint) as frame_id", "cast(row_no as int) as row_no", "bytes")
    luma = rows.mapInArrow(_unpacked(width, False), "frame_id long, x int, y int, v int")
    return luma, rows.mapInArrow(_unpacked(width, True), "frame_id long, cx int, y int, cb int, cr int")


def _packer(width: int):
    across, size = groups(width), row_bytes_min(width)

    def block(t: pa.Table) -> pa.RecordBatch:
        frame, y, x, kind, a, b = (np.asarray(t.column(c)).astype(np.int64) for c in ("frame_id", "y", "x", "kind", "a", "b"))
        head = np.flatnonzero(np.append(True, (frame[1:] != frame[:-1]) | (y[1:] != y[:-1])))
        of = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(frame))))
        code = [np.clip((v + 32) >> CODE_SHIFT, CODE_MIN, CODE_MAX) for v in (a, b)]
        luma = np.full((len(head), across * 6), CODE_BLACK, np.uint32)
        cb, cr = (np.full((len(head), across * 3), CODE_CHROMA_ZERO, np.uint32) for _ in range(2))
        own = kind == 0
        luma[of[own], x[own]] = code[0][own]
        own = ~own
        cb[of[own], x[own]], cr[of[own], x[own]] = code[0][own], code[1][own]
        planes = {"y": luma.reshape(-1, 6), "b": cb.reshape(-1, 3), "r": cr.reshape(-1, 3)}
        words = [sum(planes[n[0]][:, int(n[1])] << np.uint32(10 * j) for j, n in enumerate(w)) for w in WORDS]
        data = np.ascontiguousarray(np.stack(words, axis=1).astype("<u4"))
        at = (np.arange(len(head) + 1) * size).astype(np.int32)
        value = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(at), pa.py_buffer(data)])
        return pa.RecordBatch.from_arrays([pa.array(frame[head]), pa.array(y[head].astype(np.int32)), value], ["frame_id", "row_no", "bytes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # samples of whole rows and of the last, which may go on
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([pa.RecordBatch.from_arrays(x.columns, names=x.schema.names) for x in (*held, b)])
            frame, y = (np.asarray(t.column(c)) for c in ("frame_id", "y"))
            last = int(np.flatnonzero((frame != frame[-1]) | (y != y[-1]))[-1]) + 1 if (frame[0], y[0]) != (frame[-1], y[-1]) else 0
            if last:
                yield block(t.slice(0, last))
            held = t.slice(last).to_batches()
        if held:
            yield block(pa.Table.from_batches(held))

    return run


def pack(luma: DataFrame, chroma: DataFrame, width: int) -> DataFrame:
    """Rows (frame_id, row_no, bytes); codes are clamped here and only here, a short last group is padded with black.

    Luma and chroma meet in one exchange by (frame, row); a task holds some rows."""
    a = luma.selectExpr("frame_id", "y", "x", "0 as kind", "v as a", "0 as b")
    b = chroma.selectExpr("frame_id", "y", "cx as x", "1 as kind", "cb as a", "cr as b")
    samples = a.unionByName(b).repartition("frame_id", "y").sortWithinPartitions("frame_id", "y")
    return samples.mapInArrow(_packer(width), "frame_id long, row_no int, bytes binary")


def image_rows(images: DataFrame, width: int, height: int, row_bytes: int | None = None) -> DataFrame:
    """Rows of whole images (frame_id, bytes) whose rows begin every ``row_bytes``."""
    step, size = row_bytes or row_bytes_min(width), row_bytes_min(width)
    rows = images.selectExpr("frame_id", "bytes", f"explode(sequence(0, {height - 1})) as row_no")
    return rows.selectExpr("frame_id", "row_no", f"substring(bytes, row_no * {step} + 1, {size}) as bytes")


def images_of(rows: DataFrame, width: int, row_bytes: int | None = None) -> DataFrame:
    """Whole images (frame_id, bytes); rows are padded with zeros to ``row_bytes``."""
    gap = (row_bytes or row_bytes_min(width)) - row_bytes_min(width)
    return rows.groupBy("frame_id").agg(F.expr(f"unhex(array_join(transform(array_sort(collect_list(struct(row_no, hex(bytes) as h))), q -> q.h || '{'00' * gap}'), ''))").alias("bytes"))


def geometry(widths: DataFrame) -> DataFrame:
    """widths (width) with whether it is supported, the chroma's width, groups, and bytes of a row, also rounded up to 128."""
    df = widths.selectExpr("width", "width % 2 = 0 as supported", "cast(width div 2 as int) as chroma_width", "cast((width + 5) div 6 as int) as groups")
    return df.selectExpr("*", "groups * 16 as row_bytes", "cast((groups * 16 + 127) div 128 * 128 as int) as row_bytes_aligned")


def black_frame(spark: SparkSession, width: int, height: int) -> DataFrame:
    """(frame_id, row_no, bytes): one packed black row, repeated."""
    def word(a: int, b: int, c: int) -> str:
        return (a | b << 10 | c << 20).to_bytes(4, "little").hex()

    y, c = CODE_BLACK, CODE_CHROMA_ZERO
    row = (word(c, y, c) + word(y, c, y) + word(c, y, c) + word(y, c, y)) * groups(width)
    return spark.range(height).selectExpr("cast(0 as bigint) as frame_id", "cast(id as int) as row_no", f"unhex('{row}') as bytes")


def read_v210_file(spark: SparkSession, path: str, width: int, height: int) -> tuple[DataFrame, DataFrame] | None:
    """(luma422, chroma422), or None if the geometry isn't supported or the file is missing or short; a longer file is read as far as needed."""
    if not supported_width(width) or height <= 0:
        return None
    fs, where = filesystem(spark, path)
    if not fs.exists(where) or not fs.getFileStatus(where).isFile() or fs.getFileStatus(where).getLen() < row_bytes_min(width) * height:
        return None
    return unpack(v210_files.read_frames(spark, path, width, height), width)


def write_v210_file(luma: DataFrame, chroma: DataFrame, width: int, height: int, path: str) -> bool:
    """Writes one frame's rows without gaps to a file, from the task that holds them.

    False if the geometry isn't supported, the folder doesn't exist or the file can't be written."""
    if not supported_width(width) or height <= 0:
        return False
    folder, slash, name = path.rpartition("/")
    folder = folder or slash or "."
    fs, where = filesystem(spark := luma.sparkSession, path)
    if not fs.exists(filesystem(spark, folder)[1]) or fs.exists(where) and not fs.getFileStatus(where).isFile():
        return False
    try:
        v210_files.write_frames(pack(luma, chroma, width), folder, width, height, mode="append", name=name)
    except (PySparkException, Py4JJavaError) as e:
        if any(x in str(e) for x in ("OSError", "PermissionError", "FileNotFoundError", "NotADirectoryError")):
            return False
        raise
    return fs.getFileStatus(where).getLen() == row_bytes_min(width) * height


def write_frames(rows: DataFrame, path: str) -> None:
    """Packed rows of many frames as Parquet, partitioned by frame: the distributed sink."""
    rows.write.mode("overwrite").partitionBy("frame_id").parquet(path)
