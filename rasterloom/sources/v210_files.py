"""Files of packed frames as a Spark data source, ``v210``: one file a frame, rows without gaps or every ``stride`` bytes.

    register(spark)
    rows = spark.read.format("v210").option("width", 1920).option("height", 1080).load(folder)
    rows.write.format("v210").option("width", 1920).option("height", 1080).mode("overwrite").save(folder)

Rows are (frame_id, row_no, bytes).  A frame's id is the last number in its file's name; without one,
its place among the names.  Reading deals out byte ranges of about ``split`` bytes, parts of large files and
several small ones alike, so no task holds a file.  A file that is shorter than its frame is refused; what a longer
one has beyond its frame is left out.

Writing takes whole frames in row order (``write_frames`` arranges that).  Every task writes files of its own in a
temporary folder; when all have succeeded they are moved to their names, and when one fails they are removed, so
a failed or repeated task leaves nothing behind and a reader never sees part of a frame.

Paths are those of pyarrow's filesystems (local and mounted folders, HDFS, S3, GCS), which workers open themselves.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..consts import row_bytes_min, supported_width

SCHEMA = "frame_id long, row_no int, bytes binary"
SUFFIX = ".v210"
SPLIT = 16 << 20
_AT_ONCE = 4 << 20


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """(filesystem, path in it) of a URI or an absolute path."""
    path = re.sub(r"^file:/*", "/", path).rstrip("/") or "/"
    if "://" not in path:
        path = os.path.abspath(path)
    return arrow_fs.FileSystem.from_uri(path)


@dataclass
class _Shape:
    """A frame's geometry, from the options."""

    path: str
    width: int
    height: int
    stride: int

    @staticmethod
    def of(options: dict) -> _Shape:
        missing = [k for k in ("path", "width", "height") if k not in options]
        if missing:
            raise ValueError(f"the v210 source needs {', '.join(missing)}")
        width, height = int(options["width"]), int(options["height"])
        if not supported_width(width) or height <= 0:
            raise ValueError(f"no frames of {width} x {height}")
        stride = int(options.get("stride", row_bytes_min(width)))
        if stride < row_bytes_min(width):
            raise ValueError(f"rows of {row_bytes_min(width)} bytes don't fit into {stride}")
        return _Shape(options["path"], width, height, stride)

    @property
    def size(self) -> int:
        """The least bytes of a frame's file: the last row needs no gap after it."""
        return self.stride * (self.height - 1) + row_bytes_min(self.width)


@dataclass
class _Ranges(InputPartition):
    """(path, frame, first row, end row) of files."""

    parts: list[tuple[str, int, int, int]]

    def __post_init__(self):
        super().__init__(None)


class V210Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.shape = _Shape.of(options)
        self.split = int(options.get("split", SPLIT))

    def files(self) -> list[tuple[str, int]]:
        """(path, frame) of all files, by name."""
        fs, path = opened(self.shape.path)
        info = fs.get_file_info(path)
        if info.type == arrow_fs.FileType.NotFound:
            raise FileNotFoundError(self.shape.path)
        if info.type == arrow_fs.FileType.File:
            found, numbers = [info], [0]
        else:
            found = sorted((f for f in fs.get_file_info(arrow_fs.FileSelector(path)) if f.type == arrow_fs.FileType.File and f.base_name.endswith(SUFFIX)), key=lambda f: f.base_name)
            numbers = [int(n[-1]) if (n := re.findall(r"\d+", f.base_name.removesuffix(SUFFIX))) else k for k, f in enumerate(found)]
        short = [f.path for f in found if f.size < self.shape.size]
        if short:
            raise ValueError(f"{len(short)} files are shorter than {self.shape.size} bytes, as {short[0]}")
        if len(set(numbers)) < len(numbers):
            raise ValueError(f"two files of one frame in {self.shape.path}")
        return list(zip((f.path for f in found), numbers))

    def partitions(self) -> list[_Ranges]:
        s, most = self.shape, max(1, self.split // self.shape.stride)
        out, held, rows = [], [], 0
        for path, frame in self.files():
            at = 0
            while at < s.height:
                end = min(s.height, at + most - rows)
                held.append((path, frame, at, end))
                rows, at = rows + end - at, end
                if rows >= most:
                    out.append(_Ranges(held))
                    held, rows = [], 0
        if held:
            out.append(_Ranges(held))
        return out or [_Ranges([])]

    def read(self, partition: _Ranges) -> Iterator[pa.RecordBatch]:
        s = self.shape
        fs, _ = opened(s.path)
        size, most = row_bytes_min(s.width), max(1, _AT_ONCE // s.stride)
        for path, frame, first, end in partition.parts:
            with fs.open_input_file(path) as f:
                for a in range(first, end, most):
                    n = min(most, end - a)
                    data = f.read_at(s.stride * (n - 1) + size, a * s.stride)
                    if len(data) < s.stride * (n - 1) + size:
                        raise ValueError(f"{path} ends within row {a + len(data) // s.stride}")
                    raw = np.frombuffer(data, np.uint8)
                    if s.stride > size:
                        raw = np.lib.stride_tricks.as_strided(raw, (n, size), (s.stride, 1))
                    value = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, frame)), pa.array(np.arange(a, a + n, dtype=np.int32)), value], ["frame_id", "row_no", "bytes"])


@dataclass
class _Written(WriterCommitMessage):
    """(temporary path, name) of a task's files."""

    files: list[tuple[str, str]]


class V210Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.shape, self.overwrite, self.name = _Shape.of(options), overwrite, options.get("name")
        self.job = uuid.uuid4().hex

    def _temporary(self, path: str) -> str:
        return f"{path}/_temporary-{self.job}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        s = self.shape
        fs, path = opened(s.path)
        size = row_bytes_min(s.width)
        gap = bytes(s.stride - size)
        files, out, frame, row = [], None, None, 0

        def close():
            if out is not None:
                out.close()
                if row != s.height:
                    raise ValueError(f"frame {frame} has {row} of {s.height} rows")

        try:
            for b in batches:
                for f, r, data in zip(b.column("frame_id").to_pylist(), b.column("row_no").to_pylist(), b.column("bytes")):
                    if f != frame or out is None:
                        close()
                        out, frame, row = None, f, 0
                        at = f"{self._temporary(path)}/{uuid.uuid4().hex}"
                        fs.create_dir(at, recursive=True)
                        name = self.name or f"frame-{f:012d}{SUFFIX}"
                        files.append((f"{at}/{name}", name))
                        out = fs.open_output_stream(f"{at}/{name}")
                    if r != row or len(data.as_buffer()) != size:
                        raise ValueError(f"frame {f}: row {r} of {len(data.as_buffer())} bytes where row {row} of {size} should be")
                    out.write(data.as_buffer())
                    if gap:
                        out.write(gap)
                    row += 1
            close()
            out = None
        finally:
            if out is not None and not out.closed:
                out.close()
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        fs, path = opened(self.shape.path)
        files = [f for m in messages if m is not None for f in m.files]
        names = [n for _, n in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("a frame's rows were in more than one task")
        fs.create_dir(path, recursive=True)
        if self.overwrite and not self.name:
            for f in fs.get_file_info(arrow_fs.FileSelector(path)):
                if f.base_name.endswith(SUFFIX):
                    fs.delete_file(f.path)
        for at, name in files:
            fs.move(at, f"{path}/{name}")
        self._clear(fs, path)

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear(*opened(self.shape.path))

    def _clear(self, fs, path: str) -> None:
        if fs.get_file_info(self._temporary(path)).type != arrow_fs.FileType.NotFound:
            fs.delete_dir(self._temporary(path))


class V210Source(DataSource):
    @classmethod
    def name(cls) -> str:
        return "v210"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> V210Reader:
        return V210Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> V210Writer:
        return V210Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(V210Source)


def read_frames(spark: SparkSession, path: str, width: int, height: int, **options) -> DataFrame:
    """Rows (frame_id, row_no, bytes) of a folder's frames, or of one file."""
    register(spark)
    return spark.read.format("v210").options(width=width, height=height, **options).load(path)


def write_frames(rows: DataFrame, path: str, width: int, height: int, mode: str = "overwrite", **options) -> None:
    """Rows (frame_id, row_no, bytes) as files, one for each frame; a frame's rows meet in one exchange, in order."""
    register(rows.sparkSession)
    whole = rows.select("frame_id", "row_no", "bytes").repartition("frame_id").sortWithinPartitions("frame_id", "row_no")
    whole.write.format("v210").options(width=width, height=height, **options).mode(mode).save(path)
