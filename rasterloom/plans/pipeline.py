"""Whole-frame plans: raster to raster, packed rows to packed rows, file to file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..consts import WarpParams, supported_width
from ..operators import chroma, kbuffer, lattice, resolve, warp
from ..sources import v210, v210_files


def run_frame(pixels: DataFrame, control: DataFrame, width: int, height: int, params: WarpParams, frames: DataFrame | None = None) -> DataFrame:
    """(frame_id, dx, dy, lum, cb, cr and, without a k-buffer, the coverage w): pixels warped by the lattice ``control``.

    With a k-buffer, columns ``tag`` and ``depth`` of pixels, where there, say what goes to which slot."""
    frames = pixels.select("frame_id").distinct() if frames is None else frames
    if params.kbuffer != "off":
        frags = warp.fragments(pixels, lattice.stencils(control), width, height, params)
        return kbuffer.composite_kbuffer(frags, frames, params, kbuffer.tag_count(pixels))
    return resolve.composite(warp.cells(pixels, control, width, height, params, frames), params.background)


def run_frames(pixels: DataFrame, lattices: DataFrame, choice: DataFrame, width: int, height: int, params: WarpParams, frames: DataFrame | None = None) -> DataFrame:
    """``run_frame`` for animated lattices: one plan, whatever the number of frames and of lattices.

    lattices: (lattice_id, row, col, x, y, z); choice: (frame_id, lattice_id), the lattice in force for a frame.  A frame without one shows the background."""
    frames = pixels.select("frame_id").distinct() if frames is None else frames
    return resolve.composite(warp.cells_by_frame(pixels, lattices, choice, width, height, params, frames), params.background)


def to_444(luma: DataFrame, chroma422: DataFrame) -> DataFrame:
    """Full-rate pixels of a 4:2:2 frame."""
    up = chroma.upsample(chroma422).selectExpr("frame_id", "x as px", "y as py", "cb", "cr")
    return luma.selectExpr("frame_id", "x as px", "y as py", "v as lum").join(up, ["frame_id", "px", "py"]).select("frame_id", "px", "py", "lum", "cb", "cr")


def to_422(pixels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(luma422, chroma422) of composited pixels (frame_id, dx, dy, lum, cb, cr)."""
    luma = pixels.selectExpr("frame_id", "dx as x", "dy as y", "lum as v")
    return luma, chroma.downsample(pixels.selectExpr("frame_id", "dx as x", "dy as y", "cb", "cr"))


def run_frame_rows(rows: DataFrame, control: DataFrame, width: int, height: int, params: WarpParams) -> DataFrame:
    """Packed rows (frame_id, row_no, bytes) to packed rows of the destination."""
    if not (supported_width(width) and supported_width(params.width)):
        raise ValueError("widths must be even")
    pixels = to_444(*v210.unpack(rows, width))
    out = run_frame(pixels, control, width, height, params, rows.select("frame_id").distinct())
    return v210.pack(*to_422(out), params.width)


def run_frame_bytes(images: DataFrame, control: DataFrame, width: int, height: int, params: WarpParams, row_bytes: int | None = None, out_row_bytes: int | None = None) -> DataFrame:
    """Whole images (frame_id, bytes) with rows every ``row_bytes`` to whole images."""
    rows = run_frame_rows(v210.image_rows(images, width, height, row_bytes), control, width, height, params)
    return v210.images_of(rows, params.width, out_row_bytes)


def run_frame_file(spark: SparkSession, control: DataFrame, source: str, width: int, height: int, params: WarpParams, target: str) -> bool:
    """One packed frame file to another; False where the source can't be read or the target can't be written."""
    got = v210.read_v210_file(spark, source, width, height)
    if got is None or not supported_width(params.width):
        return False
    out = run_frame(to_444(*got), control, width, height, params, spark.range(1).select(F.col("id").alias("frame_id")))
    return v210.write_v210_file(*to_422(out), params.width, params.height, target)


def run_frame_files(spark: SparkSession, control: DataFrame, source: str, width: int, height: int, params: WarpParams, target: str) -> None:
    """All packed frames of a folder to files of the same numbers in another; nothing of them goes through the driver."""
    rows = v210_files.read_frames(spark, source, width, height)
    v210_files.write_frames(run_frame_rows(rows, control, width, height, params), target, params.width, params.height)
