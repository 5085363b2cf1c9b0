"""The live consumer: frames are popped, checked, warped by the lattice in force, published and counted.

Every micro-batch is one warp of all its frames.  Results and counts go to folders keyed by the batch's
number, which a batch replaces when it runs again, so each frame is published once whatever fails in between.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..consts import WarpParams
from ..plans import pipeline
from ..sources import v210
from . import live

FRAMES, COUNTS = "frames", "counts"


def warp_consumer(
    frames: DataFrame, in_force: Callable[[DataFrame], tuple[DataFrame, DataFrame]], width: int, height: int, params: WarpParams, path: str,
    mode: str = "v210", after: Callable[[DataFrame, int], None] | None = None,
):
    """A query over a stream of (frame_id, mode, width, height, bytes), to be started with a checkpoint.

    in_force: gives (lattices, choice) for the ids of a micro-batch's frames; it is asked once a micro-batch, so a setting takes effect
    between frames.  Frames of another format or geometry are counted as failed.  Under ``path``: composited pixels in ``frames``, popped, processed
    and failed in ``counts``.  after: called with what was published, such as a coverage view; it may fail and run again."""
    publish, count = live.keyed(f"{path}/{FRAMES}"), live.keyed(f"{path}/{COUNTS}")
    good = F.coalesce((F.col("mode") == mode) & (F.col("width") == width) & (F.col("height") == height), F.lit(False))

    def run(batch: DataFrame, n: int) -> None:
        taken = batch.filter(good).select("frame_id", "bytes")
        ids = taken.select("frame_id")
        lattices, choice = in_force(ids)
        pixels = pipeline.to_444(*v210.unpack(v210.image_rows(taken, width, height), width))
        publish(pipeline.run_frames(pixels, lattices, choice, width, height, params, ids), n)
        count(live.consumer_stats(batch, width, height, mode), n)
        if after is not None:
            after(batch.sparkSession.read.parquet(f"{path}/{FRAMES}/batch={n}"), n)

    return frames.writeStream.foreachBatch(run)


def published(spark: SparkSession, path: str) -> DataFrame:
    """(batch, frame_id, dx, dy, lum, cb, cr, w) of all micro-batches."""
    return spark.read.parquet(f"{path}/{FRAMES}")


def totals(spark: SparkSession, path: str) -> DataFrame:
    """One row: frames popped, processed and failed in all micro-batches."""
    return spark.read.parquet(f"{path}/{COUNTS}").agg(*(F.sum(c).alias(c) for c in ("popped", "processed", "failed")))
