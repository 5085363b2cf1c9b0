"""Frames from tables: one row for each pixel (frame_id, px, py, lum, cb, cr)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..consts import CHROMA_ZERO, LUMA_BLACK

WIDTH = 100


def events_frame(spark: SparkSession, sf_dir: str, count: int | None = None, extra: dict[str, str] | None = None) -> tuple[DataFrame, int, int]:
    """(pixels, width, height) of the events table as a raster of 100 columns; event_id is dense from 0.

    What is missing of the last row is black.  count: the table's rows, if known; else they are counted, which
    reads the files' footers.  extra: more columns, as SQL over the table's."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    count = events.count() if count is None else count
    height = -(-count // WIDTH)
    cores = spark.sparkContext.defaultParallelism
    if len(events.inputFiles()) < cores:  # few files: spread them, as warps cost far more than this exchange
        events = events.repartition(cores)
    pixels = events.selectExpr(
        "cast(0 as bigint) as frame_id",
        f"cast(event_id % {WIDTH} as int) as px",
        f"cast(event_id div {WIDTH} as int) as py",
        "cast((4 + cast(floor(value * 100D) as bigint) % 1016) << 6 as int) as lum",
        "cast((4 + (user_id * 7) % 1016) << 6 as int) as cb",
        "cast((4 + (event_id * 31) % 1016) << 6 as int) as cr",
        *(f"{e} as {n}" for n, e in (extra or {}).items()),
    )
    if count % WIDTH:
        black = spark.range(count, height * WIDTH, 1, 1).selectExpr("0L as frame_id", f"cast(id % {WIDTH} as int) as px", f"cast(id div {WIDTH} as int) as py", f"{LUMA_BLACK} as lum", f"{CHROMA_ZERO} as cb", f"{CHROMA_ZERO} as cr")
        black = black.select("*", *(F.lit(0).cast(pixels.schema[n].dataType).alias(n) for n in extra or {}))
        pixels = pixels.unionByName(black)
    return pixels, WIDTH, height


def events_frames(spark: SparkSession, sf_dir: str, height: int = 20) -> tuple[DataFrame, int, int]:
    """(pixels, width, height) of the events table as a sequence of frames of 100 columns, one after another."""
    pixels, width, rows = events_frame(spark, sf_dir)
    pixels = pixels.selectExpr(f"cast(py div {height} as bigint) as frame_id", "px", f"py % {height} as py", "lum", "cb", "cr")
    if rows % height:  # the last frame's missing rows are black
        left = spark.range(rows % height * width, height * width, 1, 1)
        black = left.selectExpr(f"{rows // height}L as frame_id", f"cast(id % {width} as int) as px", f"cast(id div {width} as int) as py", f"{LUMA_BLACK} as lum", f"{CHROMA_ZERO} as cb", f"{CHROMA_ZERO} as cr")
        pixels = pixels.unionByName(black)
    return pixels, width, height


def many_frames(pixels: DataFrame, count: int) -> DataFrame:
    """The frame repeated under ids 0..count-1, each shifted in luma, for throughput runs."""
    ids = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    return pixels.drop("frame_id").withColumn("frame_id", ids).withColumn("lum", (F.col("lum") + 64 * (F.col("frame_id") % 7)).cast("int") % 65536)


def planes(pixels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(luma422, chroma422) of a full-rate frame whose chroma is taken at even columns."""
    luma = pixels.selectExpr("frame_id", "px as x", "py as y", "lum as v")
    chroma = pixels.filter("px % 2 = 0").selectExpr("frame_id", "px div 2 as cx", "py as y", "cb", "cr")
    return luma, chroma.withColumn("cx", F.col("cx").cast("int"))
