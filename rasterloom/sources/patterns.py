"""Test patterns as (luma422, chroma422) frames, and their command line.

    python -m rasterloom.sources.patterns <ramp|zoneplate|excursion|all> <output> [width] [height]
"""

from __future__ import annotations

import math
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..consts import CHROMA_ZERO, CODE_BLACK, CODE_MAX, CODE_MIN, CODE_WHITE, chroma_width, supported_width
from ..functions.fixed import sample_of_code

EXCURSION = (4, 20, 64, 940, 1000, 1019)
CYCLES = 8.0
NAMES = ("ramp", "zoneplate", "excursion")


def _grid(spark: SparkSession, width: int, height: int, x: str) -> DataFrame:
    return spark.range(width * height).selectExpr("cast(0 as bigint) as frame_id", f"cast(id % {width} as int) as {x}", f"cast(id div {width} as int) as y")


def _ramp(x: str, span: int) -> str:
    if span <= 1:
        return f"{CODE_MIN}"
    return f"({CODE_MIN} + ({x} * {CODE_MAX - CODE_MIN} + {(span - 1) // 2}) div {span - 1})"


def ramp(spark: SparkSession, width: int, height: int) -> tuple[DataFrame, DataFrame]:
    cw = chroma_width(width)
    luma = _grid(spark, width, height, "x").withColumn("v", F.expr(sample_of_code(_ramp("x", width))))
    c = F.expr(sample_of_code(_ramp("cx", cw)))
    return luma, _grid(spark, cw, height, "cx").withColumn("cb", c).withColumn("cr", c)


def zone_plate(spark: SparkSession, width: int, height: int) -> tuple[DataFrame, DataFrame]:
    cx, cy = (width - 1) / 2.0, (height - 1) / 2.0
    most = cx * cx + cy * cy
    k = CYCLES * math.pi / most if most > 0 else 0.0
    centre, amplitude = (CODE_WHITE + CODE_BLACK) / 2.0, (CODE_WHITE - CODE_BLACK) / 2.0
    r2 = f"((x - {cx!r}D) * (x - {cx!r}D) + (y - {cy!r}D) * (y - {cy!r}D))"
    v = f"least(greatest({centre!r}D + {amplitude!r}D * cos({k!r}D * {r2}), {float(CODE_BLACK)}D), {float(CODE_WHITE)}D)"
    luma = _grid(spark, width, height, "x").withColumn("v", F.expr(sample_of_code(f"cast(round({v}) as int)")))
    return luma, _flat(spark, width, height)


def _flat(spark: SparkSession, width: int, height: int) -> DataFrame:
    return _grid(spark, chroma_width(width), height, "cx").withColumns({"cb": F.lit(CHROMA_ZERO), "cr": F.lit(CHROMA_ZERO)})


def excursion(spark: SparkSession, width: int, height: int) -> tuple[DataFrame, DataFrame]:
    codes = f"array({', '.join(map(str, EXCURSION))})"
    luma = _grid(spark, width, height, "x").withColumn("v", F.expr(sample_of_code(f"element_at({codes}, x % 6 + 1)")))
    c = F.expr(sample_of_code(f"element_at({codes}, cx % 6 + 1)"))
    return luma, _grid(spark, chroma_width(width), height, "cx").withColumn("cb", c).withColumn("cr", c)


def pattern(spark: SparkSession, name: str, width: int, height: int) -> tuple[DataFrame, DataFrame]:
    return {"ramp": ramp, "zoneplate": zone_plate, "excursion": excursion}[name](spark, width, height)


def main(args: list[str]) -> int:
    if not 2 <= len(args) <= 4 or args[0] not in (*NAMES, "all"):
        print(__doc__, file=sys.stderr)
        return 2
    try:
        width, height = (int(x) for x in [*args[2:], *("720", "576")[len(args) - 2 :]])
    except ValueError:
        return 2
    if not supported_width(width) or height <= 0:
        return 2
    from .v210 import write_v210_file

    spark = SparkSession.builder.getOrCreate()
    for name in NAMES if args[0] == "all" else (args[0],):
        path = f"{args[1]}/{name}.v210" if args[0] == "all" else args[1]
        if not write_v210_file(*pattern(spark, name, width, height), width, height, path):
            return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
