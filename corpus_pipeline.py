"""The corpus pipeline: quality rules, line dedup, near-dedup, substring dedup, packing.

Every stage takes (spark, docs, sf_dir) and returns a frame; all but the last return
the columns that they got, with text and n_chars as the stage left them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm._frames import remove, written_at
from rasterloom.llm.line_dedup import line_dedup
from rasterloom.llm.packing import pack
from rasterloom.llm.quality_rules import quality_filter
from rasterloom.llm.simhash_dedup import near_dedup
from rasterloom.llm.substring_dedup import substring_dedup

ORACLE_SQL = None


def _retexted(docs: DataFrame, operator: Callable[[DataFrame], DataFrame], changed: str) -> DataFrame:
    """docs, with kept_text of ``operator`` as text in rows where its column ``changed`` is over 0.

    Columns that the operator doesn't need travel under names that can't clash with its own."""
    names = docs.columns
    aside = {c: f"__in_{k}" for k, c in enumerate(names) if c not in ("doc_id", "text")}
    out = operator(docs.withColumnsRenamed(aside))
    new = F.col(changed) > 0
    cols = {c: F.col(aside.get(c, c)) for c in names} | {"text": F.when(new, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in names:
        cols["n_chars"] = F.when(new, F.length("kept_text").cast("long")).otherwise(cols["n_chars"])
    return out.select(*(cols[c].alias(c) for c in names))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _retexted(docs, line_dedup, "n_dropped")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _retexted(docs, substring_dedup, "n_removed")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near),
    ("substring dedup", substrings),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again, so a lost executor costs one stage at most.

    A stage's table is removed once the next one's is there."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, path = written_at(docs, f"pipeline-{k}-{name.replace(' ', '-')}")
            if before is not None:
                remove(spark, before)
            before = path
    return docs
