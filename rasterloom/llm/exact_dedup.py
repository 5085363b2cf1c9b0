"""Operator 13: exact dedup by a tree-merge of sorted digest runs.

Every input partition makes a run: the digests of its texts in order, each once, with the
identifier that stays and the number of its rows.  Runs are dealt to 2 ** k places, which
exchange in binomial rounds: in each round the places whose numbers differ in the next
``BITS`` bits only swap the parts of their runs, so that these bits of a place become
those of its digests.  What a place gets is merged in digest order (Spark's sort merges,
a fold over Arrow batches joins equal neighbours), keeping one identifier for each text.
After the last round each place has one share of all digests, merged over all runs.

Texts are equal when their SHA-256, their length in bytes and a second 64-bit hash are;
all three are compared at every level, so what is kept has been verified each time.
A text that a third of all rows have is one entry in each run from the first level on;
results go back to rows by way of the runs, so no task gets such a text's rows.

Defined cases: null texts count as empty.  Rows without a doc_id stay only if all rows of their
text have none.  Of rows that share text and doc_id one stays.  Empty tables give no rows.
Very long texts: only digests leave the scan.  Columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._frames import documents, extras, mapped, written

BITS = 4
_KEY = ["__sha", "__size", "__second"]
_RUN = "__at long, __sha binary, __size long, __second long, __id long, __row long, __n long"
OUTPUTS = ("keep_id", "group_size", "kept", "text_sha256")


def _changes(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """For each row but the first, whether one of the columns differs from the row before."""
    out = np.zeros(max(0, batch.num_rows - 1), bool)
    for name in names:
        column = batch.column(name)
        if pa.types.is_binary(column.type):  # digests: all of one length
            offset = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
            size = np.frombuffer(column.buffers()[1], np.int32)[column.offset + 1] - offset
            x = np.frombuffer(column.buffers()[2], np.uint8)[offset : offset + size * batch.num_rows].reshape(batch.num_rows, size)
            out |= (x[1:] != x[:-1]).any(axis=1)
        else:
            x = np.asarray(column)
            out |= x[1:] != x[:-1]
    return out


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins equal neighbours of sorted runs: the first row's identifier, the sum of all counts.  Holds one open entry between batches."""
    names = ["__at", *_KEY]
    open_ = None
    for b in batches:
        if not b.num_rows:
            continue
        b = pa.RecordBatch.from_arrays(b.columns, names=b.schema.names)  # whether nulls may occur is left out
        if open_ is not None:
            b = pa.Table.from_batches([open_, b]).combine_chunks().to_batches()[0]
        heads = np.flatnonzero(np.append(True, _changes(b, names)))
        counts = np.add.reduceat(np.asarray(b.column("__n")), heads)
        got = b.take(pa.array(heads))
        got = got.set_column(got.schema.get_field_index("__n"), "__n", pa.array(counts))
        open_ = got.slice(got.num_rows - 1)
        yield got.slice(0, got.num_rows - 1)
    if open_ is not None:
        yield open_


def _merged(entries: DataFrame, largest: bool) -> DataFrame:
    """Entries of each partition merged: sorted by place and text with the identifier that stays first, then folded."""
    first = F.col("__id").desc_nulls_last() if largest else F.col("__id").asc_nulls_last()
    order = ["__at", *_KEY]
    return mapped(entries.sortWithinPartitions(*order, first, "__row"), _fold, _RUN)


def _bits(low: int, n: int) -> Column:
    """Bits of the digest, in place: those of a place's number that a round sets."""
    head = F.conv(F.hex(F.substring("__sha", 1, 4)), 16, 10).cast("long")
    return head.bitwiseAND(((1 << n) - 1) << low)


def merge_runs(runs: DataFrame, largest: bool, places: int, bits: int = BITS) -> DataFrame:
    """The runs' entries merged over all runs; ``places``: a power of two."""
    total = places.bit_length() - 1
    low = 0
    while low < total:
        n = min(bits, total - low)
        mask = ((1 << n) - 1) << low
        moved = runs.withColumn("__at", F.col("__at").bitwiseAND((places - 1) & ~mask).bitwiseOR(_bits(low, n)))
        runs = _merged(moved.repartitionById(places, F.col("__at").cast("int")), largest)
        low += n
    return runs if total else _merged(runs.repartition(1), largest)


def exact_dedup(docs: DataFrame, keep: str = "smallest", columns: list[str] | None = None, bits: int = BITS) -> DataFrame:
    """``columns`` of docs (default: all) for every row, with keep_id, group_size (long), kept (boolean) and text_sha256.

    keep: whether the "smallest" or the "largest" doc_id of equal texts stays.  Columns that are returned are written to the shared folder once."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be smallest or largest")
    spark, largest = docs.sparkSession, keep == "largest"
    names = [c for c in extras(docs, *OUTPUTS) if columns is None or c in columns]
    aside = {c: f"__in_{k}" for k, c in enumerate(names)}
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        *(F.col(c).alias(a) for c, a in aside.items()), F.col("doc_id").cast("long").alias("__id"), F.unhex(F.sha2(text, 256)).alias("__sha"),
        F.octet_length(text).cast("long").alias("__size"), F.xxhash64(text).alias("__second"), F.spark_partition_id().alias("__run"), F.monotonically_increasing_id().alias("__row"),
    )
    rows = written(rows, "digests")
    places = 1 << (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()
    runs = _merged(rows.select(F.col("__run").cast("long").alias("__at"), *_KEY, "__id", "__row", F.lit(1).cast("long").alias("__n")), largest)
    runs = written(runs, "runs")  # read by the rounds and on the way back
    merged = merge_runs(runs, largest, places, bits).filter("__n > 1").select(*_KEY, F.col("__id").alias("__keep"), F.col("__row").alias("__stays"), F.col("__n").alias("__all"))
    back = runs.select(F.col("__at").cast("int").alias("__run"), *_KEY).join(merged, _KEY)
    out = rows.join(back, ["__run", *_KEY], "left")
    single = F.col("__all").isNull()
    return out.select(
        *(F.col(a).alias(c) for c, a in aside.items()),
        F.when(single, F.col("__id")).otherwise(F.col("__keep")).alias("keep_id"),
        F.coalesce("__all", F.lit(1).cast("long")).alias("group_size"),
        (single | (F.col("__row") == F.col("__stays"))).alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"),
    )


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir).select("doc_id", "text"), "largest", ["doc_id"])


SQL = """
with texts as (select doc_id, coalesce(text, '') as t from documents),
     groups as (select t, max(doc_id) as keep_id, count(*) as n from texts group by t)
select doc_id, keep_id, n::bigint as group_size, doc_id = keep_id as kept, sha256(t) as text_sha256
from texts join groups using (t)
"""
