"""Running values over each source's rows in order, by segments.

A plain window by source sorts all rows of a source in one task.  Here rows are cut into
segments by range partitions over (source, order), so by rank, whatever the numbers are; windows run
within (source, segment); one row for each of those carries what goes on into the next.  These rows
number at most sources plus partitions, and those of one source at most the partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.paths import written

SEGMENT = "__segment"
KEY = "__key"


def segmented(rows: DataFrame, source: str, *order: str) -> DataFrame:
    """rows with their segment, and with their source as a key that is never null; written once, as all that follows reads it again."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.withColumn(KEY, F.struct(source)).repartitionByRange(parts, source, *order)
    return written(ranged.withColumn(SEGMENT, F.spark_partition_id()), "segments")


def within(*order: str) -> Window:
    """The window of a source's rows in a segment."""
    return Window.partitionBy(KEY, SEGMENT).orderBy(*order)


def up_to_here(*order: str) -> Window:
    return within(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def segments(rows: DataFrame, **values: Column) -> DataFrame:
    """A row for each source and segment, with aggregates of it."""
    return rows.groupBy(KEY, SEGMENT).agg(*(c.alias(n) for n, c in values.items()))


def before() -> Window:
    """The segments of a source before a segment."""
    return Window.partitionBy(KEY).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)


def carried(rows: DataFrame, carry: DataFrame) -> DataFrame:
    """rows with what their segment is given."""
    return rows.join(carry, [KEY, SEGMENT])


def last_known(rows: DataFrame, value: str, *order: str) -> DataFrame:
    """rows (from ``segmented``) with ``value`` replaced by the last value up to each that isn't null."""
    at = ", ".join(order)
    each = segments(rows, __last=F.expr(f"max_by({value}, struct({at})) filter (where {value} is not null)"))
    carry = each.select(KEY, SEGMENT, F.last("__last", True).over(before()).alias("__carry"))
    local = rows.withColumn(value, F.last(value, True).over(up_to_here(*order)))
    return carried(local, carry).withColumn(value, F.coalesce(value, "__carry")).drop("__carry")


def previous(rows: DataFrame, value: str, name: str, *order: str) -> DataFrame:
    """rows (from ``segmented``) with ``name``: a struct of the value of the row before, null at a source's first row."""
    at = ", ".join(order)
    each = segments(rows, __last=F.expr(f"max_by(struct({value}), struct({at}))"))
    carry = each.select(KEY, SEGMENT, F.last("__last").over(before()).alias("__carry"))
    local = rows.withColumn(name, F.lag(F.struct(value)).over(within(*order)))
    return carried(local, carry).withColumn(name, F.coalesce(name, "__carry")).drop("__carry")


def following(rows: DataFrame, value: str, name: str, *order: str) -> DataFrame:
    """rows (from ``segmented``) with ``name``: a struct of the value of the row after, null at a source's last row."""
    at = ", ".join(order)
    each = segments(rows, __first=F.expr(f"min_by(struct({value}), struct({at}))"))
    carry = each.select(KEY, SEGMENT, F.lead("__first").over(Window.partitionBy(KEY).orderBy(SEGMENT)).alias("__carry"))
    local = rows.withColumn(name, F.lead(F.struct(value)).over(within(*order)))
    return carried(local, carry).withColumn(name, F.coalesce(name, "__carry")).drop("__carry")


def ranked(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """rows (from ``segmented``) with ``name``: how many of the source's rows come before each."""
    each = segments(rows, __size=F.count(F.lit(1)))
    carry = each.select(KEY, SEGMENT, F.coalesce(F.sum("__size").over(before()), F.lit(0).cast("long")).alias("__carry"))
    local = rows.withColumn(name, F.row_number().over(within(*order)) - 1)
    return carried(local, carry).withColumn(name, F.col(name) + F.col("__carry")).drop("__carry")
