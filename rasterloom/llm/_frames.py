"""Shared helpers: row identities, shared folder, sample selection.

Operators with Python workers lower two session options, the rows and bytes of an
Arrow batch, as Spark reads them when a plan runs; they stay lowered for the
session, which changes the speed of other queries but no results.

Tables that operators write to the shared folder are removed when the driver's JVM
ends, as the frames returned read them until then.
"""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RID = "__rid"
BATCH = 1000
BATCH_BYTES = 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.  Where none is configured, one under /tmp in local mode; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file:///tmp/checkpoints/{os.getuid()}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def removed_at_end(spark: SparkSession, path: str) -> None:
    """Marks a path for removal when the driver's JVM ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The frame as a Parquet table in the shared folder (columnar, so smaller than a checkpoint), and where it is."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    removed_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    return written_at(df, name)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Removes a table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_UNITS = {"": 0, "b": 0, "k": 1, "kb": 1, "m": 2, "mb": 2, "g": 3, "gb": 3, "t": 4, "tb": 4, "p": 5, "pb": 5}


def size_of(value: str) -> int:
    """Bytes of a size as Spark writes them: a number and a unit (none: bytes)."""
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]*)", value.strip().lower()).groups()
    return int(number) << 10 * _UNITS[unit]


def mapped(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow over batches of at most ``BATCH`` rows and ``BATCH_BYTES``, so that workers and Arrow buffers stay small."""
    for name, most in (("Records", BATCH), ("Bytes", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.max{name}PerBatch"
        if not 0 < size_of(df.sparkSession.conf.get(key)) <= most:
            df.sparkSession.conf.set(key, most)
    return df.mapInArrow(function, schema)


def has_unique_ids(docs: DataFrame) -> bool:
    """Whether doc_id is never null nor repeated; one shuffle of the ids."""
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null")
    return odd.isEmpty()


def with_rid(docs: DataFrame, unique: bool | None = None) -> DataFrame:
    """docs with a long ``__rid`` that is doc_id where ids are unique.

    Otherwise rows are ranked by (doc_id with nulls last, hash of the text);
    rows equal in both share a rank, so they count as one document.
    unique: what ``has_unique_ids`` said, if asked before."""
    if has_unique_ids(docs) if unique is None else unique:
        return docs.withColumn(RID, _never_null(F.col("doc_id").cast("long")))
    key = docs.select("doc_id", F.xxhash64("text").alias("__th")).distinct()
    ranked = ranks(key, [F.col("doc_id").asc_nulls_last(), F.col("__th").asc()], RID)
    ranked = ranked.select(F.col("doc_id").alias("__d"), F.col("__th").alias("__t"), RID)
    keyed = docs.withColumn("__th", F.xxhash64("text"))
    both = keyed.join(ranked.hint("merge"), keyed["doc_id"].eqNullSafe(ranked["__d"]) & (keyed["__th"] == ranked["__t"])).drop("__d", "__t", "__th")
    return both.withColumn(RID, _never_null(F.col(RID)))


def _never_null(c: Column) -> Column:
    """Tells Spark that c has no nulls: joins then add no filters below an exchange, so it can be reused."""
    return F.coalesce(c, F.lit(0).cast("long"))


def ranks(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with its dense position (from 0) in the global order, by range partitions.

    Only one count for each partition goes to the driver.  Rows that are equal in the order are cut apart by where they
    stand in df, which is to be a table, so many equal rows go to many partitions."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [*order, F.col("__tie").asc()]
    part = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order).drop("__tie")
    part = written(part.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ranks")
    counts = sorted(map(tuple, part.groupBy("__p").agg(F.count(F.lit(1))).collect()))
    base, at = {}, 0
    for p, c in counts:
        base[p] = at
        at += c
    if not base:
        return part.withColumn(name, F.lit(0).cast("long")).drop("__p", "__i")
    offsets = F.create_map(*[F.lit(x) for kv in base.items() for x in kv]) if len(base) <= 64 else None
    if offsets is not None:
        return part.withColumn(name, (offsets[F.col("__p")] + F.col("__i")).cast("long")).drop("__p", "__i")
    table = spark.createDataFrame(list(base.items()), "__p int, __b long")  # one row for each partition
    return part.join(F.broadcast(table), "__p").withColumn(name, F.col("__b") + F.col("__i")).drop("__p", "__i", "__b")


def extras(df: DataFrame, *taken: str) -> list[str]:
    """Columns of df besides ``taken`` (names compared without case): an input column whose name clashes with an output's is replaced."""
    low = {x.lower() for x in taken}
    return [c for c in df.columns if c.lower() not in low]


def sample_ids(labelled: DataFrame, label: str, per_label: int, labels: int) -> list[tuple]:
    """(doc_id, label) of at most ``per_label`` distinct ids of each of the ``labels`` most frequent labels (of equals
    the least), least hash first: a list of at most per_label * labels pairs.

    Ids of each label are counted first (in about; rows may repeat); then only hashes below a share that leaves about twice the sample are
    compared, so no task sees more than that of a label, whatever its share of the rows."""
    keyed = labelled.select("doc_id", label).withColumn("__h", F.xxhash64("doc_id"))
    counts = keyed.groupBy(label).agg(F.approx_count_distinct("doc_id").alias("n")).orderBy(F.col("n").desc(), label).limit(labels).collect()
    if not counts:
        return []
    kind = labelled.schema[label].dataType.simpleString()
    shares = [(r[label], min(1.0, (2 * per_label + 64) / r["n"])) for r in counts]
    share = F.broadcast(labelled.sparkSession.createDataFrame(shares, f"`{label}` {kind}, __share double"))  # at most ``labels`` rows
    low = keyed.join(share, label).filter(F.col("__h") / float(1 << 63) <= 2 * F.col("__share") - 1).select("doc_id", label, "__h").distinct()
    w = Window.partitionBy(label).orderBy("__h", "doc_id")
    got = low.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= per_label)
    return [(r["doc_id"], r[label]) for r in got.limit(per_label * labels).collect()]


def sampled_texts(docs: DataFrame, ids: list[tuple], on: list[str], kinds: str) -> list[tuple]:
    """(doc_id, ..., text) for each of ``ids``, sorted: of rows that share these columns, the least text."""
    chosen = F.broadcast(docs.sparkSession.createDataFrame(ids or [(None,) * len(kinds.split(", "))], kinds))  # the sample
    names = [c.split()[0] for c in kinds.split(", ")]
    got = docs.join(chosen, on).groupBy(*names).agg(F.min("text").alias("text"))
    return sorted(tuple(r) for r in got.limit(len(ids)).collect()) if ids else []


def stretched(text: Column, key: Column, most: int, pieces: int) -> Column:
    """The text, or of a text of over ``most`` characters ``pieces`` stretches of most / pieces characters in all, joined by spaces.

    The text is cut into as many equal parts, and each gives a stretch at a place that a hash of key and part says: any place is as likely."""
    size, part = most // pieces, F.floor(F.length(text) / pieces)
    spots = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda k: (k * part + F.pmod(F.xxhash64(key, k), F.greatest(part - size, F.lit(1))) + 1).cast("int"))
    return F.when(F.length(text) > most, F.array_join(F.transform(spots, lambda at: F.substring(text, at, F.lit(size))), " ")).otherwise(text)
