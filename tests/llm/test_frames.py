import os

import pytest

from rasterloom.llm import _frames as R
from rasterloom.llm import line_dedup, simhash_dedup
from test_line_dedup import brute
from test_simhash_dedup import brute_fp


def test_sizes(spark):
    """Arrow's size setting in any of Spark's notations; larger ones are lowered, smaller ones stay."""
    assert [R.size_of(x) for x in ("64MB", "8m", "1g", "512", "2KB", "-1", " 3 kb ")] == [64 << 20, 8 << 20, 1 << 30, 512, 2 << 10, -1, 3 << 10]
    key, old = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        for given, want in (("64MB", 8 << 20), ("1m", 1 << 20)):
            spark.conf.set(key, given)
            assert R.mapped(spark.range(5), lambda it: it, "id long").count() == 5
            assert R.size_of(spark.conf.get(key)) == want
    finally:
        spark.conf.set(key, old)


def test_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        R.shared_dir(Session())
    path = R.fresh_path(spark, "x")
    assert path.startswith(R.shared_dir(spark))
    table = R.written(spark.range(3), "here")
    assert table.count() == 3 and os.path.isdir(table.inputFiles()[0].removeprefix("file://").rpartition("/")[0])


def test_ranks(spark):
    df = spark.range(1000).repartition(7).withColumn("x", (R.F.col("id") * 37) % 1000)
    got = R.ranks(df, [R.F.col("x").desc()], "at").collect()
    assert all(r["at"] == 999 - r["x"] for r in got) and R.ranks(df.limit(0), [R.F.col("x")], "at").count() == 0


def test_very_long_texts(spark):
    """Lines and shingles of texts of half a million characters, whole."""
    long = "\n".join(f"Line {i} of many" if i % 3 else "the same" for i in range(30_000))
    rows = [(d, long if d == 0 else f"the same\nown {d}") for d in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in line_dedup.line_dedup(df).collect()}
    assert got == brute(rows, 10)
    fp = {r["doc_id"]: r["fingerprint"] for r in simhash_dedup.simhash_clusters(df).collect()}
    assert fp == {d: f"{brute_fp(t) % (1 << 64):016x}" for d, t in rows}


def test_ranks_cut_equal_rows_apart(spark):
    """A third of all rows equal in everything: no range partition gets them all, and positions are dense."""
    from pyspark.sql import functions as F

    from rasterloom.llm._frames import ranks, written

    df = written(spark.range(6000).selectExpr("if(id % 3 = 0, 7, id) as k").repartition(8), "equal")
    got = ranks(df, [F.col("k").asc()], "at").withColumn("p", F.input_file_name())
    assert sorted(x["at"] for x in got.collect()) == list(range(6000))
    sizes = sorted(x["count"] for x in got.groupBy("p").count().collect())
    assert max(sizes) < 2 * sizes[len(sizes) // 2]
