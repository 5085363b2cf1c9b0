"""Frames of more rows than a lattice has."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from rasterloom.operators import lattice as L
from rasterloom.operators import tiles


@pytest.fixture(scope="module")
def tall(spark, tmp_path_factory):
    """Tables whose frame has 301 rows, the last of them not full."""
    at = str(tmp_path_factory.mktemp("tall"))
    kinds = F.expr("element_at(array('click', 'view', 'purchase'), cast(id % 3 as int) + 1)")
    spark.range(30050).select(F.col("id").alias("event_id"), F.expr("(id * id + id div 7) % 31").alias("user_id"), kinds.alias("event_type"), F.expr("(id * 37 % 5000) / 10D").alias("value")).write.parquet(f"{at}/events.parquet")
    return at


def same_as_sql(spark, at, name):
    df = __spark_entry__.queries()[name](spark, at)
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{at}/events.parquet/*.parquet'")
    rel = con.execute(f"select {', '.join(df.columns)} from ({__spark_entry__.oracle_sql()[name]})")
    got, want = sorted(map(tuple, df.collect()), key=str), sorted(rel.fetchall(), key=str)
    assert got == want, name


@pytest.mark.parametrize("name", ["frame_round_trip", "frame_bytes", "frame_file"])
def test_identity_of_a_tall_frame(spark, tall, name):
    same_as_sql(spark, tall, name)


def test_margin(spark):
    """Both forms of the spline read the margin, and without one repeat the edge."""
    for margin in (False, True):
        control = L.build(spark, "affine", margin=margin, width=100, height=1000, offset_y=3.0)
        points = tiles.padded(L.points(control)[:2])
        stencil = {(x["ci"], x["cj"]): x for x in L.stencils(control).filter("ci in (0, 5, 127) and cj in (0, 5, 127)").collect()}
        assert len(stencil) == 9
        for (ci, cj), x in stencil.items():
            for plane, c in zip(points, ("lx", "ly")):
                assert x[c] == plane[cj : cj + 4, ci : ci + 4].ravel().tolist()
        at = np.arange(1000.0)
        _, y, det = tiles._surface(points, np.zeros(1000), at, 100, 1000)
        assert (np.abs(y - 3.0 - at).max() < 1e-9) == margin and (np.abs(det - 1).max() < 1e-9) == margin


def test_bands_of_a_tall_frame(spark, tall):
    """The plan, which the driver holds, has no list of the frame's cells."""
    df = __spark_entry__.queries()["row_bands"](spark, tall)
    assert f"sequence(0, {150 * 301 - 1}" not in df._jdf.queryExecution().analyzed().toString()
    whole = __spark_entry__.queries()["warp_magnify2x"](spark, tall)
    assert df.count() == whole.count() == 150 * 301 and df.exceptAll(whole).isEmpty()
