import importlib
import importlib.abc
import sys

import pytest


class Without(importlib.abc.MetaPathFinder):
    """Refuses to import the training-data operators and their pipeline."""

    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("rasterloom.llm"):
            raise ModuleNotFoundError(name)


@pytest.fixture
def bare(monkeypatch):
    for name in [n for n in sys.modules if n in ("corpus_pipeline", "__spark_entry__") or n.startswith("rasterloom.llm")]:
        monkeypatch.delitem(sys.modules, name)
    import rasterloom

    monkeypatch.delattr(rasterloom, "llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Without(), *sys.meta_path])
    yield importlib.import_module("__spark_entry__")
    sys.modules.pop("__spark_entry__", None)


def test_without_training_data_operators(bare):
    assert "warp_affine_half" in bare.queries() and not [n for n in bare.queries() if n.startswith("op") or n == "pipeline"]
    assert set(bare.oracle_sql()) <= set(bare.queries())


def test_entry():
    import __spark_entry__

    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and all(callable(f) for f in q.values())
    assert set(q) - set(o) <= {"pipeline", *(n for n in q if n.startswith("op"))}


def test_flagship(spark):
    import os

    import __spark_entry__

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables")
    df = __spark_entry__.entry(spark)
    assert df.columns == ["dx", "dy", "lum", "cb", "cr", "w"] and df.count() == 250
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "SortMergeJoin" not in plan.split("== Initial Plan ==")[-1]


def test_queries_against_their_sql(spark):
    """Some raster queries against DuckDB on the smallest tables."""
    import os

    import duckdb

    import __spark_entry__

    at = "/root/testdata/sf0.001"
    if not os.path.isdir(at):
        pytest.skip("no tables")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{at}/events.parquet'")
    for name in ("warp_affine_half", "chroma_up", "v210_pack", "kbuffer_opaque", "stream_latest_repeat", "warp_cylinder", "row_bands", "kbuffer_evict", "kbuffer_frame", "capture_stream_counts", "controls_fold", "frame_file"):
        df = __spark_entry__.queries()[name](spark, at)
        cols = sorted(df.columns)
        rel = con.execute(__spark_entry__.oracle_sql()[name])
        place = [[x[0] for x in rel.description].index(c) for c in cols]
        want = sorted((tuple(r[i] for i in place) for r in rel.fetchall()), key=str)
        assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str) == want, name
