import hashlib
import random

import pytest

from rasterloom.llm.exact_dedup import exact_dedup

KINDS = "doc_id long, text string"


def brute(rows, largest):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = {}
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        out[t] = ((max if largest else min)(known) if known else None, len(ids), hashlib.sha256(t.encode()).hexdigest())
    return out


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("bits", [1, 2, 4])
def test_against_brute_force(spark, keep, bits):
    r = random.Random(bits)
    texts = ["hot"] * 3 + ["", None] + [f"text {k}" for k in range(40)] + ["ab" * 100_000, "ab" * 100_000 + "c"]
    rows = [(i, r.choice(texts)) for i in range(600)]
    rows += [(None, "hot"), (None, "only without id"), (None, "only without id"), (7, rows[7][1]), (7, "another text of 7")]
    got = exact_dedup(spark.createDataFrame(rows, KINDS).repartition(13), keep, bits=bits).collect()
    want = brute(rows, keep == "largest")
    assert len(got) == len(rows)
    for x in got:
        assert (x["keep_id"], x["group_size"], x["text_sha256"]) == want[x["text"] or ""]
    for t in want:  # one row of each text stays, with the id that stays
        stay = [x["doc_id"] for x in got if (x["text"] or "") == t and x["kept"]]
        assert stay == [want[t][0]]


def test_odd_tables(spark):
    empty = exact_dedup(spark.createDataFrame([], KINDS))
    assert empty.count() == 0 and empty.columns == ["doc_id", "text", "keep_id", "group_size", "kept", "text_sha256"]
    df = spark.createDataFrame([(1, "a", "x", 5), (2, "a", "y", 6)], KINDS + ", Kept string, __n int")
    got = {x["doc_id"]: x for x in exact_dedup(df).collect()}
    assert got[1]["kept"] is True and got[2]["kept"] is False and got[2]["keep_id"] == 1 and got[2]["__n"] == 6
    with pytest.raises(ValueError):
        exact_dedup(df, "newest")


def test_hot_text_is_one_entry_in_each_run(spark):
    """On the way back no task gets more of a text than its run holds."""
    df = spark.range(4000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('t', id)) as text").repartition(16)
    out = exact_dedup(df, "largest", ["doc_id"])
    assert out.filter("kept").count() == 4000 - 1334 + 1
    assert out.filter("group_size > 1").agg({"group_size": "max"}).first()[0] == 1334
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
