import random

import xxhash
from pyspark.sql import functions as F

from rasterloom.llm import simhash_dedup as S


def brute_fp(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in w.encode().split()]
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    ids = {}
    for i, f in fps:
        ids.setdefault(f, []).append(i)
    left, out = list(ids), {}
    while left:
        group, todo = [], [left.pop()]
        while todo:
            x = todo.pop()
            group.append(x)
            near = [y for y in left if (x ^ y).bit_count() <= 2]
            left = [y for y in left if (x ^ y).bit_count() > 2]
            todo += near
        least = min(i for g in group for i in ids[g])
        out |= {i: least for g in group for i in ids[g]}
    return out


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_with_hot_variants(spark):
    r = random.Random(3)
    fps = set()
    for _ in range(3):  # clusters of hundreds within a few bits: variants too hot for pairs
        c = r.getrandbits(64)
        for _ in range(250):
            x = c
            for b in r.sample(range(64), r.randint(0, 4)):
                x ^= 1 << b
            fps.add(x)
    c = r.getrandbits(64)
    for i in range(10):  # a chain
        fps.add(c := c ^ (1 << (6 * i)) ^ (1 << (6 * i + 1)))
    fps |= {r.getrandbits(64) for _ in range(300)} | {0, 1 << 63, (1 << 64) - 1}
    rows = list(enumerate(sorted(fps, key=lambda _: r.random())))
    want = brute_components(rows)
    df = spark.createDataFrame([(i, signed(f)) for i, f in rows], "doc_id long, fp long")
    got = {x["doc_id"]: x["first"] for x in df.join(S.clusters(df), "fp").collect()}
    assert got == want
    assert max(list(want.values()).count(v) for v in set(want.values())) > 100


def test_query(spark):
    r = random.Random(5)
    base = " ".join(f"W{r.randint(0, 99)}" for _ in range(400))
    rows = [(i, base + f" tail{i}" if i % 3 else base) for i in range(30)] + [(40, None), (41, ""), (42, "one"), (43, "ONE"), (44, "a b"), (45, "É x y é")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("FP", F.lit("x"))
    got = {x["doc_id"]: x for x in S.simhash_clusters(df).collect()}
    fps = [(i, brute_fp(t)) for i, t in rows]
    assert {i: f"{f:016x}" for i, f in fps} == {i: x["fingerprint"] for i, x in got.items()}
    assert brute_components(fps) == {i: x["component_id"] for i, x in got.items()}
    assert got[40]["fingerprint"] == "0" * 16 and got[41]["component_id"] == 40


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d", 1), (1, "a b c d", 1), (1, "a b c d", 1), (2, None, 3)], "doc_id long, text string, fp int")
    assert S.simhash_clusters(df).count() == 4
    kept = S.near_dedup(df).collect()
    assert sorted(x["doc_id"] for x in kept) == [1, 2] and kept[0].asDict().keys() == {"doc_id", "text", "fp"}
    assert S.simhash_clusters(df.limit(0)).count() == 0


def test_nothing_that_grows_is_broadcast(spark, monkeypatch):
    """Joins of tables that grow with the documents aren't planned as broadcasts, which go through the driver, however large these may be."""
    plans, write = [], S.written

    def written(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(S, "written", written)
    rows = [(i, f"{' '.join(str((i // 2) * 100 + k) for k in range(60))} {i}") for i in range(60)] + [(100 + i, None) for i in range(3)] + [(1, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for out in (S.simhash_clusters(docs), S.near_dedup(docs)):
        assert out.count() > 20
        plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 8 and not [p for p in plans if "BroadcastHashJoin" in p]
