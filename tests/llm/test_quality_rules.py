import os
import random
import re
from collections import Counter

import numpy as np
import pytest

from rasterloom.llm import quality_rules as Q

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(tri)
    cov = {i + k for i, x in enumerate(tri) if c[x] > 1 for k in range(3)}
    seen, dup = set(), 0
    for x in t.split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum(t.count(s) for s in "#*$%&|<>"), dup, len(cov)


def test_statistics(spark):
    r = random.Random(2)
    rows = []
    for d in range(150):
        vocab = [f"wé{i}" for i in range(r.choice([2, 5, 30, 300]))] + ["#", "**x", "<p>"]
        rows.append((d, "".join(r.choice(vocab) + r.choice([" ", "\n", "\t", "  ", "\x0b"]) for _ in range(r.randint(0, 200)))))
    rows += [(900, None), (901, ""), (902, "\n \n"), (903, "a b"), (904, "a a a a"), (905, "x " * 20000)]
    got = {x["doc_id"]: x for x in Q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, t in rows:
        assert tuple(got[d][s] for s in Q.STATS) == brute(t), (d, t)
        n, _, _, _, rep = brute(t)
        assert got[d]["base_failed"] == (n < 50 or 100 * rep > 50 * n)
        assert not (got[d]["kept"] and got[d]["base_failed"])


def test_colliding_hashes(spark):
    """With a hash of four values for all windows, counts are still exact."""
    from pyspark.sql import functions as F

    r = random.Random(6)
    rows = [(d, " ".join(r.choice("abcd") for _ in range(r.randint(0, 60)))) for d in range(60)] + [(99, " ".join(f"w{i}" for i in range(300)))]
    weak = lambda a, b, c: F.xxhash64(a, b, c).bitwiseAND(F.expr("3L << 60"))
    words = F.filter(F.split("text", " "), lambda w: w != "")
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", Q.repeat_words(words, weak).alias("n"))
    got = dict(map(tuple, df.collect()))
    assert got == {d: brute(t)[4] for d, t in rows} and got[99] == 0


def brute_em(documents, rules):
    """The same model by numpy, over documents instead of patterns."""
    votes = np.array(documents)
    good = np.where((votes == 0).any(1), 0.05, 0.95)
    for _ in range(Q.ROUNDS):
        share = (good.sum() + 3) / (len(votes) + 4)
        odds = np.full(len(votes), np.log(share) - np.log(1 - share))
        for j in range(rules):
            g = np.array([0.1, 0.9, 3.0]) + np.bincount(votes[:, j], good, 3)
            b = np.array([1.0, 1.0, 2.0]) + np.bincount(votes[:, j], 1 - good, 3)
            pg, pb = g / g.sum(), b / b.sum()
            if pg[0] > pb[0] or pg[2] < pb[2]:
                pg = pb = (g + b) / (g + b).sum()
            odds += np.log(pg[votes[:, j]] / pb[votes[:, j]])
        good = 1 / (1 + np.exp(-odds))
    return good


def corpus(r, n):
    """Good documents and two bad kinds, each seen by two rules; a rule that is noise, one that is always for."""
    for _ in range(n):
        kind = r.choices([None, 0, 1], [88, 8, 4])[0]
        v = [0 if r.random() < (0.9 if kind == k else 0.01) else 2 if r.random() < 0.9 else 1 for k in (0, 0, 1, 1)]
        yield kind is None, [*v, 0 if r.random() < 0.1 else 2, 2]


def test_estimate():
    for n in (60, 2000):
        r = random.Random(n)
        truth, votes = zip(*corpus(r, n))
        code = [sum(x * 3 ** (5 - j) for j, x in enumerate(v)) for v in votes]
        post, share, tables = Q.fit(Counter(code), 6)
        assert np.allclose([post[c] for c in code], brute_em(votes, 6))
        assert all(g[0] <= b[0] and g[2] >= b[2] for g, b in tables)
    kept = np.array([post[c] >= 0.5 for c in code])
    assert kept[np.array(truth)].mean() >= 0.95 and (~kept[~np.array(truth)]).mean() > 0.9
    assert abs(share - 0.88) < 0.08 and abs(tables[4][0][0] - 0.1) < 0.05  # the noisy rule is known as such
    assert Q.fit({}, 4)[0] == {} and set(Q.fit({80: 5}, 4)[0]) == {80}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_labelled_documents(spark, sf):
    """Of labelled documents that pass the base, bad ones go and good ones stay; labels are used here alone."""
    at = f"/root/testdata/{sf}"
    if not os.path.isdir(at):
        pytest.skip("no tables")
    out = Q.op8_quality_rules(spark, at).filter("not base_failed").join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id")
    n = {(r["quality"], r["kept"]): r["count"] for r in out.groupBy("quality", "kept").count().collect()}
    assert n.get((1, True), 0) >= 0.95 * (n.get((1, True), 0) + n.get((1, False), 0))
    assert n.get((0, False), 0) >= 0.9 * (n.get((0, True), 0) + n.get((0, False), 0)) > 0


def test_odd_tables(spark):
    good = " ".join(f"word{i}" for i in range(90))
    rows = [(None, good, "x"), (1, good, "y"), (1, good, "y"), (2, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, KEPT string")
    assert Q.quality_rules(df).count() == 4
    kept = Q.quality_filter(df).collect()
    assert len(kept) == 3 and kept[0].asDict().keys() == {"doc_id", "text", "KEPT"} and {x["KEPT"] for x in kept} == {"x", "y"}
    assert Q.quality_rules(df.limit(0)).count() == 0 and Q.quality_filter(df.limit(0)).count() == 0


def test_columns_named_like_the_inner_ones(spark):
    df = spark.createDataFrame([(1, "some text " * 60, "a", "b")], "doc_id long, text string, __w string, __L string")
    got = Q.statistics(df).first()
    assert (got["__w"], got["__L"], got["n_words"]) == ("a", "b", 120)
