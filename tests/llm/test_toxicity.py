import itertools
import random
import zlib

import numpy as np

from rasterloom.llm import toxicity as T

BAD = ["grumblor", "snarvik", "plotzen", "drekhammer", "skruvell"]
HIDE = {"o": "0", "e": "3", "a": "4", "i": "1", "s": "$"}


def corpus(seed, n):
    r = random.Random(seed)
    syll = ["an", "the", "ing", "er", "tion", "re", "on", "le", "ma", "po"]
    word = lambda: "".join(r.choice(syll) for _ in range(r.randint(1, 4)))
    docs, labels = [], []
    for d in range(n):
        w = [word() for _ in range(r.randint(10, 60))]
        bad = r.random() < 0.4
        for _ in range(3 if bad else 0):
            x = r.choice(BAD)
            if r.random() < 0.5:
                x = r.choice(["".join(HIDE.get(c, c) for c in x), " ".join(x), ".".join(x), x.replace(x[2], x[2] * 4)])
            w.insert(r.randint(0, len(w)), x)
        docs.append((d, " ".join(w)))
        labels.append((d, int(bad)))
    return docs, labels


def test_held_out(spark):
    docs, labels = corpus(1, 900)
    extra = [(5000, None), (5001, ""), (None, "the ing"), (7, docs[7][1])]
    df = spark.createDataFrame([(*x, "s") for x in docs + extra], "doc_id long, text string, SCORE string")
    got = T.toxicity(df, spark.createDataFrame(labels + [(5000, 0), (5001, None)], "doc_id long, toxic int")).collect()
    assert len(got) == 904
    truth = dict(labels)
    for x in got:
        held = x["doc_id"] is not None and zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1
        assert x["held_out"] == held and 0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.7)
    test = [x for x in got if x["held_out"] and x["doc_id"] in truth]
    assert np.mean([x["predicted"] == truth[x["doc_id"]] for x in test]) > 0.95
    assert {x["predicted"] for x in got if not x["text"] or x["doc_id"] is None} == {0}


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [x["predicted"] for x in T.toxicity(df, none).collect()] == [0, 0]
    assert T.toxicity(df.limit(0), none).count() == 0


def test_restore():
    docs, _ = corpus(2, 400)
    lm = T.smoothed(T.trigram_counts([t for _, t in docs] + [" ".join(BAD)] * 50).astype(float))
    for w in BAD:
        assert T.restore("".join(HIDE.get(c, c) for c in w), lm) == w
        assert T.restore(".".join(w), lm) == w
        assert T.restore(w.replace(w[2], w[2] * 5), lm) in (w, w.replace(w[2], w[2] * 2))
        assert T.tokens("x " * 2 + "word " + " ".join(w))[-1] == " ".join(w)
        assert T.meant(" ".join(w), lm) == [w] and T.meant(f"{w[:3]} {w[3]} {w[4:7]} {w[7:]}".strip(), lm) == [w]
    s = T.Scorer(lm, {"^grum": 3.0, "~tion": 2.0, "skruvell": 9.0, "olor$": 4.0}, [])
    assert all(s.word(w) == max((s.markers.get(f, 0.0) for f in T.features(w)), default=0.0) for w in [*BAD, "station", "ab", "color"])


def test_viterbi():
    """The likeliest of all paths through the lattice, by trying them all; in three scripts."""
    docs, _ = corpus(3, 200)
    lm = T.smoothed(T.trigram_counts([t for _, t in docs] + ["σκληρός κακός", "плохой злой"] * 40).astype(float))

    def weigh(text):
        a, b, s = 0, 0, 0.0
        for c in text + " ":
            k = T._code(c)
            s += float(lm[a, b, k])
            a, b = b, k
        return s

    for word in ["gr0mbl0r", "s.n.a", "th33", "1n6", "ooonnn", "g-r", "a|b", "κκκ4κ", "пл0х", "ttiinngg"]:
        paths = {}
        for path in itertools.product(*T.lattice(word)):
            meant, cost = "".join(x for x, _ in path), sum(w for _, w in path)
            paths[meant] = max(paths.get(meant, -1e9), cost + weigh(meant))
        assert paths[T.restore(word, lm)] > max(paths.values()) - 1e-3
    assert T.suspicious("ttiinngg") and not T.suspicious("book") and not T.suspicious("mississippi")
    assert T.restore("пл0хой", lm) == "плохой" and T.restore("κ.α.κ.ό.ς", lm) == "κακός"


def test_driver_gets_the_sample(spark):
    """Repeated rows of labels and documents don't multiply; a text of 200 000 words is scored whole."""
    docs, labels = corpus(5, 300)
    hot = spark.createDataFrame(docs[:2] * 3000, "doc_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").unionByName(hot)
    lab = spark.createDataFrame(labels + labels[:2] * 4000, "doc_id long, toxic int")
    ids = T.sample_ids(lab, "toxic", 40, 2)
    assert len(ids) <= 80 and len(set(ids)) == len(ids)
    assert [x[:2] for x in T.sampled_texts(df, ids, ["doc_id"], "doc_id long, toxic int")] == sorted(ids)
    long = spark.createDataFrame([(-1, docs[0][1].replace(BAD[0], "") + " the ing" * 100_000 + " " + " ".join(BAD)), (-2, "the ing " * 100_000)], "doc_id long, text string")
    got = {x["doc_id"]: x["score"] for x in T.toxicity(df.unionByName(long), lab).filter("doc_id < 0").collect()}
    assert got[-1] > 0.5 > got[-2]


def test_spaces_are_decoded():
    """Where words end in a run of short pieces is the model's decision."""
    docs, _ = corpus(2, 400)
    lm = T.smoothed(T.trigram_counts([t for _, t in docs] + [" ".join(BAD)] * 50).astype(float))
    assert T.meant(" ".join(BAD[0] + BAD[1]), lm) == BAD[:2]
    assert T.tokens("of in a the") == ["of in a the"] and T.tokens("of in the") == ["of", "in", "the"] and T.tokens("a word b") == ["a", "word", "b"]
    assert sum(len(w.split()) for w in T.tokens("a b " * 500)) == 1000  # long runs go piece by piece, none is lost


def test_long_texts_only(spark):
    """Every labelled text is longer than what is sampled of one; the marked words are all over them."""
    r = random.Random(9)
    plain = ["".join(r.choices("abcdefgh", k=5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(120):
        words = r.choices(plain, k=3000)
        if i % 3 == 0:
            for _ in range(30):
                words[r.randrange(len(words))] = r.choice(BAD[:2])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    assert min(len(t) for _, t in rows) > T.LONGEST
    got = T.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).select("doc_id", "predicted").collect()
    assert {x["doc_id"] for x in got if x["predicted"]} == {i for i in range(0, 120, 3)}
