import itertools
import random
import tracemalloc
import zlib

import numpy as np

from rasterloom.llm import language_id as L

SYLL = {"aa": ["ka", "to", "mi", "ra"], "bb": ["sch", "ung", "er", "ich"], "cc": ["ción", "los", "que", "ñe"]}


def text(r, lang, n):
    return " ".join("".join(r.choice(SYLL[lang]) for _ in range(r.randint(1, 4))) + r.choice(["", ".", ","]) for _ in range(n))


def test_forward_backward():
    """Posteriors equal sums over all label sequences, and don't depend on blocks."""
    r = np.random.default_rng(1)
    emit, moves = r.random((11, 3)) + 0.01, r.random((3, 3)) + 0.1
    at = np.array([0, 4, 4, 5, 11])
    got = L.forward_backward(emit, moves, at)
    for a, b in zip(at, at[1:]):
        want = np.zeros((b - a, 3))
        for path in itertools.product(range(3), repeat=b - a):
            w = np.prod([emit[a + i, y] for i, y in enumerate(path)]) * np.prod([moves[x, y] for x, y in zip(path, path[1:])])
            for i, y in enumerate(path):
                want[i, y] += w
        assert np.allclose(got[a:b], want / want.sum(1, keepdims=True)) if b > a else True
    emit = r.random((500, 3)) + 0.01
    long = L.forward_backward(emit, moves, np.array([0, 300, 500]))
    a = np.full(3, 1 / 3)
    fwd = []
    for i in range(300):
        a = (a @ moves if i else np.full(3, 1 / 3)) * emit[i]
        a /= a.sum()
        fwd.append(a)
    z, want = np.ones(3), np.zeros((300, 3))
    for i in range(299, -1, -1):
        want[i] = fwd[i] * z / (fwd[i] * z).sum()
        z = moves @ (emit[i] * z)
        z /= z.sum()
    assert np.allclose(long[:300], want)
    assert np.allclose(L.word_by_word(emit, moves, np.array([0, 300, 300, 500]))[1], long)


def test_held_out(spark):
    r = random.Random(1)
    rows = [(d, text(r, x := r.choice("abc") * 2, r.randint(3, 80)), x) for d in range(600)]
    rows += [(1000, None, "aa"), (1001, "12 34 !!", "aa"), (1002, "", None), (None, rows[0][1], None)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, lang string, SCORE int")
    got = L.language_id(df).collect()
    assert len(got) == 604
    for x in got:
        assert x["held_out"] == (x["doc_id"] is not None and zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2)
        assert 0 <= x["score"] <= 1
    assert [x["lang_pred"] for x in got if x["doc_id"] in (1000, 1001, 1002)] == ["und"] * 3
    test = [x for x in got if x["held_out"] and x["doc_id"] < 600]
    assert np.mean([x["lang_pred"] == x["lang"] for x in test]) > 0.97


def test_switched_text():
    r = random.Random(2)
    f = L.fit([(text(r, x, 60), x) for x in SYLL for _ in range(40)])
    mixed = text(r, "aa", 60) + " " + text(r, "bb", 200)
    p, _ = f.posteriors([mixed])
    assert (p[:60].argmax(1) == 0).mean() > 0.9 and (p[60:].argmax(1) == 1).mean() > 0.9
    assert f.predict([mixed])[0][0] == "bb" and f.predict([None])[0] == ("und", 0.0)


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "a b", None), (2, None, None)], "doc_id long, text string, lang string")
    assert [x["lang_pred"] for x in L.language_id(df).collect()] == ["und", "und"]
    assert L.language_id(df.limit(0)).count() == 0


def test_decoding():
    """Predictions equal sums over all label sequences of the field's own weights; words in other scripts are cut into units."""
    r = random.Random(5)
    f = L.fit([(text(r, x, 12), x) for x in SYLL for _ in range(6)])
    for n in (1, 3, 5):
        t = " ".join(text(r, r.choice("abc") * 2, 1) for _ in range(n)) + " 123"
        words = [u for x in t.split() for u in L.units(x)]
        assert len(words) == n
        emit = np.exp(L.Features(words, f.lexicon).scores(f.weights).astype(float))
        mass = np.zeros(3)
        for path in itertools.product(range(3), repeat=n):
            w = np.prod([emit[i, y] for i, y in enumerate(path)]) * np.exp(sum(f.moves[x, y] for x, y in zip(path, path[1:])))
            for y in path:
                mass[y] += w
        lang, score = f.predict([t])[0]
        assert f.labels[int(mass.argmax())] == lang and abs(score - mass.max() / mass.sum()) < 1e-4
    assert L.units("日本語" * 11 + "!") == [("日本語" * 11)[i : i + 16] for i in (0, 16, 32)] and L.units("12") == []
    p, at = f.posteriors(["ka " + "to" * 20 + " 1 mi", None, "ra"])
    assert at.tolist() == [0, 5, 5, 6] and len(p) == 6


def test_gradients():
    """Expected transitions equal sums over label sequences."""
    r = np.random.default_rng(3)
    emit, moves, at = r.random((9, 3)) + 0.1, r.random((3, 3)) + 0.1, np.array([0, 4, 9])
    forward, p = L.word_by_word(emit, moves, at)
    want = np.zeros((3, 3))
    for a, b in zip(at, at[1:]):
        one, total = np.zeros((3, 3)), 0.0
        for path in itertools.product(range(3), repeat=b - a):
            w = np.prod([emit[a + i, y] for i, y in enumerate(path)]) * np.prod([moves[x, y] for x, y in zip(path, path[1:])])
            total += w
            for x, y in zip(path, path[1:]):
                one[x, y] += w
        want += one / total
    assert np.allclose(L.pair_sums(forward, moves, p, np.array([1, 2, 3, 5, 6, 7, 8])), want)


def test_thirty_languages():
    r = random.Random(4)
    syll = {f"l{k:02}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(30)] for k in range(30)}
    new = lambda x, n: " ".join("".join(r.choice(syll[x]) for _ in range(r.randint(1, 3))) for _ in range(n))
    sample = [(new(x, 40), x) for x in syll for _ in range(10)]
    tracemalloc.start()
    f = L.fit(sample, epochs=2)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    assert np.mean([f.predict([new(x, 30)])[0][0] == x for x in syll for _ in range(3)]) > 0.95


def test_repeated_rows_and_long_texts(spark):
    """A third of all rows with one id and language: the driver gets the sample, not the rows; a text of 200 000 words."""
    r = random.Random(9)
    rows = [(d, text(r, x := r.choice("abc") * 2, 20), x) for d in range(300)]
    rows += [(7, text(r, "aa", 3), "aa")] * 5000 + [(7, text(r, "aa", 3) + str(i), "aa") for i in range(5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    ids = L.sample_ids(df, "lang", 50, 2)
    assert len(ids) <= 100 and len(set(ids)) == len(ids) and len({y for _, y in ids}) == 2
    got = L.sampled_texts(df, ids, ["doc_id", "lang"], "doc_id long, lang string")
    assert [(d, y) for d, y, _ in got] == sorted(ids)
    long = spark.createDataFrame([(1, text(r, "cc", 200) * 1000, None)], "doc_id long, text string, lang string")
    out = L.language_id(df.limit(0).unionByName(spark.createDataFrame(rows[:300], df.schema)).unionByName(long)).filter("lang is null").collect()
    assert [x["lang_pred"] for x in out] == ["cc"]


def test_long_texts_only(spark):
    """Every labelled text is longer than what is sampled of one: all is learned from stretches of it."""
    r = random.Random(8)
    rows = [(d, text(r, x := "aabb"[d % 2 * 2 :][:2], 1500), x) for d in range(40)]
    assert min(len(t) for _, t, _ in rows) > L.LONGEST
    got = L.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(x["lang_pred"] == x["lang"] and x["score"] > 0.9 for x in got)
