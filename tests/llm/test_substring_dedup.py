import random
import re

import numpy as np

from rasterloom.llm._words import mix
from rasterloom.llm.recompress import Levels
from rasterloom.llm.substring_dedup import substring_dedup

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, size):
    seen, out = set(), {}
    for d, t in sorted(rows):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            if k in seen:
                gone[i : i + size] = [True] * size
            seen.add(k)
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def texts(seed):
    r = random.Random(seed)
    vocab = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(40)]
    passage = [[r.choice(vocab) for _ in range(r.randint(18, 60))] for _ in range(6)]
    rows = []
    for d in range(120):
        w = []
        for _ in range(r.randint(0, 6)):
            k = r.random()
            if k < 0.4:
                p = r.choice(passage)
                a = r.randint(0, 5)
                w += p[a : len(p) - r.randint(0, 5)]
            elif k < 0.5:
                w += [r.choice(vocab)] * r.randint(1, 60)
            elif k < 0.6:
                w += [vocab[0], vocab[1]] * r.randint(1, 40)
            else:
                w += [r.choice(vocab) for _ in range(r.randint(0, 50))]
        rows.append((d, "".join(x + r.choice([" ", "\n", "\t ", "\x0b"]) for x in w)))
    for d in range(120, 140):
        rows.append((d, rows[d - 100][1]))
    return rows


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = texts(seed) + [(500, None), (501, ""), (502, " \n\t ")]
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup(df).collect()}
        want = brute(rows, 20)
        assert got == want
        short = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup(df, limit=150).collect()}
        assert short == want  # in stretches, as very long texts are
        assert sum(x[1] for x in want.values()) > 500


def test_colliding_names(spark):
    """First names of few bits, so that words, symbols, windows and documents share them: second names tell them apart."""
    rows = texts(5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, 20)
    for bits in (16, 6):
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup(df, bits=bits).collect()} == want


def test_keys_spell_windows_out():
    """Windows have equal names exactly if their words are equal, wherever they stand."""
    r = random.Random(7)
    for vocab, size in ((2, 6), (3, 20), (30, 20)):
        words = np.array([r.randrange(vocab) for _ in range(3000)])
        words[1000:1100] = words[200:300]
        words[2000:2080] = 1
        h, g = (mix(words.astype(np.uint64) + np.uint64(k)) for k in (1, 1 << 40))
        first = np.zeros(3000, bool)
        first[[0, 700, 1500]] = True
        window = np.array([i for i in range(3000 - size + 1) if not first[i + 1 : i + size].any()])
        a, b = Levels(h, g, first).keys(window, size)
        by_words = [tuple(words[i : i + size]) for i in window]
        assert len(set(by_words)) == len(set(a.tolist())) == len(set(zip(by_words, a.tolist(), b.tolist())))


def test_hot_document(spark):
    """A third of all rows are one row; each gets that document's result."""
    rows = texts(6)
    df = spark.createDataFrame(rows + [rows[30]] * 70 + [rows[131]] * 5, "doc_id long, text string").repartition(6)
    got = substring_dedup(df).collect()
    want = brute(rows, 20)
    assert len(got) == len(rows) + 75 and all((r["n_words"], r["n_removed"], r["kept_text"]) == want[r["doc_id"]] for r in got)


def test_odd_tables(spark):
    one = " ".join(f"a{i}" for i in range(30))
    rows = [(None, one, "x"), (3, one, "y"), (3, one, "y"), (3, one + " more", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_WORDS string")
    got = substring_dedup(df).collect()
    assert len(got) == 4
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in got if r["doc_id"] is None) == [(-1, 30)]
    firsts = [r for r in got if r["doc_id"] == 3]
    assert sum(r["n_removed"] == 0 for r in firsts) in (1, 2)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup(empty).count() == 0


def test_words_that_polynomial_hashes_confuse(spark):
    """The Thue-Morse word and its complement: equal under any polynomial hash modulo 2 ** 64."""
    a = "a"
    for _ in range(12):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    other = [f"w{k}" for k in range(19)]
    rows = [(k, " ".join([*other[:9], x[:n], *other[9:]])) for k, (x, n) in enumerate((x, n) for n in (64, 512, 1024, 4096) for x in (a, b))]
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict.fromkeys(range(8), 0)
