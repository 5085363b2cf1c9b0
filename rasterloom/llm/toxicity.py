"""Operator 7: toxicity scores of noisily written text.

1. Counts of character trigrams are gathered over all texts: a character language
   model over Latin, Greek and Cyrillic letters.  Letters of other scripts are one
   symbol, so words in them are scored as written.
2. Noisy channel: a written word is a lattice of the characters it may stand for
   (leet digits and signs, separators between letters, repeated letters).  Viterbi
   decoding under the language model gives the word meant.  A word without any such
   sign has one path.  A run of short pieces with a single letter among them is one
   lattice in which every space may be meant or not, so the model decides where
   words end.  Words cut into pieces of two letters or more are scored piece by piece.
3. A classifier over restored words (the word, its ends and inner n-grams) is
   fitted on the driver on at most ``SAMPLE`` labelled documents of either class (of
   one of over ``LONGEST`` characters, stretches of as many from hashed places all
   over it); the documents of each of ``FOLDS`` folds are weighed by the markers that the
   others give.  Scores are logistic in the strongest words.

Labels are taken only from documents whose crc32(doc_id as text) mod 3 is not 1;
scores depend on the text alone.

Very long texts: a worker holds one text, its words and their scores.

Defined cases: null and empty texts have no words and get the score of a text
without markers.  Rows are scored one by one, so ids may be null or repeat; of texts
that share a labelled id the least is sampled, and an id labelled both ways counts
for both.
Without labels of both classes all scores are 0.  Extra columns stay; those named
like an output are replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._frames import documents, extras, mapped, sample_ids, sampled_texts, stretched
from ._words import slices

SAMPLE = 2000
LONGEST = 12_000
PIECES = 12
FOLDS = 4
CUT = 0.7
_STORE = 500_000
_KEPT = 64  # characters of the longest word whose score is held, so the store's bytes are bounded
_OFTEN = 4
#: Lower-case letters of the language model's alphabet: Latin, Greek, Cyrillic (fixed values).
_LETTERS = (
    "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøùúûüýœ"
    "αβγδεζηθικλμνξοπρςστυφχψωάέήίόύώϊϋ"
    "абвгдежзийклмнопрстуфхцчшщъыьэюяёєі"
)
_A = 128
_OTHER = _A - 1

#: What a sign may stand for between letters (fixed values).
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
#: Greek and Cyrillic letters that look like Latin ones (fixed values); they are meant in words of these scripts.
ALIKE = {"o": "οо", "e": "εе", "a": "αа", "i": "ιи", "t": "τт", "b": "βв", "z": "ζз", "s": "σс", "l": "λл", "c": "ςс", "g": "γг"}
SEPARATORS = ".-_*~'`^,:;/\\ "

_CODE = np.full(0x480, _OTHER, np.int64)
for _i, _c in enumerate(_LETTERS):
    _CODE[ord(_c)] = _i + 1
_CODE[[0x20, *range(9, 14)]] = 0


def trigram_counts(texts: list[str]) -> np.ndarray:
    """Counts of trigrams of codes (0: white space) over texts, each within two spaces."""
    joined = "  ".join(["", *(t.lower() for t in texts), ""])
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    code = np.where(points < len(_CODE), _CODE[np.minimum(points, len(_CODE) - 1)], _OTHER)
    return np.bincount((code[:-2] * _A + code[1:-1]) * _A + code[2:], minlength=_A**3)


def _count(batches):
    total = np.zeros(_A**3, np.int64)
    for whole in batches:
        for b in slices(whole, "text"):
            total += trigram_counts([t for t in b.column("text").to_pylist() if t])
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["gram", "n"])


def language_model(docs: DataFrame) -> np.ndarray:
    """log P(c | a, b) as float32 [a, b, c], from trigrams of all texts, smoothed by bigrams and letters."""
    rows = docs.select("text").transform(mapped, _count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    got = rows.limit(_A**3).toArrow()  # there aren't more
    count = np.zeros(_A**3)
    count[np.asarray(got.column("gram"))] = np.asarray(got.column("n"))
    return smoothed(count)


def smoothed(count: np.ndarray) -> np.ndarray:
    tri = count.reshape(_A, _A, _A)
    one = tri.sum((0, 1)) + 1.0
    one /= one.sum()
    bi = tri.sum(0)
    bi = (bi + 20 * one) / (bi.sum(1, keepdims=True) + 20)
    p = (tri + 20 * bi) / (tri.sum(2, keepdims=True) + 20)
    return np.log(p).astype(np.float32)


# ---- the channel -----------------------------------------------------------

_STAY, _LEET_COST, _DROP, _REPEAT, _KEEP_SIGN, _JOIN, _SPACED = 0.0, -1.0, -1.0, -0.7, -9.0, -3.0, 2.0
PIECE = 3  # letters of a piece
RUN = 64  # pieces of a lattice


def _code(c: str) -> int:
    return int(_CODE[ord(c)]) if ord(c) < len(_CODE) else _OTHER


def suspicious(word: str) -> bool:
    """Whether a word (lower case, marks at its ends stripped) has more than one path."""
    if word.isalpha():
        return any(a == b == c for a, b, c in zip(word, word[1:], word[2:])) or _doubled(word)
    return any(c.isalpha() for c in word)


def _doubled(word: str) -> bool:
    """Whether letters are doubled throughout: three pairs or more, which are most of the word."""
    if len(word) < 6:
        return False
    pairs, i = 0, 1
    while i < len(word):
        same = word[i] == word[i - 1]
        pairs += same
        i += 1 + same
    return pairs >= 3 and 3 * pairs > len(word)


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each run of a written character: what it may stand for, and the channel's log weight."""
    runs: list[list] = []
    for c in word:
        if runs and runs[-1][0] == c:
            runs[-1][1] += 1
        else:
            runs.append([c, 1])
    latin = all(c < "\u0370" for c in word if c.isalpha())
    out = []
    letter = [c.isalpha() and n == 1 for c, n in runs]
    gap = [c == " " for c, _ in runs]
    alone = [x and (i < 1 or gap[i - 1]) and (i + 1 == len(runs) or gap[i + 1]) for i, x in enumerate(letter)]
    for i, (c, n) in enumerate(runs):
        if c == " ":  # between two single letters a space is likelier to be none
            out.append([(" ", _STAY), ("", _SPACED if alone[i - 1] and alone[i + 1] else _JOIN)])
            continue
        meant = LEET.get(c, "")
        if not latin:
            meant += "".join(ALIKE.get(x, "") for x in meant)
        if c.isalpha():
            options = [(c, _STAY)] if n == 1 else [(c, _REPEAT), (c * 2, _STAY if n == 2 else _REPEAT)]
        else:
            options = [(c * min(n, 2), _KEEP_SIGN)]
            options += [(x * k, _LEET_COST * min(n, 2)) for x in meant for k in {1, min(n, 2)}]
            if c in SEPARATORS or c not in LEET:
                options.append(("", _DROP))
        out.append(options)
    return out


def restore(word: str, lm: np.ndarray) -> str:
    """The likeliest word meant, by Viterbi over the last two letters."""
    best = {(0, 0): (0.0, "")}
    for options in [*lattice(word), [(" ", 0.0)]]:
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, text) in best.items():
            for x, weight in options:
                p, q, s = a, b, score + weight
                for c in x:
                    k = _code(c)
                    s += float(lm[p, q, k])
                    p, q = q, k
                old = after.get((p, q))
                if old is None or s > old[0]:
                    after[p, q] = (s, text + x)
        best = after
    return max(best.values())[1].strip()


_ENDS = ".,;:!?\"'()[]{}<>«»…*#%&$-_"


def tokens(text: str) -> list[str]:
    """Lower-case words; a run of short pieces with a single letter among them is one, with its spaces."""
    words = text.lower().split()
    if not any(len(w) == 1 for w in words):
        return words
    out, run = [], []
    for w in [*words, ""]:
        if 0 < len(w) <= PIECE and any(map(str.isalpha, w)):
            run.append(w)
            continue
        if len(run) > 1 and any(len(p) == 1 for p in run) and sum(map(len, run)) > PIECE:
            for i in range(0, len(run), RUN):
                out.append(" ".join(run[i : i + RUN]))
        else:
            out += run
        run = []
        if w:
            out.append(w)
    return out


def features(word: str) -> set[str]:
    n = len(word)
    got = {word}
    got |= {f"^{word[:k]}" for k in range(3, min(n, 6) + 1)}
    got |= {f"{word[-k:]}$" for k in range(4, min(n, 6) + 1)}
    got |= {f"~{word[i : i + k]}" for k in (4, 5) for i in range(n - k + 1)}
    return got


def meant(word: str, lm: np.ndarray) -> list[str]:
    """The words of over two letters that a token stands for."""
    core = word.strip(_ENDS)
    if " " in core:
        found = restore(core, lm).split()
    else:
        found = [restore(core, lm) if suspicious(core) else restore(word, lm) if suspicious(word) else core]
    return [w for w in found if len(w) > 2]


class _Scores(dict):
    """Scores of words, computed when first asked for."""

    def __init__(self, scorer: Scorer):
        self.scorer = scorer

    def __missing__(self, word: str) -> float:
        got = self.scorer.word(word)
        if len(word) <= _KEPT:
            self[word] = got
        return got


class Scorer:
    """Weights of markers and of a document's strongest words."""

    def __init__(self, lm: np.ndarray, markers: dict[str, float], weights: list[float]):
        self.lm, self.markers, self.weights = lm, markers, weights
        self.known = _Scores(self)
        self.find = None

    def __getstate__(self):
        return self.lm, self.markers, self.weights

    def __setstate__(self, state):
        self.__init__(*state)

    def _automaton(self):
        """All markers at once, over ^word$; gives what ``features`` would find."""
        import ahocorasick

        a = ahocorasick.Automaton()
        for f, x in self.markers.items():
            form = f[1:] if f[0] == "~" else f if f[0] == "^" or f[-1] == "$" else f"^{f}$"
            a.add_word(form, max(x, a.get(form, 0.0)))
        a.add_word("\0", 0.0)
        a.make_automaton()
        return a.iter

    def word(self, word: str) -> float:
        self.find = self.find or self._automaton()
        return max((x for core in meant(word, self.lm) for _, x in self.find(f"^{core}$")), default=0.0)

    def strongest(self, text: str | None) -> list[float]:
        """The strongest and the second strongest word, the mean of the three strongest, how many are strong (log), 1."""
        words = tokens(text) if text else []
        known = self.known
        if len(known) > _STORE:
            known.clear()
        found = sorted(filter(None, map(known.__getitem__, words)), reverse=True)
        top = (found[:3] + [0.0] * 3)[:3]
        return [top[0], top[1], sum(top) / 3, math.log1p(sum(x > 3 for x in found)), 1.0]

    def score(self, text: str | None) -> float:
        z = sum(a * b for a, b in zip(self.weights, self.strongest(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def find_markers(bad: Counter, good: Counter, n_bad: int, n_good: int) -> dict[str, float]:
    """Log odds of features that are found in toxic documents beyond chance."""
    out = {}
    for f, t in bad.items():
        n = good[f]
        odds = math.log((t + 0.5) / (n_bad + 1)) - math.log((n + 0.5) / (n_good + 1))
        if t >= _OFTEN and odds > 1.4 and odds / math.sqrt(1 / (t + 0.5) + 1 / (n + 0.5)) > 2.7:
            out[f] = odds
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - w)
        w += step
        if abs(step).max() < 1e-6:
            break
    return w.tolist()


def fit(lm: np.ndarray, sample: list[tuple[str, int]]) -> Scorer:
    """A scorer from (text, label) rows."""
    if len({y for _, y in sample}) < 2:
        return Scorer(lm, {}, [0.0, 0.0, 0.0, 0.0, -30.0])

    @lru_cache(maxsize=20_000)
    def of(word: str) -> frozenset:
        return frozenset().union(*map(features, meant(word, lm)))

    def found(text: str | None) -> set[str]:
        return set().union(*map(of, set(tokens(text)))) if text else set()

    count = [[Counter(), Counter()] for _ in range(FOLDS)]  # by fold and label
    size = [[0, 0] for _ in range(FOLDS)]
    often: set[str] = set()
    for label in (1, 0):  # toxic texts first: only what is frequent in them is counted in the others
        for fold in range(FOLDS):
            for t, y in sample[fold::FOLDS]:
                if y == label:
                    size[fold][label] += 1
                    count[fold][label].update(found(t) if label else found(t) & often)
        if label:
            total = sum((count[fold][1] for fold in range(FOLDS)), Counter())
            often = {f for f, n in total.items() if n >= _OFTEN}
            for fold in range(FOLDS):
                count[fold][1] = Counter({f: n for f, n in count[fold][1].items() if f in often})
    both = [sum((count[fold][y] for fold in range(FOLDS)), Counter()) for y in (0, 1)]
    n = [sum(size[fold][y] for fold in range(FOLDS)) for y in (0, 1)]
    rows = []
    for fold in range(FOLDS):  # each fold's documents are weighed by the markers of the others
        side = Scorer(lm, find_markers(both[1] - count[fold][1], both[0] - count[fold][0], n[1] - size[fold][1], n[0] - size[fold][0]), [])
        rows += [(side.strongest(t), y) for t, y in sample[fold::FOLDS]]
    weights = _logistic(np.array([x for x, _ in rows]), np.array([y for _, y in rows], float))
    return Scorer(lm, find_markers(both[1], both[0], n[1], n[0]), weights)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer:
    labelled = labels.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    ids = sample_ids(labelled, "toxic", sample, 2)
    texts = docs.select("doc_id", stretched(F.col("text"), F.col("doc_id"), LONGEST, PIECES).alias("text"))
    rows = sampled_texts(texts, ids, ["doc_id"], "doc_id long, toxic int")
    return fit(language_model(docs), [(t, y) for _, y, t in rows])


def _score(scorer, names):
    def run(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                got = [scorer.score(t) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(got, pa.float64())], [*names, "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs with held_out (boolean), score (double) and predicted (int)."""
    docs = docs.select(*extras(docs, "held_out", "score", "predicted"))
    scorer = train(docs, labels, sample)
    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    out = docs.transform(mapped, _score(scorer, docs.columns), f"{kinds}, score double")
    return out.withColumns({"held_out": held_out(F.col("doc_id")), "predicted": (F.col("score") >= CUT).cast("int")})


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = toxicity(documents(spark, sf_dir).select("doc_id", "text"), labels)
    return out.select("doc_id", "held_out", "score", "predicted")
