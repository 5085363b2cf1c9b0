"""Operator 5: language ID by a linear-chain conditional random field over words.

Each word has features: its prefixes, suffixes and all its trigrams of bytes, and
itself where it is in the lexicon of the sample.  The field's label weights for
features and its transition weights are learned together by gradient ascent on the
likelihood of labelled texts, with expectations by forward-backward.  A text's words
are labelled by their posterior probabilities, so a text may switch languages; its
language is the one with most posterior mass, and the score is that label's share.

Texts of a single language teach a field only to stay in one.  So beside each
sampled text it learns from as many words made of stretches of ``STRETCH`` words of
texts of different languages, whose words' labels are known: these teach switching.

Words of over ``UNIT`` letters, as in scripts without spaces, are cut into units of
so many letters, each a place in the chain.

Long texts are exact at any length: the chain is cut into blocks of ``BLOCK`` words,
whose transfer matrices give the messages at the cuts; with over ``FEW`` languages,
where such matrices cost too much, messages go from word to word.  A worker holds one
text and its words' posteriors.

The field is fitted on the driver on a bounded sample: ``SAMPLE`` texts for each of
the ``LANGUAGES`` most frequent languages (of equals the least by name), ``TEXTS`` in
all at most, whose crc32(doc_id as text) mod 4 is not 2; of a text of over ``LONGEST``
characters stretches of as many in all, from hashed places all over it.  Rarer languages than that are never predicted.  Fitting goes by batches of
about ``BATCH`` words, whose sums alone it holds.  Predictions depend on the text
alone.

Defined cases: texts that are null or have no letter are ``und`` with score 0.  Rows
are independent, so ids may be null or repeat; of texts that share an id and a
language the least is sampled.  Without labelled texts all are ``und``.  Extra
columns stay; those named like an output are replaced.
"""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._frames import documents, extras, mapped, sample_ids, sampled_texts, stretched
from ._words import slices

SAMPLE = 250
LANGUAGES = 64
TEXTS = 2_000
LONGEST = 6_000
PIECES = 4
STRETCH = (4, 30)
UNIT = 16
BLOCK = 64
FEW = 16
BATCH = 24_000
EPOCHS = 6
_HASHED = 1 << 16
_SLOTS = 8
_STORE = 600_000


def units(token: str) -> list[str]:
    """The token's letters in lower case, in pieces of ``UNIT``."""
    w = token.lower() if token.isalpha() else "".join(filter(str.isalpha, token)).lower()
    return [w] if 0 < len(w) <= UNIT else [w[i : i + UNIT] for i in range(0, len(w), UNIT)]


class Features:
    """Feature numbers of words: ``fixed`` [word, slot] (0: none), and all trigrams, ``grams`` with ``at`` (each word has one at least)."""

    def __init__(self, words: list[str], lexicon: dict[str, int]):
        raw = [f"^{w}$".encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        end = np.cumsum(size)
        start = end - size
        data = np.frombuffer(b"".join(raw) + bytes(8), np.uint8).astype(np.uint64)
        packed = {1: data}
        for k in range(2, 6):
            packed[k] = (packed[k - 1][:-1] << np.uint64(8)) | data[k - 1 :]

        def number(kind: int, k: int, at: np.ndarray) -> np.ndarray:
            x = (packed[k][at] * np.uint64(8) + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
            return (x >> np.uint64(48)).astype(np.int32) % _HASHED + 1

        self.fixed = np.zeros((len(raw), _SLOTS), np.int32)
        for slot, (kind, k) in enumerate(((1, 2), (1, 3), (1, 4), (2, 2), (2, 3), (2, 4), (2, 5))):
            there = size >= k
            self.fixed[there, slot] = number(kind, k, (start if kind == 1 else end - k)[there])
        if lexicon:
            self.fixed[:, -1] = [_HASHED + 1 + i if (i := lexicon.get(w, -1)) >= 0 else 0 for w in words]
        self.at = np.append(0, np.cumsum(size - 2))
        place = np.arange(int(self.at[-1])) + 2 * np.repeat(np.arange(len(raw)), size - 2)
        self.grams = number(3, 3, place)

    def scores(self, weights: np.ndarray, rows: slice = slice(None)) -> np.ndarray:
        """[word, label] sums of weights."""
        first, last, _ = rows.indices(len(self.fixed))
        if first >= last:
            return np.zeros((0, weights.shape[1]), weights.dtype)
        at = self.at[first : last + 1]
        out = np.add.reduceat(weights[self.grams[at[0] : at[-1]]], at[:-1] - at[0], axis=0)
        for slot in range(_SLOTS):
            out += weights[self.fixed[first:last, slot]]
        return out

    def gradient(self, by_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(features of these words, [feature, label] sums of by_word [word, label] over the words that have the feature)."""
        of = np.repeat(np.arange(len(self.fixed)), np.diff(self.at))
        numbers, place = np.unique(np.concatenate([self.fixed.ravel(), self.grams]), return_inverse=True)
        out = np.empty((len(numbers), by_word.shape[1]))
        for j, x in enumerate(by_word.T):
            out[:, j] = np.bincount(place, np.concatenate([np.repeat(x, _SLOTS), x[of]]), len(numbers))
        out[numbers == 0] = 0
        return numbers, out


def word_by_word(emit: np.ndarray, moves: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(forward messages, posteriors), both [word, label], by messages from word to word, all sequences at once."""
    n = np.diff(at)
    order = np.argsort(-n, kind="stable")
    first, n = at[:-1][order], n[order]
    live = np.searchsorted(-n, -np.arange(int(n.max(initial=0))), side="left")  # sequences with more than s words
    out = np.empty(emit.shape)
    for s, many in enumerate(live):
        here = first[:many] + s
        a = (a[:many] @ moves if s else 1.0) * emit[here]
        a /= a.sum(1, keepdims=True)
        out[here] = a
    forward = out.copy()
    z = np.ones((len(n), emit.shape[1]))
    for s in range(len(live) - 1, -1, -1):
        here = first[: live[s]] + s
        out[here] *= z[: live[s]]
        step = (emit[here] * z[: live[s]]) @ moves.T
        z[: live[s]] = step / step.sum(1, keepdims=True)
    return forward, out / out.sum(1, keepdims=True)


def forward_backward(emit: np.ndarray, moves: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Posterior [word, label]. emit: likelihoods [word, label]; moves: weights [from, to]; at: word offsets of the sequences."""
    k = emit.shape[1]
    if k > FEW:
        return word_by_word(emit, moves, at)[1]
    n = np.diff(at)
    blocks = np.maximum(1, -(-n // BLOCK))
    first = np.append(0, np.cumsum(blocks))
    total = int(first[-1])
    seq = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(emit)) - at[:-1][seq]
    b, t = first[:-1][seq] + inside // BLOCK, inside % BLOCK
    e = np.ones((total, BLOCK, k), np.float64)
    real = np.zeros((total, BLOCK), bool)
    e[b, t] = emit
    real[b, t] = True
    start = np.zeros(total, bool)
    start[first[:-1]] = True
    flat = np.full((k, k), 1.0 / k)  # the first word of a sequence has no label before it
    product = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    for s in range(BLOCK):
        live = np.flatnonzero(real[:, s])
        if not len(live):
            break
        step = product[live] @ (flat if s == 0 else moves)
        if s == 0:
            step[~start[live]] = product[live][~start[live]] @ moves
        step *= e[live, s][:, None, :]
        product[live] = step / step.sum((1, 2), keepdims=True)
    enter, leave = np.full((total, k), 1.0 / k), np.ones((total, k))
    order = np.argsort(-blocks, kind="stable")
    most = int(blocks.max(initial=0))
    count = np.searchsorted(-blocks[order], -np.arange(most), side="left")  # sequences with more than s blocks
    for s in range(most - 1):
        here = first[:-1][order[: count[s + 1]]] + s
        a = np.einsum("ni,nij->nj", enter[here], product[here])
        enter[here + 1] = a / a.sum(1, keepdims=True)
    for s in range(most - 1, 0, -1):
        here = first[:-1][order[: count[s]]] + s
        z = np.einsum("nij,nj->ni", product[here], leave[here])
        leave[here - 1] = z / z.sum(1, keepdims=True)
    alpha = np.empty_like(e)
    a = enter
    for s in range(BLOCK):
        step = a @ moves
        if s == 0:
            step[start] = 1.0 / k
        step *= e[:, s]
        step /= step.sum(1, keepdims=True)
        a = np.where(real[:, s][:, None], step, a)
        alpha[:, s] = a
    z = leave
    for s in range(BLOCK - 1, -1, -1):
        alpha[:, s] *= z
        step = (e[:, s] * z) @ moves.T
        step /= step.sum(1, keepdims=True)
        z = np.where(real[:, s][:, None], step, z)
    out = alpha[b, t]
    return out / out.sum(1, keepdims=True)


class Field:
    def __init__(self, labels: list[str], lexicon: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.labels, self.lexicon, self.weights, self.moves = labels, lexicon, weights, moves
        self._forget()

    def __getstate__(self):
        return {**self.__dict__, "known": {}, "cut": [], "table": None}

    def _forget(self):
        self.known: dict[str, int] = {}  # token: its unit's row; -1: no letter; -2 - i: the rows cut[i]
        self.cut: list[list[int]] = []
        self.table = np.zeros((0, len(self.labels)), np.float32)

    def _learn(self, tokens: list[str]) -> None:
        """Emission scores of tokens that aren't known."""
        if self.table is None or len(self.known) + len(tokens) > _STORE:
            self._forget()
        known, n, fresh = self.known, len(self.table), []

        def row(w: str) -> int:
            i = known.get(w)
            if i is None:
                i = known[w] = n + len(fresh)
                fresh.append(w)
            return i

        for token in tokens:
            ws = units(token)
            if len(ws) == 1:
                known[token] = row(ws[0])
            elif not ws:
                known[token] = -1
            else:
                self.cut.append([row(w) for w in ws])
                known[token] = -1 - len(self.cut)
        if fresh:
            f = Features(fresh, self.lexicon)
            got = np.concatenate([f.scores(self.weights, slice(i, i + 8192)) for i in range(0, len(fresh), 8192)])
            self.table = np.concatenate([self.table, np.exp(got - got.max(1, keepdims=True)).astype(np.float32)])

    def posteriors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(posterior of every unit of every word that has a letter, offsets of the texts)."""
        words = [t.split() if t else [] for t in texts]
        tokens = set().union(*words)
        new = tokens.difference(self.known)
        if new:
            if len(self.known) + len(new) > _STORE:
                self._forget()
                new = tokens
            self._learn(list(new))
        get = self.known.__getitem__
        index = np.fromiter((i for w in words for i in map(get, w)), np.int64, sum(map(len, words)))
        at = np.append(0, np.cumsum([len(w) for w in words]))
        many = np.ones(len(index), np.int64)
        many[index == -1] = 0
        long = np.flatnonzero(index < -1)
        for i in long:
            many[i] = len(self.cut[-2 - index[i]])
        ends = np.append(0, np.cumsum(many))
        rows = np.repeat(index, many)
        for i in long:
            rows[ends[i] : ends[i + 1]] = self.cut[-2 - index[i]]
        return forward_backward(self.table[rows].astype(np.float64) + 1e-12, np.exp(self.moves), ends[at]), ends[at]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.labels:
            return [("und", 0.0)] * len(texts)
        p, at = self.posteriors(texts)
        n = np.diff(at)
        total = np.append(np.zeros((1, p.shape[1])), np.cumsum(p, axis=0), axis=0)
        mass = total[at[1:]] - total[at[:-1]]
        out = []
        for m, many in zip(mass, n):
            k = int(m.argmax())
            out.append((self.labels[k], float(min(1.0, max(0.0, m[k] / many)))) if many else ("und", 0.0))
        return out


def pair_sums(forward: np.ndarray, moves: np.ndarray, p: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """[from, to] expected transitions into the words ``follow``: a word's posterior, dealt out by what came before."""
    before = forward[follow - 1]
    return moves * (before.T @ (p[follow] / (before @ moves)))


def chains(sample: list[tuple[str, str]], labels: list[str], seed: int = 1) -> list[tuple[list[str], list[int]]]:
    """(units, label of each) of every text, and of as many mixed ones."""
    r = random.Random(seed)
    one: dict[str, str] = {}  # equal units are one string
    plain = [([one.setdefault(u, u) for t in text.split() for u in units(t)], labels.index(y)) for text, y in sample]
    plain = [(ws, y) for ws, y in plain if ws]
    out = [(ws, [y] * len(ws)) for ws, y in plain]
    for ws, _ in plain:
        mixed, truth = [], []
        while len(mixed) < len(ws):
            other, y = r.choice(plain)
            n = r.randint(*STRETCH)
            i = r.randint(0, max(0, len(other) - n))
            mixed += other[i : i + n]
            truth += [y] * len(other[i : i + n])
        out.append((mixed, truth))
    return out


def fit(sample: list[tuple[str, str]], epochs: int = EPOCHS) -> Field:
    """A field from (text, language) rows."""
    labels = sorted({y for _, y in sample})
    k = len(labels)
    count = Counter(w for text, _ in sample for w in {u for t in text.split() for u in units(t)})
    lexicon = {w: i for i, w in enumerate(sorted(w for w, n in count.items() if n >= 5))}
    del count
    weights, moves = np.zeros((_HASHED + 1 + len(lexicon), k), np.float32), np.zeros((k, k))
    field = Field(labels, lexicon, weights, moves)
    sequences = chains(sample, labels)
    if k < 2 or not sequences:
        return field
    r, total = random.Random(2), sum(len(ws) for ws, _ in sequences)
    gw, gm = np.full(weights.shape, 1e-2, np.float32), np.full((k, k), 1e-2)
    for _ in range(epochs):
        r.shuffle(sequences)
        some, held = [], 0
        for i, s in enumerate(sequences, 1):
            some.append(s)
            held += len(s[0])
            if held < BATCH and i < len(sequences):
                continue
            number: dict[str, int] = {}
            index = np.array([number.setdefault(w, len(number)) for ws, _ in some for w in ws], np.int64)
            truth = np.array([y for _, ys in some for y in ys], np.int64)
            at = np.append(0, np.cumsum([len(ws) for ws, _ in some])).astype(np.int64)
            f = Features(list(number), lexicon)
            score = f.scores(weights)[index].astype(np.float64)
            emit = np.exp(score - score.max(1, keepdims=True)) + 1e-12
            forward, p = word_by_word(emit, np.exp(moves), at)
            away = -p
            away[np.arange(len(index)), truth] += 1
            word = np.stack([np.bincount(index, away[:, j], len(number)) for j in range(k)], 1)
            share = held / total
            rows, grad = f.gradient(word)
            grad -= 0.05 * share * weights[rows]
            inner = np.ones(len(index), bool)
            inner[at[:-1]] = False
            follow = np.flatnonzero(inner)
            seen = np.zeros((k, k))
            np.add.at(seen, (truth[follow - 1], truth[follow]), 1)
            gradm = seen - pair_sums(forward, np.exp(moves), p, follow) - 0.05 * share * moves
            gw[rows] += grad**2
            gm += gradm**2
            weights[rows] += 0.3 * grad / np.sqrt(gw[rows])
            moves += 0.3 * gradm / np.sqrt(gm)
            some, held = [], 0
    return field


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE, languages: int = LANGUAGES) -> Field:
    fair = docs.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    texts = fair.filter(F.col("text").isNotNull()).select("doc_id", "lang", stretched(F.col("text"), F.col("doc_id"), LONGEST, PIECES).alias("text"))
    ids = sample_ids(texts, "lang", sample, languages)
    each = TEXTS // max(1, len({y for _, y in ids}))
    if each < sample:
        seen = Counter()
        ids = [x for x in sorted(ids) if seen.update([x[1]]) or seen[x[1]] <= each]
    return fit([(t, y) for _, y, t in sampled_texts(texts, ids, ["doc_id", "lang"], "doc_id long, lang string")])


def _label(field, names):
    def run(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                got = field.predict(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], [*names, "lang_pred", "score"])

    return run


def language_id(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs with held_out (boolean), lang_pred (string) and score (double)."""
    docs = docs.select(*extras(docs, "held_out", "lang_pred", "score"))
    field = train(docs, sample)
    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    out = docs.transform(mapped, _label(field, docs.columns), f"{kinds}, lang_pred string, score double")
    return out.withColumn("held_out", held_out(F.col("doc_id")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language_id(documents(spark, sf_dir).select("doc_id", "text", "lang"))
    return out.select("doc_id", "held_out", "lang_pred", "score")
