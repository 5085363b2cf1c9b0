"""Operator 3: byte-level BPE by a lazily determinised finite-state transducer.

Texts are cut by ``public_tokenizers.PATTERN``; each match is encoded by itself.

A sequence of tokens is the encoding of its bytes exactly if every two neighbours
are the encoding of their joined bytes, so BPE needs no more memory than the last
token.  A state of the transducer holds the last token emitted and, for each
position where a longer token may still begin, the bytes since and the tokens that
lead there.  Reading a byte extends these, and tokens on which all of them agree
are emitted: no later byte can change them.  A pending token is at most as long as
the longest token, which bounds the lookahead.  What is pending when a match ends is
the state's final output; a match that is a token as a whole is that token, whether
merges build it or not.  States and transitions are determinised when first met and
kept, up to a bound; so are the outputs of whole matches, each of which has gone
through the transducer once.

Decoding joins token bytes; ``Utf8Stream`` is a state machine over bytes that
releases text as soon as its characters are complete.

Very long texts: a worker holds one text, its matches and 4 bytes for each id; a
match of any length takes one transition a byte.

Defined cases: null texts are empty and have no ids.  Rows are independent, so ids
may be null or repeat.  Extra columns stay; those named like an output are
replaced.
"""

from __future__ import annotations

import base64
import gc
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._frames import documents, extras, mapped
from ._words import slices

RANKS = "byte_bpe_multi_50k.tiktoken"
_STATES = 100_000
_PAIRS = 500_000
_STORE = 1_500_000
_KEPT = 64  # characters of the longest match that is held, so the store's bytes are bounded
_BLOCK = 1 << 16


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(ranks: dict[bytes, int], piece: bytes, below: int | None = None) -> list[bytes]:
    """Plain BPE of a few bytes, with merges of a rank under ``below``: the rules that the transducer is compiled from."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best) and (below is None or r < below):
                best, at = r, i
        if best is None:
            return parts
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


class Transducer:
    """Encodes one match of the pattern at a time.

    Positions where a longer token may begin are nodes of the vocabulary's trie."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.next: dict[int, int] = {}  # node << 8 | byte
        self.inner = bytearray(1)
        self.token = [-1]
        for t, i in ranks.items():
            node = 0
            for byte in t:
                child = self.next.get(node << 8 | byte)
                if child is None:
                    child = self.next[node << 8 | byte] = len(self.token)
                    self.token.append(-1)
                    self.inner[node] = 1
                    self.inner.append(0)
                node = child
            self.token[node] = i
        self.whole: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}
        self.spines: dict[tuple[int, int], list[tuple[int, bytes]]] = {}
        self._reset()

    def _reset(self) -> None:
        self.names: dict[tuple, int] = {}
        self.kept: list[tuple] = []
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self._state((-1, ((0, ()),), -1))

    def _state(self, key: tuple) -> int:
        """The number of a state: (last token emitted, (node, tokens before it) of each live position, the match so far as a token or -1)."""
        got = self.names.get(key)
        if got is None:
            got = self.names[key] = len(self.kept)
            self.kept.append(key)
        return got

    def _fits(self, a: int, b: int) -> bool:
        """Whether a and b stay two tokens side by side; a < 0: whether b is the encoding of its own bytes."""
        if a < 0:
            got = self.whole.get(b)
            if got is None:
                t = self.bytes_of[b]
                got = self.whole[b] = merge(self.ranks, t) == [t]
            return got
        key = a << 32 | b
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) > _PAIRS:
                self.pairs.clear()
            got = self.pairs[key] = self._fits(-1, a) and self._fits(-1, b) and self._apart(a, b)
        return got

    def _spine(self, t: int, side: int) -> list[tuple[int, bytes]]:
        """(rank of the merge that takes it up, bytes) of the tokens at one edge (-1: right, 0: left) as t is built, last first."""
        got = self.spines.get((t, side))
        if got is None:
            part, got = self.bytes_of[t], [(1 << 40, self.bytes_of[t])]
            while len(part) > 1:
                rank = self.ranks[part]
                part = merge(self.ranks, part, rank)[side]
                got.append((rank, part))
            self.spines[t, side] = got
        return got

    def _apart(self, a: int, b: int) -> bool:
        """No merge across the border comes before those that build a and b (of equal ranks, the leftmost comes first)."""
        get = self.ranks.get
        for until_a, x in self._spine(a, -1):
            for until_b, y in self._spine(b, 0):
                rank = get(x + y)
                if rank is not None and rank < until_a and rank <= until_b:
                    return False
        return True

    def _move(self, key: tuple, byte: int) -> tuple[tuple, tuple[int, ...]]:
        """A transition: the state after byte and the ids emitted."""
        last, live, _ = key
        after, found, whole = [], None, -1
        token, inner, step, known = self.token, self.inner, self.next.get, self.pairs.get
        for node, chain in live:
            child = step(node << 8 | byte)
            if child is None:
                continue
            if found is None and (t := token[child]) >= 0:
                before = chain[-1] if chain else last
                if before < 0:
                    whole = t  # from the beginning of the match
                    if self._fits(-1, t):
                        found = (t,)
                else:
                    fits = known(before << 32 | t)
                    if self._fits(before, t) if fits is None else fits:
                        found = (*chain, t)
            if inner[child]:
                after.append((child, chain))
        sure = len(found)
        for _, chain in after:  # what all of them begin with is sure
            n = min(sure, len(chain))
            sure = 0
            while sure < n and chain[sure] == found[sure]:
                sure += 1
            if not sure:
                after.append((0, found))
                return (last, tuple(after), whole), ()
        after.append((0, found))
        return (found[sure - 1], tuple([(s, c[sure:]) for s, c in after]), whole), found[:sure]

    def encode(self, piece: bytes) -> list[int]:
        """Follows kept transitions; the first that is missing is built and kept, what comes after it only built until it meets a kept state."""
        if len(self.kept) > _STATES:
            self._reset()
        out: list[int] = []
        state, moves, kept, names, move = 0, self.moves, self.kept, self.names.get, self._move
        for byte in piece:
            if state >= 0:
                step = moves.get(state << 8 | byte)
                if step is not None:
                    state, ready = step
                else:
                    key, ready = move(kept[state], byte)
                    n = len(kept)
                    to = self._state(key)
                    moves[state << 8 | byte] = to, ready
                    state = to if to < n else -1
            else:
                key, ready = move(key, byte)
                if ready:
                    state = names(key, -1)
            if ready:
                out += ready
        _, live, whole = kept[state] if state >= 0 else key
        if whole >= 0:
            return [whole]
        out += live[-1][1]
        return out


class _Outputs(dict):
    """Outputs of whole matches, found by the transducer when first asked for."""

    def __init__(self, transducer: Transducer):
        self.transducer = transducer

    def __missing__(self, piece: str) -> bytes:
        got = array("I", self.transducer.encode(piece.encode())).tobytes()
        if len(piece) <= _KEPT:
            self[piece] = got
        return got


class Encoder:
    """Texts to ids (little-endian 32-bit bytes) and back; holds the outputs of about ``_STORE`` matches."""

    def __init__(self, path: str):
        import regex

        ranks = load_ranks(path)
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        self.known = _Outputs(Transducer(ranks))
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.bytes_of[i] = t

    def encode(self, text: str) -> bytes:
        if len(self.known) > _STORE:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> str:
        """The text of ids, block by block."""
        stream, out = Utf8Stream(), []
        numbers = np.frombuffer(ids, "<u4")
        for i in range(0, len(numbers), _BLOCK):
            out.append(stream.feed(b"".join(map(self.bytes_of.__getitem__, numbers[i : i + _BLOCK].tolist()))))
        out.append(stream.close())
        return "".join(out)


#: States of ``Utf8Stream``: bytes of an unfinished character read so far.
_HELD = (0, 1, 1, 1, 1, 2, 1, 1, 1, 2, 3, 0)
_DONE, _BAD = 0, 11


def _utf8_moves() -> list[bytes]:
    """The state after each byte in each state.

    1: one byte is missing of two; 2 (after E0), 3 (after ED), 4: two of three, 5: one of three;
    6 (after F0), 7 (after F4), 8: three of four, 9: two, 10: one."""
    moves = [bytearray([_BAD]) * 256 for _ in _HELD]
    for states, low, high, to in (
        ((0,), 0x00, 0x7F, 0), ((0,), 0xC2, 0xDF, 1), ((0,), 0xE0, 0xE0, 2), ((0,), 0xE1, 0xEF, 4), ((0,), 0xED, 0xED, 3),
        ((0,), 0xF0, 0xF0, 6), ((0,), 0xF1, 0xF3, 8), ((0,), 0xF4, 0xF4, 7), ((1, 5, 10), 0x80, 0xBF, 0),
        ((2,), 0xA0, 0xBF, 5), ((3,), 0x80, 0x9F, 5), ((4,), 0x80, 0xBF, 5),
        ((6,), 0x90, 0xBF, 9), ((7,), 0x80, 0x8F, 9), ((8,), 0x80, 0xBF, 9), ((9,), 0x80, 0xBF, 10),
    ):
        for state in states:
            moves[state][low : high + 1] = bytes([to]) * (high + 1 - low)
    return [bytes(m) for m in moves]


_UTF8 = _utf8_moves()


class Utf8Stream:
    """Bytes in, text out, by a state machine; bytes of a character that isn't complete are held back.

    Bytes that begin no character, and characters cut off, become U+FFFD."""

    def __init__(self):
        self.state, self.held = _DONE, b""

    def feed(self, data: bytes) -> str:
        state, moves = self.state, _UTF8
        for byte in data:
            state = moves[state][byte]
        if state == _BAD:
            return self._repaired(data)
        data = self.held + data
        cut = len(data) - _HELD[state]
        self.state, self.held = state, data[cut:]
        return data[:cut].decode()

    def _repaired(self, data: bytes) -> str:
        out, state, begin = [], self.state, 0
        data, at = self.held + data, len(self.held)
        while at < len(data):
            after = _UTF8[state][data[at]]
            if after == _BAD:
                out.append(data[begin : at - _HELD[state]].decode() + "\ufffd")
                at += state == _DONE  # else this byte may begin a character of its own
                state, begin = _DONE, at
            else:
                state, at = after, at + 1
        cut = len(data) - _HELD[state]
        self.state, self.held = state, data[cut:]
        return "".join(out) + data[begin:cut].decode()

    def close(self) -> str:
        rest, self.state, self.held = self.held, _DONE, b""
        return "\ufffd" if rest else ""


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    got = Encoder(path)
    gc.freeze()  # the tables stay: the collector needn't look at them,
    gc.set_threshold(50_000)  # nor often at states and outputs
    return got


def _both(path, names):
    def run(batches):
        own = encoder(path)
        for whole in batches:
            for b in slices(whole, "text", 2 << 20):
                ids = [own.encode(t) if t else b"" for t in b.column("text").to_pylist()]
                text = [own.decode(x) for x in ids]
                n = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), n, pa.array(ids, pa.binary()), pa.array(text, pa.string())], [*names, "n_tokens", "ids", "decoded"])

    return run


def bpe_round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with n_tokens (long), ids (binary: little-endian unsigned 32-bit) and decoded (string)."""
    path = path or public_tokenizers.path(RANKS)
    docs = docs.select(*extras(docs, "n_tokens", "ids", "decoded"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.transform(mapped, _both(path, docs.columns), f"{kinds}, n_tokens long, ids binary, decoded string")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_round_trip(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
