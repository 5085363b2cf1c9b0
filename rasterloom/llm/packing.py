"""Operator 2: packing by power-of-two decomposition.

A document's ids (its tokens, then the end id) are cut into pieces whose lengths
are the binary digits of their number: as many full sequences as fit, then powers
of two, largest first.  A piece is a sequence of its own; since its length is a
power of two it needs no padding, no sequence crosses documents, and sequences of
one length lie together: sequence ids count up by (length, largest first, document,
start), so batches of equal length are ranges of ids.

The tokenizer lower-cases and drops white space, so ids of a word don't depend on
its neighbours: texts are split at ASCII white space, distinct new words are
tokenized together and kept in a bounded store for each worker.

Very long texts: a worker holds one text, its words and 4 bytes for each id.

Defined cases: a null or empty text has the end id alone.  A special token's literal
in a text is that token, as the tokenizer has it.  Rows with a null or
repeated id are documents of their own; equal rows get different sequences.  Extra
columns are dropped: the result is one row for each piece.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._frames import documents, mapped, ranks, written
from ._words import slices, text_buffer

MOST = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
_STORE = 1_000_000
_KEPT = 128  # bytes of the longest word that is held after its batch, so the store's bytes are bounded
#: Letters of ASCII and Latin-1 in lower case, digits, white space, full stops and commas.
_USUAL = bytes([*range(97, 123), *range(48, 58), 0x20, 0x0A, 0x2E, 0x2C, 0xC3, *range(0x80, 0xC0)])
_RUNS = (b"..", b",,", b".,", b",.", b"\xc3\x97", b"\xc3\xb7")
#: Letters of ASCII and Latin-1 in lower case, with ASCII marks (no apostrophe) before and after.
_WORD = re.compile(rb"([!-&(-/:-@\[-`{-~]*)((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)\Z")


class WordIds:
    """ids of words as little-endian 32-bit bytes; at most ``_STORE`` words are held."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.literals = [x.content.lower().encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = _Known()
        self.letters = {x: y for x, y in zip(range(256), _byte_letters())}

    def _single(self, words: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch(words, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in got]

    def learn(self, words: list[bytes]) -> None:
        """Adds words that aren't known yet. A run of letters is one match, so is a run of marks: their lower-case bytes go to the model as they are."""
        merge, letters, known, odd = self.tokenizer.model.tokenize, self.letters, self.known, []
        for w in words:
            if w.isalpha():  # bytes: ASCII letters, which stand for themselves
                known[w] = array("I", [x.id for x in merge(w.decode())]).tobytes()
                continue
            m = _WORD.match(w)
            if m is None:
                odd.append(w)
                continue
            ids = []
            for part in m.groups():
                if part:
                    low = part if part.isascii() else part.decode().lower().encode()
                    ids += [x.id for x in merge(low.decode("latin-1").translate(letters))]
            known[w] = array("I", ids).tobytes()
        for i in range(0, len(odd), 4096):
            part = odd[i : i + 4096]
            known.update(zip(part, self._single([x.decode() for x in part])))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """ids of each text; texts that hold a special token's literal are tokenized as a whole, as it has an id of its own."""
        low = [t.lower() for t in texts]
        special = {k for k, t in enumerate(low) if any(x in t for x in self.literals)}
        got = self._words([b"" if k in special else t for k, t in enumerate(low)])
        for k in special:
            got[k] = self._single([texts[k].decode()])[0]
        return got

    def _words(self, texts: list[bytes]) -> list[bytes]:
        split = [_apart(t).split() for t in texts]
        known = self.known
        get, new = known.__getitem__, known.new
        found, fresh = [], []
        for words in split:
            before = len(new)
            ids = list(map(get, words))
            found.append(ids if len(new) == before else None)
        if new:
            fresh = list(set(new))
            new.clear()
            if len(known) + len(fresh) > _STORE:
                known.clear()
                fresh = list(set().union(*split))
            self.learn(fresh)
            found = [map(get, words) if ids is None else ids for words, ids in zip(split, found)]
        out = [b"".join(ids) for ids in found]
        for w in fresh:
            if len(w) > _KEPT:
                known.pop(w, None)
        return out


class _Known(dict):
    """ids of words; words that aren't known are listed in ``new``."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> None:
        self.new.append(word)


def _byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: printable Latin-1 for itself, the rest from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def _apart(text: bytes) -> bytes:
    """text with single marks after words set apart, where each is a match of its own anyway: fewer distinct words."""
    if text.translate(None, _USUAL) or any(x in text for x in _RUNS):
        return text
    return text.replace(b".", b" . ").replace(b",", b" , ")


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(n: int, most: int = MOST) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; lengths are powers of two, largest first."""
    out = [(s, most) for s in range(0, n - n % most, most)]
    at, rest, size = n - n % most, n % most, most
    while rest:
        size >>= 1
        if rest >= size:
            out.append((at, size))
            at, rest = at + size, rest - size
    return out


def _cut(path, most, with_ids):
    def run(batches):
        own = word_ids(path)
        end = np.array([END_ID], "<u4").tobytes()
        for whole in batches:
            for b in slices(whole, "text", 2 << 20):
                data, at = text_buffer(b.column("text"))
                at = at.tolist()
                ids = own.encode([data[i:j].tobytes() for i, j in zip(at, at[1:])])
                row, start, length, crc, total, kept = [], [], [], [], [], []
                for k, x in enumerate(ids):
                    x = memoryview(x + end)
                    n = len(x) // 4
                    for s, size in pieces(n, most):
                        part = x[4 * s : 4 * (s + size)]
                        row.append(k)
                        start.append(s)
                        length.append(size)
                        crc.append(zlib.crc32(part))
                        total.append(n)
                        if with_ids:
                            kept.append(bytes(part))
                cols = {"doc_id": b.column("doc_id").take(pa.array(row, pa.int64())), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(total, pa.int64())}
                if with_ids:
                    cols["ids"] = pa.array(kept, pa.binary())
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return run


def pack(docs: DataFrame, path: str | None = None, most: int = MOST, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, with_ids: ids (binary)."""
    path = path or public_tokenizers.path(TOKENIZER)
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cut = written(docs.transform(mapped, _cut(path, most, with_ids), kinds), "pieces")
    out = ranks(cut, [F.col("length").desc(), F.col("doc_id").asc_nulls_last(), F.col("start").asc(), F.col("ids_crc32").asc()], "sequence_id")
    return out.withColumn("offset", F.lit(0).cast("long"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
