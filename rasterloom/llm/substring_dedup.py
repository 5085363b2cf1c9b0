"""Operator 1: substring dedup by recompression (see ``recompress``).

Every word covered by a window of ``window`` words whose word sequence also
starts earlier (smaller doc_id, or same document, earlier start) is removed.

1. Each document is recompressed; every window gets an anchor symbol, and each
   distinct anchor occurrence becomes a row (name, document, position).  Windows
   without a strong anchor stand for themselves.
2. Anchor names found twice or more reveal candidates.
3. Candidate windows are verified by the symbols that spell them out: one row (their
   names of 64 and 32 bits, document, start) each, grouped; all but the first
   occurrence are repeats.
4. Repeats go back to their documents, which drop the covered words.

Exact copies take no windows: whole documents have two names (64 and 61 bits, of all
words and their number), and one whose both names an earlier document has is a repeat
from end to end.  Names of documents are compared with names of documents only.

First and second names come from two independent hashes of the words' bytes, so words
or symbols that share one are told apart by the other.

Before each shuffle a map task sends one row for a name that it holds many
times; the other occurrences, already known to repeat, are dealt out by a random
key.  So no key gets more rows than there are map chunks.

Long texts are worked on in stretches of ``LIMIT`` bytes.

Defined cases: null and empty texts have no words.  Documents with a null id come
last.  Rows equal in id and text are one document, each gets the same result;
rows that share only the id are documents in the order of their text's hash.
Extra columns stay; those named like an output are replaced.
"""

from __future__ import annotations

import itertools
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._frames import RID, documents, extras, has_unique_ids, mapped, with_rid
from ._words import U, WHITE, mix, slices, text_buffer, word_bounds, word_hashes
from .recompress import Levels

WINDOW = 20
LIMIT = 4 << 20
_COPY = -(1 << 31)
_NAMED = -(1 << 61)  # less a second name of 61 bits: a whole document, before it is known as a copy
_CHUNK = 400_000


class _Part(NamedTuple):
    """Some documents' words, or a stretch of one long document's.

    rid: of each document; at: index of each document's first word here; h, g: first and second names of
    words; doc: document of each word; window: starts of windows; row: of the first document in the batch; base: words of the
    document before this stretch; last: whether the document ends here."""

    rid: np.ndarray
    at: np.ndarray
    h: np.ndarray
    g: np.ndarray
    doc: np.ndarray
    window: np.ndarray
    row: int
    base: int
    last: bool


def _stretches(data: np.ndarray, limit: int):
    """Byte ranges of about ``limit`` that end at white space."""
    i = 0
    while i < len(data):
        j = min(len(data), i + limit)
        while j < len(data):
            white = np.flatnonzero(WHITE[data[j : j + limit]])
            if len(white):
                j += int(white[0]) + 1
                break
            j = min(len(data), j + limit)
        yield i, j
        i = j


def _names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, mask: U) -> tuple[np.ndarray, np.ndarray]:
    """First and second names of words."""
    return word_hashes(data, starts, ends) & mask, word_hashes(data, starts, ends, 1)


def _parts(batch, size, limit, mask):
    """The batch's words in parts of bounded size.

    Stretches of a long document share size - 1 words, so each window lies in one of them; anchors
    depend on a window's words alone, so they are the same as in the whole."""
    k = 0
    for b in slices(batch, "text", min(1 << 20, limit)):
        rid = np.asarray(b.column(RID)).astype(np.int64)
        data, offsets = text_buffer(b.column("text"))
        if len(rid) > 1 or len(data) <= limit:
            starts, ends, at = word_bounds(data, offsets)
            h, g = _names(data, starts, ends, mask)
            doc = np.repeat(np.arange(len(rid)), np.diff(at))
            window = np.flatnonzero(doc[size - 1 :] == doc[: max(0, len(doc) - size + 1)])
            yield _Part(rid, at, h, g, doc, window, k, 0, True)
        else:
            held, base = (np.zeros(0, U),) * 2, 0
            for i, j in _stretches(data, limit):
                piece = data[i:j]
                h, g = map(np.concatenate, zip(held, _names(piece, *word_bounds(piece, np.array([0, len(piece)]))[:2], mask)))
                window = np.arange(max(0, len(h) - size + 1))
                yield _Part(rid, np.array([0, len(h)]), h, g, np.zeros(len(h), np.int64), window, k, base, j == len(data))
                held = tuple(x[max(0, len(x) - size + 1) :] for x in (h, g))
                base += len(h) - len(held[0])
        k += len(rid)


def _first(h, at):
    first = np.zeros(len(h), bool)
    first[at[:-1][np.diff(at) > 0]] = True
    return first


def _known(order, same):
    """For rows sorted by ``order``: which repeat the row before, in input positions."""
    known = np.zeros(len(order), bool)
    known[order[1:][same]] = True
    return known


def _salt(rid, pos):
    return mix(rid.astype(U) * U(0x9E3779B97F4A7C15) + pos.astype(np.int64).astype(U) + U(0x51ED270B))


def _find(size, limit, mask):
    """Rows (name, rid, pos, known): pos >= 0 an anchor, ~start a window of its own, _NAMED or less the whole document.

    known: the name has another occurrence (for documents: an earlier one with the same second name) in this chunk."""

    def flush(parts):
        name, rid, pos = (np.concatenate(x) for x in zip(*parts))
        name &= mask
        order = np.lexsort((pos, rid, np.where(pos <= _NAMED, pos, 0), name))
        once = np.ones(len(order), bool)  # windows far apart can have one anchor occurrence
        once[1:] = (np.diff(pos[order]) != 0) | (np.diff(rid[order]) != 0) | (name[order][1:] != name[order][:-1])
        name, rid, pos = (x[order[once]] for x in (name, rid, pos))
        order = np.arange(len(name))
        copy = pos <= _NAMED
        same = (name[1:] == name[:-1]) & (copy[1:] == copy[:-1]) & (~copy[1:] | (pos[1:] == pos[:-1]))
        later = _known(order, same)
        more = np.zeros(len(order), bool)
        more[order[:-1][same]] = True
        name = np.where(later, _salt(rid, pos), name)
        known = np.where(copy, later, later | more)
        return pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(rid), pa.array(pos), pa.array(known)], ["name", RID, "pos", "known"])

    def run(batches):
        parts, held = [], 0
        for whole in batches:
            total, seen = (0, 0), 0  # of a document in stretches
            for p in _parts(whole, size, limit, mask):
                rid, at, h, g, doc, window, _, base, last = p
                place = np.arange(len(h)) - at[doc] + base
                by = mix(place.astype(U) + U(77))
                powers = h * by, mix(g + by)
                if base or not last:
                    new = (x[max(0, seen - base) :] for x in powers)
                    total, seen = tuple((t + int(x.sum(dtype=U))) % (1 << 64) for t, x in zip(total, new)), base + len(h)
                    (sums, seconds), n = (np.array([t], U) for t in total), np.array([seen])
                    if last:
                        total, seen = (0, 0), 0
                else:
                    (sums, seconds), n = (c[at[1:]] - c[at[:-1]] for c in (np.append(U(0), np.cumsum(x, dtype=U)) for x in powers)), np.diff(at)
                long = np.flatnonzero(n >= size) if last else np.zeros(0, np.int64)
                if len(long):
                    second = (mix(seconds[long] ^ mix(n[long].astype(U))) >> U(3)).astype(np.int64)
                    parts.append((mix(sums[long] + n[long].astype(U)), rid[long], _NAMED - second))
                if len(window):
                    levels = Levels(h, g, _first(h, at))
                    word, length, name = levels.anchors(window, size)
                    strong = length > 0
                    i, name = word[strong], name[strong]
                    step = np.ones(len(i), bool)
                    step[1:] = (i[1:] != i[:-1]) | (name[1:] != name[:-1])
                    i, name = i[step], name[step]
                    own = window[~strong]
                    parts.append((name, rid[doc[i]], place[i]))
                    parts.append((levels.keys(own, size)[0], rid[doc[own]], ~place[own]))
                    held += len(i) + len(own)
                held += len(long)
                if held >= _CHUNK:
                    yield flush(parts)
                    parts, held = [], 0
        if parts:
            yield flush(parts)

    return run


def _expand(size, limit, mask):
    """Rows (k1, k2, rid, start, n, known) of the candidate windows; known rows are repeats already and may stand for n windows."""

    def flush(parts):
        k1, k2, rid, start, n, known = (np.concatenate(x) for x in zip(*parts))
        k1 &= mask
        order = np.lexsort((start, rid, k2, k1))
        same = (k1[order][1:] == k1[order][:-1]) & (k2[order][1:] == k2[order][:-1])
        known |= _known(order, same)
        k1 = np.where(known, _salt(rid, start), k1)
        keep = np.ones(len(k1), bool)  # windows are in input order: join runs of known repeats
        run = known[1:] & known[:-1] & (rid[1:] == rid[:-1]) & (start[1:] == start[:-1] + 1) & (n[1:] == 1) & (n[:-1] == 1)
        keep[1:] = ~run
        head = np.flatnonzero(keep)
        n = np.add.reduceat(n, head)
        cols = [k1[head].view(np.int64), k2[head], rid[head], start[head].astype(np.int32), n.astype(np.int32), known[head]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["k1", "k2", RID, "start", "n", "known"])

    def run(batches):
        parts, held = [], 0
        for whole in batches:
            column = whole.column("pos")
            for p in _parts(whole, size, limit, mask):
                rid, at, h, g, doc, window, row, base, _ = p
                if not len(window):
                    continue
                lists = column.slice(row, len(rid))
                counts = np.asarray(pa.compute.list_value_length(lists).fill_null(0)).astype(np.int64)
                pos = np.asarray(lists.flatten()).astype(np.int64)
                of = np.repeat(np.arange(len(rid)), counts)
                copies = np.zeros(len(rid), bool)
                copies[of[pos == _COPY]] = True
                n = np.diff(at)
                for d in np.flatnonzero(copies & (n >= size)):
                    one = np.array([base])
                    parts.append((_salt(rid[[d]], one), np.zeros(1, np.int32), rid[[d]], one, np.array([n[d] - size + 1]), np.ones(1, bool)))
                place = np.where(pos >= 0, pos, ~pos) - base
                live = (pos != _COPY) & ~copies[of] & (place >= 0) & (place < n[of])
                of, pos, place = of[live], pos[live], place[live]
                strong, own = np.zeros(len(h) + 1, bool), np.zeros(len(h) + 1, bool)
                strong[(at[of] + place)[pos >= 0]] = True
                own[(at[of] + place)[pos < 0]] = True
                levels = Levels(h, g, _first(h, at))
                word, length, _ = levels.anchors(window, size)
                w = window[np.where(length > 0, strong[word], own[window])]
                if len(w):
                    k1, k2 = levels.keys(w, size)
                    parts.append((k1, k2, rid[doc[w]], w - at[doc[w]] + base, np.ones(len(w), np.int64), np.zeros(len(w), bool)))
                held += len(w)
                if held >= _CHUNK:
                    yield flush(parts)
                    parts, held = [], 0
        if parts:
            yield flush(parts)

    return run


def _drop(size, schema, limit):
    """Rows with n_words, n_removed and kept_text."""

    def run(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                text, spans = b.column("text"), b.column("spans")
                words, removed, kept = [], [], []
                data, at = text_buffer(text)
                for i in range(b.num_rows):
                    own = data[at[i] : at[i + 1]]
                    stay = None
                    if spans[i].is_valid:
                        s = spans[i].values
                        start, n = (np.asarray(s.field(f)).astype(np.int64) for f in ("start", "n"))
                        step = np.zeros(int((start + n).max()) + size, np.int64)
                        np.add.at(step, start, 1)
                        np.add.at(step, start + n + size - 1, -1)
                        stay = np.cumsum(step) == 0
                    total, gone, out = 0, 0, []
                    for x, y in _stretches(own, limit):
                        some = own[x:y].tobytes().split()
                        if stay is not None:
                            here = stay[total : total + len(some)]
                            total += len(some)
                            gone += int(len(here) - here.sum())
                            some = [*itertools.compress(some, here.tolist()), *some[len(here) :]]
                        else:
                            total += len(some)
                        if some:
                            out.append(b" ".join(some))
                    words.append(total)
                    removed.append(gone)
                    kept.append(b" ".join(out))
                got = {"n_words": pa.array(words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())}
                names = [f for f in schema if f not in got]
                yield pa.RecordBatch.from_arrays([*(b.column(f) for f in names), *got.values()], [*names, *got])

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, limit: int = LIMIT, bits: int = 64) -> DataFrame:
    """docs with n_words, n_removed (long) and kept_text: the kept words, joined by one space.

    limit: bytes of a text that are worked on at a time; bits: how many of first names are kept (results don't depend on it)."""
    mask = U((1 << bits) - 1)
    others = extras(docs, RID, "n_words", "n_removed", "kept_text", "spans", "pos")
    unique = has_unique_ids(docs)
    docs = with_rid(docs.select(*others), unique)
    if unique:
        rows = docs.repartition(RID)  # one exchange, read by both joins
        rows = rows.select(RID, *others)
        once, read = rows, docs
    else:  # one row of each document is searched, or a repeated row would be a repeat of itself
        rows, once = docs, docs.select(RID, "text").dropDuplicates([RID])
        read = once
    found = read.select(RID, "text").transform(mapped, _find(window, limit, mask), f"name long, {RID} long, pos long, known boolean")
    copy = F.col("pos") <= _NAMED
    same = Window.partitionBy("name", "copy")
    found = found.withColumn("copy", copy).withColumn("c", F.count(F.lit(1)).over(same)).withColumn("least", F.min(RID).over(same))
    one = F.min("pos").over(same) == F.max("pos").over(same)  # documents whose second names differ are compared by windows
    found = found.withColumn("one", one)
    found = found.filter(F.col("known") | (F.when(F.col("copy"), F.col("one") & (F.col("least") < F.col(RID))).otherwise(F.col("c") > 1)))
    found = found.withColumn("pos", F.greatest("pos", F.lit(_COPY)).cast("int"))
    lists = found.groupBy(RID).agg(F.collect_list("pos").alias("pos"))
    held = once.join(lists.hint("shuffle_hash"), RID)  # all columns, or it would be another exchange
    seen = held.transform(mapped, _expand(window, limit, mask), f"k1 long, k2 int, {RID} long, start int, n int, known boolean")
    nth = F.row_number().over(Window.partitionBy("k1", "k2").orderBy(RID, "start"))
    again = seen.withColumn("nth", nth).filter("known or nth > 1")
    spans = again.groupBy(RID).agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    out = rows.join(spans.hint("shuffle_hash") if unique else spans, RID, "left").select(*others, "spans")  # repeated rows: AQE splits a hot document
    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.select(*others).dtypes)
    return out.transform(mapped, _drop(window, others, limit), f"{kinds}, n_words long, n_removed long, kept_text string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
