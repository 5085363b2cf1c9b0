"""Vectorised word splitting and word hashing over Arrow string columns.

Words are ``[^\\x20\\x09-\\x0D]+``.  A chunk of texts is one byte buffer with
offsets; words are hashed eight bytes at a time, all words at once, so no Python
loop runs over words but over those longer than ``_LONG`` bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash

U = np.uint64
_LONG = 64
_K = (U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95))  # odd: for each of two independent hashes
_SEED = (U(0xA24BAED4963EE407), U(0x8CB92BA72F3D8DD7))

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift)."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word_offsets): byte bounds of all words, and the index of each text's first word."""
    n = len(data)
    w = np.zeros(n + 2, bool)
    w[1:-1] = ~WHITE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(w[1:-1] & (~w[:-2] | cut[:-1]))
    ends = np.flatnonzero(w[1:-1] & (~w[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes; which: 0 or 1, of two independent ones.

    Eight bytes at a time are mixed into what came before, so a byte's effect depends on its place and on all before it;
    words of equal length up to eight bytes never share a hash.  Words of over ``_LONG`` bytes go through XXH3, a half of 128 bits each."""
    size = ends - starts
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 8,), "<u8", padded, strides=(1,))
    out = mix(size.astype(U) * _K[which] + _SEED[which])
    short = np.flatnonzero(size <= _LONG)
    at = 0
    while len(short):
        left = size[short] - at
        x = eight[starts[short] + at].astype(U)
        part = left < 8
        x[part] &= (U(1) << (left[part] * 8).astype(U)) - U(1)
        out[short] = mix(out[short] ^ mix((x + U(at)) * _K[which]))
        at += 8
        short = short[left > 8]
    for i in np.flatnonzero(size > _LONG):
        both = xxhash.xxh3_128_intdigest(data[starts[i] : ends[i]].tobytes())
        out[i] = U(both >> 64 if which else both & (1 << 64) - 1)
    return out


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20):
    """Row slices of a batch with about ``most`` bytes of text each (one row at least)."""
    sizes = np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0)).astype(np.int64)
    total = np.cumsum(sizes)
    i = 0
    while i < batch.num_rows:
        done = total[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(total, done + most, "right")))
        yield batch.slice(i, j - i)
        i = j
