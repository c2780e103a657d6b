"""Words of many texts as numpy arrays: boundaries, 64-bit hashes, n-grams, winnowing.

A column of texts is one byte buffer with offsets. Separators are ASCII bytes only, so words are found on
UTF-8 bytes without decoding. Every function works on whole texts; buffers are walked in segments of a
fixed size, so memory does not depend on the length of one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: bytes of text that are hashed at once, and bytes of text that one chunk of documents aims at
SEGMENT = 1 << 20
CHUNK_BYTES = 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_NOT_ALNUM = np.zeros(256, bool)
_NOT_ALNUM[:0x80] = True
_NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
_BREAK = np.zeros(256, bool)
_BREAK[0x0A] = True
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[0x41:0x5B] += 32

#: name -> (separator bytes, byte mapping): words between white space; the same lower-cased; runs of letters and digits lower-cased; lines
KINDS = {"space": (_SPACE, _SAME), "lower": (_SPACE, _LOWER), "alnum": (_NOT_ALNUM, _LOWER), "line": (_BREAK, _SAME)}

_ODD = np.uint64(0x9E3779B97F4A7C15)
_GRAM = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (the public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_TABLES = {name: _BYTE[fold] for name, (_, fold) in KINDS.items()}
_POWERS: list[np.ndarray] = []


def _powers() -> np.ndarray:
    """_ODD ** i for i up to SEGMENT, made once per process."""
    if not _POWERS:
        p = np.full(SEGMENT + 1, _ODD, np.uint64)
        p[0] = 1
        _POWERS.append(np.cumprod(p))
    return _POWERS[0]


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        column = pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi
        lo = hi


def bounds(data: np.ndarray, offsets: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word of every row (one more than rows)."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~KINDS[kind][0][data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    at = offsets[:-1]
    at = at[at < len(data)]
    starts[at] |= inside[at]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = offsets[1:]
    last = last[last > 0] - 1
    ends[last] |= inside[last]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: str) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes, finalised with its length."""
    out = np.zeros(len(starts), np.uint64)
    power, table, lo = _powers(), _TABLES[kind], 0
    while lo < len(starts):
        base = starts[lo]
        hi = int(np.searchsorted(ends, base + SEGMENT, "right"))
        if hi <= lo:  # one word longer than a segment
            word = KINDS[kind][1][data[base : ends[lo]]].tobytes()
            out[lo] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
            lo += 1
            continue
        total = np.zeros(ends[hi - 1] - base + 1, np.uint64)
        np.cumsum(table[data[base : ends[hi - 1]]] * power[: len(total) - 1], out=total[1:])
        s, e = starts[lo:hi] - base, ends[lo:hi] - base
        out[lo:hi] = mix((total[e] - total[s]) * power[SEGMENT - s] + (e - s).astype(np.uint64))
        lo = hi
    return out


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row of every word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def grams(words: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of the n words from each position on, over row ends as well; see :func:`gram_starts`."""
    m = max(0, len(words) - n + 1)
    total = np.full(m, salt, np.uint64)
    for j in range(n):
        total = total * _GRAM + words[j : j + m]
    return mix(total)


def grams_at(words: np.ndarray, at: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """:func:`grams` at chosen positions only."""
    total = np.full(len(at), salt, np.uint64)
    for j in range(n):
        total = total * _GRAM + words[at + j]
    return mix(total)


def gram_starts(first: np.ndarray, n: int, n_grams: int) -> np.ndarray:
    """Whether the n words from each position on lie in one row."""
    ok = np.zeros(n_grams + n, bool)
    counts = np.maximum(np.diff(first) - n + 1, 0)
    edge = np.zeros(n_grams + n + 1, np.int32)
    has = counts > 0
    np.add.at(edge, first[:-1][has], 1)
    np.add.at(edge, first[:-1][has] + counts[has], -1)
    ok = np.cumsum(edge)[:n_grams] > 0
    return ok


def anchors(k_grams: np.ndarray, w: int) -> np.ndarray:
    """Winnowing: for each start of w consecutive k-grams, the position of the leftmost smallest one."""
    m = max(0, len(k_grams) - w + 1)
    best = k_grams[:m].copy()
    at = np.zeros(m, np.uint8)
    for j in range(1, w):
        x = k_grams[j : j + m]
        less = x < best
        np.copyto(best, x, where=less)
        at[less] = j
    return at + np.arange(m)


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n words lie within ``length`` words from one of the starts on."""
    edge = np.zeros(n + length + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge)[:n] > 0


def member(keys: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether each key occurs in an ordered array."""
    if not len(ordered):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(ordered, keys)
    at[at == len(ordered)] = 0
    return ordered[at] == keys
