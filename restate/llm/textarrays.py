"""Words and word shingles of Arrow text batches as flat numpy arrays.

A batch's UTF-8 bytes are hashed once by a polynomial prefix sum (mod 2^64), so
every word's hash is a difference of two prefix values and every shingle's hash a
combination of neighbouring words' hashes: no Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time; a longer text is worked on alone.
CHUNK_BYTES = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)

#: Byte classes: the words of ``[^\x20\x09-\x0D]+``.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: The words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased: 0-9, a-z and all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, 2 * CHUNK_BYTES)
        with np.errstate(over="ignore"):
            for name, base in (("_powers", _BASE), ("_inverses", _INVERSE)):
                a = np.full(n, base, np.uint64)
                a[0] = 1
                globals()[name] = np.multiply.accumulate(a)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def byte_chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of slices of a text column; null texts are empty."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + CHUNK_BYTES, "right")) - 1)
        yield at, to - at, data[off[at]:off[to]], off[at:to + 1] - off[at]
        at = to


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each ``data[start:end]``, the same wherever it stands."""
    _grow(len(data) + 1)
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers[:len(data)], out=prefix[1:])
        return mix((prefix[ends] - prefix[starts]) * _inverses[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, off: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and for each row the index of its first word (rows + 1 entries)."""
    data = LOWER[data]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = letters[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    before[off] = False  # a word does not go on into the next row
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside[1:]
    after[off[1:] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return hash_spans(data, starts, ends), np.searchsorted(starts, off)


def shingles(h: np.ndarray, first: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its n-word shingles; a row of fewer words is one shingle."""
    with np.errstate(over="ignore"):
        coef = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
        m = len(h) - n + 1
        grams = np.zeros(max(m, 0), np.uint64)
        for j in range(n if m > 0 else 0):
            grams += h[j:j + m] * coef[j]
        grams = mix(grams)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= n:
                yield np.unique(grams[a:b - n + 1])
            elif b > a:
                yield mix((h[a:b] * coef[:b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
            else:
                yield grams[:0]
