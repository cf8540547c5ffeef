"""Vectorised word and shingle hashing over whole Arrow batches of text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Texts are hashed in pieces of about so many bytes; a longer text is a piece of its own.
PIECE = 1 << 21

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)

_all = np.arange(256)
_LOWER = np.where((_all >= 65) & (_all <= 90), _all + 32, _all).astype(np.uint8)
#: Word bytes of the class [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z became a-z.
ALNUM = (((_LOWER >= 48) & (_LOWER <= 57)) | ((_LOWER >= 97) & (_LOWER <= 122)) | (_LOWER >= 128))
#: Word bytes of the class [^\x20\x09-\x0D].
NONSPACE = ~((_all == 32) | ((_all >= 9) & (_all <= 13)))

_TO_ALNUM = bytes(int(_LOWER[b]) if ALNUM[b] else 32 for b in range(256))


def alnum_words(text: bytes) -> list[bytes]:
    """The words of the class ALNUM of one lower-cased text."""
    return text.translate(_TO_ALNUM).split()


def space_words(text: bytes) -> list[bytes]:
    """The words of the class NONSPACE of one lower-cased text."""
    return text.lower().split()


def mix(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser, a bijection of 64-bit numbers."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and len+1 offsets of a string column; a null is an empty text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(offs, dtype=np.int64, count=n + 1, offset=column.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of texts that together hold about ``size`` bytes."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


def word_hashes(data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of a run of texts, word offsets by text, and the words' byte positions.

    ``offsets`` are relative to ``data``. A word never crosses a text's end.
    """
    n = len(offsets) - 1
    inside = word_byte[data]
    if not inside.any():
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64), np.zeros(0, np.int64)
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    start[heads] = inside[heads]
    at = np.flatnonzero(start)
    spans = np.diff(np.append(at, len(data)))
    where = np.arange(at[0], len(data), dtype=np.int64) - np.repeat(at, spans)
    # bytes behind a word's end add nothing, so the longest word bounds the powers
    live = inside[at[0] :]
    where[~live] = 0
    pw = powers(int(where.max()) + 1)
    value = _BYTE[_LOWER[data[at[0] :]]] * pw[where]
    value[~live] = 0
    hashes = mix(np.add.reduceat(value, at - at[0]))
    return hashes, np.searchsorted(at, offsets).astype(np.int64), at


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; fewer words make one run of the whole sequence, none make none."""
    n = len(words)
    if n == 0:
        return words
    size = min(size, n)
    out = np.zeros(n - size + 1, dtype=np.uint64)
    for k in range(size):
        out = (out * _U(0xD6E8FEB86659FD93)) ^ words[k : n - size + 1 + k]
        out = out * _BASE + _U(size)
    return mix(out)


def hashed_texts(column: pa.Array, word_byte: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row of the batch, word hashes) for each text of the column, in order."""
    data, offsets = text_buffers(column)
    for i, j in pieces(offsets):
        lo = offsets[i]
        hashes, bounds, _ = word_hashes(data[lo : offsets[j]], offsets[i : j + 1] - lo, word_byte)
        for k in range(j - i):
            yield i + k, hashes[bounds[k] : bounds[k + 1]]
