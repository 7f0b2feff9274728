"""Words of a batch of texts as 64-bit hashes, by vector operations on the batch's bytes.

A word's hash is a polynomial over random byte values mod 2**64, taken from running sums
(Karp-Rabin), then mixed. Texts stay in Arrow's buffers; work goes in pieces of about ``PIECE`` bytes, so memory
does not follow the batch. One text longer than a piece is handled whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)

#: Space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


@cache
def _byte_values() -> np.ndarray:
    v = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64)
    for c in range(ord("A"), ord("Z") + 1):
        v[c] = v[c + 32]
    return v


@cache
def _separators(plain: bool) -> np.ndarray:
    """True for bytes between words: white space; or, if ``plain``, every ASCII byte but letters and digits."""
    sep = np.zeros(256, bool)
    if plain:
        sep[:128] = [not chr(i).isalnum() for i in range(128)]
    else:
        sep[list(SPACES)] = True
    return sep


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i mod 2**64 for i < n (kept for the next call)."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + (PIECE >> 2))
        out = []
        for b in (BASE, INVERSE):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[:] = out
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def running(values: np.ndarray) -> np.ndarray:
    """Running Karp-Rabin sums S with S[0] = 0; ``window`` takes the hash of any stretch from them."""
    s = np.empty(len(values) + 1, np.uint64)
    s[0] = 0
    np.cumsum(values * powers(len(values))[0], out=s[1:])
    return s


def window(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (s[end] - s[start]) * powers(len(s))[1][start]


def pieces(texts: pa.Array | pa.ChunkedArray, plain: bool = False, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, index of each row's first word and the end) for stretches of rows; null is empty."""
    for lo, hi, part, at in _stretches(texts, size):
        yield (lo, hi, *_words(part, at, plain))


def spelled(texts: pa.Array | pa.ChunkedArray, plain: bool = False, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """As ``pieces``, with the stretch's bytes (A-Z as a-z) and each word's first and end byte between."""
    for lo, hi, part, at in _stretches(texts, size):
        h, starts, ends = _spans(part, at, plain)
        yield lo, hi, np.where((part >= 65) & (part <= 90), part + np.uint8(32), part), starts, ends, h, np.searchsorted(starts, at)


def _stretches(texts: pa.Array | pa.ChunkedArray, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, where each row begins in them and the end), about ``size`` bytes at a time."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if len(texts) == 0:
        return
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        yield lo, hi, part, at
        lo = hi


def _words(data: np.ndarray, at: np.ndarray, plain: bool) -> tuple[np.ndarray, np.ndarray]:
    h, starts, _ = _spans(data, at, plain)
    return h, np.searchsorted(starts, at)


def _spans(data: np.ndarray, at: np.ndarray, plain: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of each word."""
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    word = ~_separators(plain)[data]
    edge = np.zeros(len(data) + 1, bool)  # a text begins here
    edge[at] = True
    before = np.empty(len(data) + 1, bool)
    before[0], before[1:] = False, word
    here = np.empty(len(data) + 1, bool)
    here[-1], here[:-1] = False, word
    starts = np.flatnonzero(here & (~before | edge))
    ends = np.flatnonzero(before & (~here | edge))
    return mixed(window(running(_byte_values()[data]), starts, ends)), starts, ends


def paired(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The hash of a run of words and the word after it."""
    return mixed(h * np.uint64(0x9FB21C651E98DF25) + w)


def hashed(words: list[str], plain: bool = False) -> np.ndarray:
    """Hashes of single words, as ``pieces`` gives them."""
    out = [h for _, _, h, _ in pieces(pa.array([" ".join(words)], pa.string()), plain)]
    return out[0]


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words within a row (a row of fewer words: all its words as one run), and each row's first."""
    n = np.diff(first)
    s = running(h)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    at = np.zeros(len(first), np.int64)
    np.cumsum(count, out=at[1:])
    start = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], count)
    length = np.repeat(np.minimum(n, k), count)
    return mixed(window(s, start, start + length) + length.astype(np.uint64)), at
