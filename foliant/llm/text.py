"""Vectorised text primitives shared by the operators of this subpackage.

Texts arrive as Arrow string arrays.  Everything here works on whole batches: the characters of a
batch are one numpy array of code points, words are runs in it and get 64-bit hashes.  No function
looks at a prefix of a text or drops long ones; ``slices`` only bounds how many texts are expanded
at once, a longer text is expanded alone.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are expanded to code points and hashes at once.
SLICE_BYTES = 1 << 20
U64 = np.uint64


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the ``len + 1`` offsets into them; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[at[0] : at[-1]] if held is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each, in order; a longer text is a range of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    lo, n = 0, len(size)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it belongs to a word (letter, mark or number), and its lower case."""
    word = np.zeros(sys.maxunicode + 1, bool)
    lower = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(sys.maxunicode + 1):
        if 0xD800 <= c <= 0xF8FF or 0x323B0 <= c < 0xE0100 or c > 0xE01EF:  # surrogates, private use, unassigned
            continue
        ch = chr(c)
        word[c] = unicodedata.category(ch)[0] in "LMN"
        if word[c]:
            low = ch.lower()
            if len(low) == 1:
                lower[c] = ord(low)
    return word, lower


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=4)
def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, U64), np.full(n - 1, _BASE, U64)]), dtype=U64)


def powers(n: int) -> np.ndarray:
    """``_BASE ** i`` for i < n, modulo 2**64."""
    return _powers(1 << max(10, int(n - 1).bit_length()))[:n] if n else np.zeros(0, U64)


def runs_hash(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hash of each run ``values[s : s + n]``; runs are ascending and don't overlap."""
    if not len(starts):
        return np.zeros(0, U64)
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    within = np.arange(total) - np.repeat(first, lengths)
    flat = values[within + np.repeat(starts, lengths)].astype(U64) + U64(1)
    flat *= powers(int(lengths.max()))[within]
    full = np.zeros(len(starts), U64)
    some = lengths > 0
    if some.any():
        full[some] = np.add.reduceat(flat, first[some])
    return mix(full ^ (lengths.astype(U64) << U64(40)))


def codepoints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and ``len + 1`` offsets."""
    data, at = raw(texts)
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
    heads = (data & 0xC0) != 0x80
    count = np.concatenate([[0], np.cumsum(heads)])
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32), count[at]


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and ``len + 1`` offsets of texts into them.

    A word is a maximal run of letters, marks and numbers of any script; case is ignored.  Nulls,
    empty texts and texts without a word have none.
    """
    cp, at = codepoints(texts)
    is_word, lower = _tables()
    if not len(cp):
        return np.zeros(0, U64), np.zeros(len(at), np.int64)
    inside = is_word[cp]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = at[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(cp))]
    starts[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    s = np.flatnonzero(starts)
    n = np.flatnonzero(ends) + 1 - s
    if not len(s):
        return np.zeros(0, U64), np.zeros(len(at), np.int64)
    # hashes by prefix sums of character * power: one pass, no gather of the characters
    first = np.cumsum(n) - n
    within = np.arange(int(n.sum())) - np.repeat(first, n)
    flat = lower[cp[inside]].astype(U64) + U64(1)
    flat *= powers(int(n.max()))[within]
    hashed = mix(np.add.reduceat(flat, first) ^ (n.astype(U64) << U64(40)))
    return hashed, np.searchsorted(s, at)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of the given runs, one run after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) - np.repeat(ends - lengths - starts, lengths)
