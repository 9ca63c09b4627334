"""Byte-pair vocabularies and the forced cuts that they imply.

A rank file gives every token's bytes and its merge rank.  ``Cuts`` marks the places of a text at
which no token can ever lie: the two bytes there occur side by side in no token, and the pattern
that splits text before the merges splits there whatever the context.  The pieces between such
places are encoded or counted on their own, each distinct piece once per batch.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from foliant.llm.text import raw

#: The pattern that splits text before the merges of the rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    """The 50k byte-level rank file of the public tokenizers that are installed with Python."""
    found = importlib.util.find_spec("public_tokenizers")
    folder = os.path.dirname(found.origin) if found else "/opt/tokenizers"
    return os.path.join(folder, "byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def never_adjacent(tokens) -> np.ndarray:
    """For each pair of bytes, at ``first * 256 + second``: True if it occurs inside no token."""
    never = np.ones(1 << 16, bool)
    for token in tokens:
        if len(token) > 1:
            b = np.frombuffer(token, np.uint8).astype(np.int64)
            never[b[:-1] * 256 + b[1:]] = False
    return never


def _split_anyway() -> np.ndarray:
    """Pairs of bytes between which ``PATTERN`` always ends one piece and begins another.

    The text before such a place is split as if it ended there, and the text after it as if it began
    there: a place between two classes of characters, unless blanks come first (a blank may join
    what follows) or an apostrophe does (it may begin a contraction).  The second byte is ASCII.
    """
    kind = np.zeros(256, np.int8)  # 0 no ASCII, 1 letter, 2 digit, 3 other, 4 blank
    for c in range(128):
        ch = chr(c)
        kind[c] = 1 if ch.isalpha() else 2 if ch.isdigit() else 4 if ch in " \t\n\r\v\f" else 3
    kind[0x1C:0x20] = 5  # blanks for some engines only: never next to a cut
    a, b = np.meshgrid(kind, kind, indexing="ij")
    ok = (a != b) & np.isin(a, (1, 2, 3)) & np.isin(b, (1, 2, 3))
    ok[ord("'")] = False  # an apostrophe may take the letters after it
    ok |= np.isin(a, (1, 2, 3)) & (b == 4)
    ok |= (a == 0) & (b == 4)  # unless the character is a blank beyond ASCII, see Cuts.starts
    first_alone = np.arange(256) == ord(" ")
    ok[:, first_alone] |= np.isin(kind, (1, 2, 3))[:, None]
    return ok.reshape(-1)


class Cuts:
    """Finds forced cuts; ``pattern`` False takes the bare vocabulary, without splitting before merges."""

    def __init__(self, tokens, pattern: bool = True):
        self.pattern = pattern
        self.table = never_adjacent(tokens)
        if pattern:
            self.table &= _split_anyway()

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Positions in ``data`` where a piece begins: each text's first byte and each forced cut."""
        begins = np.zeros(len(data), bool)
        if len(data) > 1:
            pair = data[:-1].astype(np.uint16)
            pair <<= 8
            pair |= data[1:]
            begins[1:] = self.table[pair]
            if self.pattern:
                self._keep_wide_blanks(data, begins)
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(begins)

    @staticmethod
    def _keep_wide_blanks(data: np.ndarray, begins: np.ndarray) -> None:
        """No cut after a blank beyond ASCII: U+0085, U+00A0, U+1680, U+2000 to U+205F, U+3000."""
        at = np.flatnonzero(begins)
        at = at[data[at - 1] >= 0x80]
        if not len(at):
            return
        tail, before = data[at - 1], data[np.maximum(at - 2, 0)]
        two = (before == 0xC2) & ((tail == 0x85) | (tail == 0xA0))
        lead = data[np.maximum(at - 3, 0)]
        three = ((lead == 0xE1) & (before == 0x9A)) | ((lead == 0xE2) & ((before == 0x80) | (before == 0x81))) | ((lead == 0xE3) & (before == 0x80))
        begins[at[two | three]] = False

    def pieces(self, texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Distinct pieces, the number of the piece at each place, and ``len + 1`` offsets of texts."""
        data, offsets = raw(texts)
        if not len(data):
            return [], np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        starts = self.starts(data, offsets)
        bounds = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
        spans = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, bounds, pa.py_buffer(np.ascontiguousarray(data))])
        coded = spans.dictionary_encode()
        return coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.searchsorted(starts, offsets)
