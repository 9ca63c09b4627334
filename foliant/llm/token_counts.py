"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a piece of text form a linked list, its adjacent pairs a heap by merge rank.  The
lowest pair is popped and merged again and again; the count is the number of initial symbols less the
number of merges.  No identifier is looked up or emitted.  A text's count is the sum over its pieces,
which are cut at forced places (``vocabulary.Cuts``) and counted once per distinct piece of a batch.  Pieces of up to
32 bytes, nearly all, are merged thousands at a time, each with its own list and heap in the rows of matrices.

Results for odd inputs: a null text has a null count, an empty one 0; texts of any length are counted
whole, in ``n log n`` of the longest piece; repeated rows and ties get equal counts; an empty table
gives an empty result; only the named columns are read; a kept column named ``n_tokens`` gets an underscore behind its
name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.session import kept, small_batches, table
from foliant.llm.text import slices
from foliant.llm.vocabulary import PATTERN, Cuts, default_path, ranks

SLICE_BYTES = 8 << 20
#: Distinct pieces whose counts a Python worker remembers between batches; it then starts anew.
REMEMBERED = 400_000
#: Pieces that are merged at once.
ROWS = 1 << 14


def merges(piece: bytes, rank_of: dict[bytes, int]) -> int:
    """Number of merges in a piece of at least one byte.

    An entry of the heap holds the rank and the left symbol's place.  A symbol is the bytes from its
    place to ``after[place]``; an entry is stale, and skipped, unless ``rank[place]`` still is its rank.
    """
    n = len(piece)
    get = rank_of.get
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    rank = [get(piece[i : i + 2], -1) for i in range(n - 1)]
    rank.append(-1)
    width = n.bit_length()
    low = (1 << width) - 1
    heap = [(r << width) | i for i, r in enumerate(rank) if r >= 0]
    heapify(heap)
    done = 0
    while heap:
        top = heappop(heap)
        i = top & low
        if rank[i] != top >> width:
            continue
        j = after[i]
        end = after[i] = after[j]
        rank[j] = -1
        done += 1
        if end < n:
            before[end] = i
            r = rank[i] = get(piece[i : after[end]], -1)
            if r >= 0:
                heappush(heap, (r << width) | i)
        else:
            rank[i] = -1
        h = before[i]
        if h >= 0:
            r = rank[h] = get(piece[h:end], -1)
            if r >= 0:
                heappush(heap, (r << width) | h)
    return done


#: No pair here: above all ranks.
_NONE = np.int64(1 << 40)


class Pairs:
    """Ranks of adjacent symbols: of two bytes, and of any two tokens by their identifiers (a hash table)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.width = max(ranks.values()).bit_length()
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.first = np.array([[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], np.int64).reshape(-1)
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << self.width | b)
                    values.append(rank)
        self.bits = (4 * len(keys)).bit_length()
        self.key, self.value = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        key, value = np.array(keys, np.int64), np.array(values, np.int64)
        slot = self._slot(key)
        while len(key):
            free = np.flatnonzero(self.key[slot] < 0)
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.key[slot[put]], self.value[slot[put]] = key[put], value[put]
            rest = self.key[slot] != key
            key, value, slot = key[rest], value[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols, -1 where they don't merge."""
        key = left << self.width | right
        slot = self._slot(key)
        found = self.key[slot]
        out = np.where(found == key, self.value[slot], -1)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found = self.key[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.value[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


def merges_of(pieces: list[bytes], pairs: Pairs, leaves: int) -> np.ndarray:
    """Number of merges in each of many pieces of 1 to ``leaves`` bytes (a power of 2), all merged at once.

    A piece's linked list is a row of ``after`` and ``before``, its heap a row of a complete binary tree: a leaf holds
    rank and place of the pair that begins there, an inner node the lesser of its children, the root what is
    popped next.  A merge changes three leaves and mends the nodes above them.
    """
    n = np.fromiter(map(len, pieces), np.int64, len(pieces))
    data = np.frombuffer(b"".join(p.ljust(leaves, b"\0") for p in pieces), np.uint8).reshape(-1, leaves)
    places = np.arange(leaves)
    rank = np.full(data.shape, -1, np.int64)
    rank[:, :-1] = pairs.first[data[:, :-1].astype(np.int64) << 8 | data[:, 1:]]
    rank[places[None] + 1 >= n[:, None]] = -1
    shift = leaves.bit_length()
    levels = [np.where(rank >= 0, rank << shift | places, _NONE)]
    while levels[-1].shape[1] > 1:
        levels.append(np.minimum(levels[-1][:, ::2], levels[-1][:, 1::2]))
    levels = [x.reshape(-1) for x in levels]
    symbol = pairs.byte[data].reshape(-1)
    after = np.tile(places + 1, len(n))
    before = np.tile(places - 1, len(n))
    done = np.zeros(len(n), np.int64)
    row = np.arange(len(n))

    def mend(rows: np.ndarray, at: np.ndarray) -> None:
        size = leaves
        for low, high in zip(levels, levels[1:]):
            at, size = at >> 1, size >> 1
            k = rows * (2 * size) + 2 * at
            high[rows * size + at] = np.minimum(low[k], low[k + 1])

    while True:
        top = levels[-1][row]
        row = row[top < _NONE]
        if not len(row):
            return done
        top = top[top < _NONE]
        base, i, merged = row * leaves, top & ((1 << shift) - 1), top >> shift
        done[row] += 1
        j = after[base + i]
        end = after[base + j]
        after[base + i], symbol[base + i] = end, merged
        leaf = levels[0]
        leaf[base + j] = leaf[base + i] = _NONE
        on = np.flatnonzero(end < n[row])
        before[base[on] + end[on]] = i[on]
        r = pairs.rank_of(merged[on], symbol[base[on] + end[on]])
        leaf[base[on] + i[on]] = np.where(r >= 0, r << shift | i[on], _NONE)
        mend(row, j)
        mend(row, i)
        h = before[base + i]
        on = np.flatnonzero(h >= 0)
        r = pairs.rank_of(symbol[base[on] + h[on]], merged[on])
        leaf[base[on] + h[on]] = np.where(r >= 0, r << shift | h[on], _NONE)
        mend(row[on], h[on])


class Counter:
    """Counts tokens of whole batches; remembers the counts of common pieces."""

    def __init__(self, path: str):
        self.ranks = ranks(path)
        self.cuts = Cuts(self.ranks)
        self.pairs = Pairs(self.ranks)
        self.split = regex.compile(PATTERN).findall
        self.known: dict[bytes, int] = {}

    def parts(self, piece: bytes) -> list[bytes]:
        """What the pattern splits a piece into; a single word is left alone."""
        text = piece.decode("utf-8", "surrogateescape")
        if (text[1:] if text[0] == " " else text).isalpha():
            return [piece]
        return [part.encode("utf-8", "surrogateescape") for part in self.split(text)]

    def sizes(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each piece."""
        found, of = [], []
        for i, piece in enumerate(pieces):
            # a token is one symbol in the end, all its merges lead there
            for part in [piece] if piece in self.ranks else self.parts(piece):
                found.append(part)
                of.append(i)
        count = np.ones(len(found), np.int64)
        length = np.fromiter(map(len, found), np.int64, len(found))
        open_ = np.flatnonzero(np.fromiter((part not in self.ranks for part in found), bool, len(found)))
        least = 0
        for leaves in (16, 32):
            some = open_[(length[open_] > least) & (length[open_] <= leaves)]
            least = leaves
            for lo in range(0, len(some), ROWS):
                at = some[lo : lo + ROWS]
                count[at] = length[at] - merges_of([found[k] for k in at.tolist()], self.pairs, leaves)
        for k in open_[length[open_] > least].tolist():
            count[k] = length[k] - merges(found[k], self.ranks)
        return np.bincount(np.array(of, np.int64), count, len(pieces)).astype(np.int64)

    def count(self, texts: pa.Array) -> np.ndarray:
        distinct, which, of_text = self.cuts.pieces(texts)
        sizes = np.fromiter(map(self.known.get, distinct, repeat(0)), np.int64, len(distinct))
        new = np.flatnonzero(sizes == 0)
        pieces = [distinct[i] for i in new.tolist()]
        sizes[new] = self.sizes(pieces)
        self.known.update(x for x in zip(pieces, sizes[new].tolist()) if len(x[0]) < 32)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        ends = np.concatenate([[0], np.cumsum(sizes[which])])
        return np.diff(ends[of_text])


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_count(text: Column, path: str | None = None) -> Column:
    """Number of tokens of a text under the rank file at ``path``."""
    path = path or default_path()
    small_batches()

    @F.arrow_udf(T.LongType())
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        by = counter(path)
        for part in parts:
            counts = [by.count(part.slice(lo, hi - lo)) for lo, hi in slices(part, SLICE_BYTES)]
            yield pa.array(np.concatenate([*counts, np.zeros(0, np.int64)]), mask=~part.is_valid().to_numpy(zero_copy_only=False))

    return run(text)


def count(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """The columns ``keep`` and ``n_tokens``, one row per row of ``df``."""
    return df.select(*kept(df, keep, ("n_tokens",)), token_count(F.col(text), path).alias("n_tokens"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(table(spark, sf_dir, "documents"))
