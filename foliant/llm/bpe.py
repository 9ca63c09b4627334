"""BPE encoding and decoding with forced-boundary splitting.

Pairs of bytes that occur inside no vocabulary token mark places that no token can span.  A text is
cut at all of them, each distinct fragment of a batch is encoded once and on its own, and the
fragments' identifiers are put together again by index arithmetic.  The result equals the encoding
of the whole text.  Decoding gathers the tokens' bytes.  The library's own splitting keeps a stack frame for
every blank of a run, so fragments beyond ``LONG_BYTES`` are split here and only their parts are merged there.

Results for odd inputs: a null text has null identifiers, a null count and a null ``round_trip``; an
empty one has an empty list and 0; texts of any length are encoded whole, those without a single cut (one
fragment) and runs of millions of blanks among them; special tokens' strings in a text are ordinary text; repeated rows
and ties get equal results; an empty table gives an empty result; only the named columns are read; a kept
column named like one of the result gets an underscore behind its name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.session import free_name, kept, small_batches, table
from foliant.llm.text import ragged, raw, slices
from foliant.llm.vocabulary import PATTERN, Cuts, default_path, ranks

#: Bytes of text of which the fragments are found, made distinct and encoded at once.
SLICE_BYTES = 4 << 20
#: Longer fragments are split into parts before the library sees them.
LONG_BYTES = 1 << 14


class Codec:
    """Encoder and decoder of one rank file; ``pattern`` False skips the splitting before merges."""

    def __init__(self, path: str, pattern: bool = True):
        import tiktoken

        table_ = ranks(path)
        self.cuts = Cuts(table_, pattern)
        self.pattern = pattern
        self.split = regex.compile(PATTERN).findall
        self.core = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table_, special_tokens={})
        tokens = [b""] * (max(table_.values()) + 1)
        for token, rank in table_.items():
            tokens[rank] = token
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def fragment(self, piece: bytes) -> list[int]:
        """Identifiers of one fragment, encoded alone."""
        if not self.pattern:
            return self.core._encode_single_piece(piece)
        try:
            if len(piece) <= LONG_BYTES:
                return self.core.encode_ordinary(piece.decode())
        except UnicodeDecodeError:  # bytes that aren't UTF-8 are split here as well
            pass
        parts = self.split(piece.decode("utf-8", "surrogateescape"))
        return list(chain.from_iterable(self.core._encode_single_piece(part.encode("utf-8", "surrogateescape")) for part in parts))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers of all texts, and ``len + 1`` offsets; a null has none."""
        distinct, which, of_text = self.cuts.pieces(texts)
        coded = [self.fragment(piece) for piece in distinct]
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.fromiter(chain.from_iterable(coded), np.int32, int(size.sum()))
        first = np.cumsum(size) - size
        lengths = size[which]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return flat[ragged(first[which], lengths)], ends[of_text]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, and ``len + 1`` offsets.  An unknown identifier is an error."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size)):
            raise ValueError("an identifier isn't in the vocabulary")
        lengths = self.size[ids]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return self.bytes[ragged(self.at[ids], lengths)], ends[offsets]


@lru_cache(maxsize=2)
def codec(path: str, pattern: bool = True) -> Codec:
    return Codec(path, pattern)


_ENCODED = T.StructType([T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.IntegerType()), T.StructField("round_trip", T.BooleanType())])


def _equal(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray) -> np.ndarray:
    """Whether text i of ``a`` and of ``b`` are the same bytes, for all i."""
    if np.array_equal(a_at, b_at) and np.array_equal(a, b):
        return np.ones(len(a_at) - 1, bool)
    return np.array([np.array_equal(a[p:q], b[r:s]) for p, q, r, s in zip(a_at, a_at[1:], b_at, b_at[1:])], bool)


def encoded(text: Column, path: str | None = None, pattern: bool = True) -> Column:
    """Struct of ``token_ids``, ``n_tokens`` and ``round_trip`` (whether decoding gives the text back)."""
    path = path or default_path()
    small_batches()

    @F.arrow_udf(_ENCODED)
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = codec(path, pattern)
        for part in parts:
            ids, counts, same = [], [], []
            for lo, hi in slices(part, SLICE_BYTES):
                texts = part.slice(lo, hi - lo)
                found, at = coder.encode(texts)
                ids.append(found)
                counts.append(np.diff(at))
                same.append(_equal(*coder.decode(found, at), *raw(texts)))
            null = ~part.is_valid().to_numpy(zero_copy_only=False)
            n = np.concatenate([*counts, np.zeros(0, np.int64)])
            ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), mask=np.append(null, False))
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])))
            yield pa.StructArray.from_arrays([lists, pa.array(n.astype(np.int32), mask=null), pa.array(np.concatenate([*same, np.zeros(0, bool)]), mask=null)], fields=list(pa.struct([("token_ids", lists.type), ("n_tokens", pa.int32()), ("round_trip", pa.bool_())])))

    return run(text)


def decoded(token_ids: Column, path: str | None = None) -> Column:
    """The text that a list of identifiers stands for; bytes that aren't UTF-8 become U+FFFD."""
    path = path or default_path()
    small_batches()

    @F.arrow_udf(T.StringType())
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = codec(path)
        for part in parts:
            if isinstance(part, pa.ChunkedArray):
                part = part.combine_chunks()
            lengths = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            data, at = coder.decode(part.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)]))
            whole = data.tobytes()
            valid = part.is_valid().to_pylist()
            yield pa.array([whole[p:q].decode("utf-8", "replace") if ok else None for p, q, ok in zip(at, at[1:], valid)], pa.string())

    return run(token_ids)


_MADE = "token_ids", "n_tokens", "round_trip"


def encode(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None, pattern: bool = True) -> DataFrame:
    """The columns ``keep`` and ``token_ids``, ``n_tokens``, ``round_trip``, one row per row of ``df``."""
    both = df.select(*kept(df, keep, _MADE), encoded(F.col(text), path, pattern).alias(free_name(df, "__encoded")))
    *names, made = both.columns
    return both.select(*[F.col(f"`{c}`") for c in names], *[F.col(made)[c].alias(c) for c in _MADE])


def decode(df: DataFrame, token_ids: str = "token_ids", keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """The columns ``keep`` and ``text``."""
    return df.select(*kept(df, keep, ("text",)), decoded(F.col(token_ids), path).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
