"""Sharding by jump consistent hashing.

A stable key is hashed to 64 bits and jumps through ever larger bucket numbers; the last one below
the number of shards is its shard.  No ring table exists, and when shards are appended a key either
stays or moves to one of the new shards (in expectation ``added / total`` of all keys move).

Results for odd inputs: a null key has a null shard; an empty key is a key like any other, and a very long one is
hashed whole; equal keys, repeated rows included, always share a shard; an empty table gives an empty result; the
number of shards must be at least 1.  Only the key column is read, whatever else the table holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.session import kept, table

_STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key; all keys jump together, those that have landed are left out."""
    if shards < 1:
        raise ValueError("the number of shards must be at least 1")
    out = np.zeros(len(keys), np.int64)
    at = np.arange(len(keys))
    state = keys.astype(np.uint64, copy=True)
    following = np.zeros(len(keys), np.int64)
    while len(at):
        out[at] = following
        state = state * _STEP + np.uint64(1)
        following = np.floor((following + 1) * (2147483648.0 / ((state >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        on = following < shards
        at, state, following = at[on], state[on], following[on]
    return out


def hash64(key: Column) -> Column:
    """The first 8 bytes of the key's MD5, stable across engines and versions."""
    return F.unhex(F.substring(F.md5(key.cast("string").cast("binary")), 1, 16))


def _landing(counts: tuple[int, ...], kind: T.DataType):
    """Arrow UDF from 8 bytes of hash to the shard under each count; a struct for several."""

    @F.arrow_udf(kind)
    def land(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            valid = part.is_valid().to_numpy(zero_copy_only=False)
            keys = np.frombuffer(b"".join(part.drop_null().to_pylist()), ">u8").astype(np.uint64)
            out = []
            for shards in counts:
                found = np.zeros(len(part), np.int32)
                found[valid] = jump(keys, shards)
                out.append(pa.array(found, mask=~valid))
            yield out[0] if len(out) == 1 else pa.StructArray.from_arrays(out, names=kind.names)

    return land


def shard_of(key: Column, shards: int) -> Column:
    """Column with the shard, 0 to ``shards - 1``, of a key of any type that casts to string."""
    if shards < 1:
        raise ValueError("the number of shards must be at least 1")
    return _landing((shards,), T.IntegerType())(hash64(key))


def assign(df: DataFrame, shards: int, added: int = 0, key: str = "doc_id") -> DataFrame:
    """``key, shard`` and, with ``added`` shards appended, ``shard_after`` and ``moved``.

    One row per row of ``df``.  Moved rows always go to an appended shard.  A key named like one of these has an
    underscore behind its name.
    """
    if shards < 1 or added < 0:
        raise ValueError("the number of shards must be at least 1, and none can be taken away")
    made = ("shard", "shard_after", "moved") if added else ("shard",)
    (own,) = kept(df, (key,), made)
    if not added:
        return df.select(own, shard_of(F.col(key), shards).alias("shard"))
    both = T.StructType([T.StructField(name, T.IntegerType()) for name in made[:2]])
    out = df.select(own, _landing((shards, shards + added), both)(hash64(F.col(key))).alias("__both"))
    name = out.columns[0]
    return out.select(F.col(f"`{name}`"), F.col("__both.shard").alias("shard"), F.col("__both.shard_after").alias("shard_after"), (F.col("__both.shard") != F.col("__both.shard_after")).alias("moved"))


SHARDS, ADDED = 1024, 64


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"), SHARDS, ADDED)


SQL = f"""
WITH RECURSIVE k AS (
  SELECT DISTINCT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 16))::UBIGINT::HUGEINT AS h
  FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT unnest([{SHARDS}, {SHARDS + ADDED}]) AS n),
walk AS (
  SELECT doc_id, n, h AS state, -1::BIGINT AS b, 0::BIGINT AS j FROM k CROSS JOIN s
  UNION ALL
  SELECT doc_id, n, nx, j,
         floor((j + 1)::DOUBLE * (2147483648::DOUBLE / ((nx // 8589934592) + 1)::DOUBLE))::BIGINT
  FROM (SELECT doc_id, n, j, (state * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS nx
        FROM walk WHERE j < n)),
landed AS (SELECT doc_id, n, max(b) AS b FROM walk GROUP BY doc_id, n)
SELECT d.doc_id, x.b::INTEGER AS shard, y.b::INTEGER AS shard_after, x.b <> y.b AS moved
FROM documents d
LEFT JOIN landed x ON x.doc_id = d.doc_id AND x.n = {SHARDS}
LEFT JOIN landed y ON y.doc_id = d.doc_id AND y.n = {SHARDS + ADDED}
"""
