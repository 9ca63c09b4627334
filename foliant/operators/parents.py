"""Counts per bucket, de-duplicated over one or more levels of parents.

A row counts once for each distinct parent.  A path like ``"order,customer"`` goes from rows to their orders and
on to the orders' customers, dropping repetitions before every hop, so each join sees distinct keys only.  The rows
themselves are read once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NESTED = "_nested_"


def parse_path(text: str | None) -> list[str]:
    """Names between commas or semicolons; ``_nested_`` only in front."""
    names = [n.strip() for n in re.split(r"[,;]+", text or "")]
    names = [n for n in names if n]
    if not names:
        raise ValueError("parent_paths must name at least one level")
    if NESTED in names[1:]:
        raise ValueError(f"{NESTED} can only be the first level")
    return names


@dataclass(frozen=True)
class Parent:
    """Parent documents of one type: their rows, their key, and for the next levels the keys of *their* parents.

    ``live`` false rows are skipped at every level.
    """

    rows: DataFrame
    key: str
    live: Column | None = None

    def alive(self) -> DataFrame:
        return self.rows if self.live is None else self.rows.where(F.coalesce(self.live, F.lit(False)))


def undup(
    hits: DataFrame,
    bucket: str,
    path: str,
    parents: dict[str, Parent],
    keys: dict[str, str],
    *,
    root: str = "_root",
    roots: DataFrame | None = None,
    buckets: DataFrame | None = None,
    compensate_non_existing: bool = True,
    resilient: bool = False,
    alias: str = "doc_count",
) -> DataFrame:
    """``bucket, doc_count``: distinct parents at the last level of ``path`` of each bucket's rows.

    ``keys`` names, for each level, the column that holds a row's (or the level before's) parent key.  With
    ``_nested_`` first, hits are nested parts: alone it counts their roots, and before other levels the key is
    that of the root, taken from ``roots`` or from the hit itself where it carries it.  With
    ``compensate_non_existing``, last-level keys of which no live parent exists don't count.  ``buckets`` lists
    buckets that must appear, with 0 where they are empty.  ``resilient`` turns a bad path into zeros.
    """
    try:
        levels = parse_path(path)
        first, hops = levels[0], levels[1:]
        rest = hops if first == NESTED else levels
        unknown = [p for p in rest if p not in parents or p not in keys]
        if unknown:
            raise ValueError(f"no such parent: {', '.join(unknown)}")
    except ValueError:
        if not resilient:
            raise
        every = buckets if buckets is not None else hits.select(bucket)
        return every.select(bucket).where(F.col(bucket).isNotNull()).distinct().withColumn(alias, F.lit(0).cast("long"))
    # a bucket may be an array: a row is then in each of its elements' buckets
    is_array = hits.schema[bucket].dataType.typeName() == "array"
    named = hits.withColumn(bucket, F.explode(bucket)) if is_array else hits
    # the hits are read once: a key that leads nowhere becomes null, so a bucket keeps a row even if it counts 0
    if first == NESTED and rest and roots is None:
        start = keys[rest[0]]
    else:
        start = root if first == NESTED else keys[first]
    current = _distinct(named.select(F.col(bucket), F.col(start).alias("_key")), bucket)
    if first == NESTED and rest and roots is not None:
        current = _hop(current, roots.select(F.col(root).alias("_key"), F.col(keys[rest[0]]).alias("_next")), bucket)
    for level, following in zip(rest, rest[1:]):
        step = parents[level].alive().select(F.col(parents[level].key).alias("_key"), F.col(keys[following]).alias("_next"))
        current = _hop(current, step, bucket)
    if rest and compensate_non_existing:
        last = parents[rest[-1]]
        there = F.col(last.key)
        current = _hop(current, last.alive().select(there.alias("_key"), there.alias("_next")), bucket)
    counted = current.groupBy(bucket).agg(F.count("_key").alias(alias))
    if buckets is None:
        return counted
    every = buckets.select(bucket).where(F.col(bucket).isNotNull()).distinct()
    return every.join(counted, bucket, "left").select(bucket, F.coalesce(F.col(alias), F.lit(0)).alias(alias))


def _distinct(rows: DataFrame, bucket: str) -> DataFrame:
    return rows.where(F.col(bucket).isNotNull()).distinct()


def _hop(current: DataFrame, step: DataFrame, bucket: str) -> DataFrame:
    """Keys by the next level's, those without a parent by null."""
    return _distinct(current.join(step.where(F.col("_key").isNotNull()), "_key", "left").select(bucket, F.col("_next").alias("_key")), bucket)


def terms(rows: DataFrame, field: str, size: int | None = None, order: list[Column] | None = None) -> DataFrame:
    """Buckets of a field's values with their rows, ``key, count``: the largest first, ties by key, or in another order."""
    value = F.explode(field) if rows.schema[field].dataType.typeName() == "array" else F.col(field)
    counted = rows.select(value.alias("key")).where("key is not null").groupBy("key").agg(F.count("*").alias("count"))
    ordered = counted.orderBy(*(order or [F.desc("count")]), "key")
    return ordered.limit(size) if size else ordered
