"""Row predicates of a document table, as a small tree.

Unless the outermost query says otherwise, only live root documents are searched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Query:
    """A predicate; ``reach`` gives the rows that are searched when the query is the outermost one."""

    def predicate(self) -> Column:
        raise NotImplementedError

    def reach(self) -> Column:
        return F.col("_path").isNull() & F.col("_live")


@dataclass(frozen=True)
class MatchAll(Query):
    def predicate(self) -> Column:
        return F.lit(True)


@dataclass(frozen=True)
class Term(Query):
    """Rows whose column equals a value, or, for an array column of terms, holds it."""

    column: str
    value: object
    in_array: bool = False

    def predicate(self) -> Column:
        c = F.col(self.column)
        return F.coalesce(F.array_contains(c, self.value) if self.in_array else c == F.lit(self.value), F.lit(False))


@dataclass(frozen=True)
class Bool(Query):
    """All of ``must``, none of ``must_not``, and one of ``should`` unless something must match.

    ``minimum_should_match`` says how many of ``should`` are needed: by default 1 without and 0 with a ``must``.
    """

    must: tuple[Query, ...] = ()
    should: tuple[Query, ...] = ()
    must_not: tuple[Query, ...] = ()
    minimum_should_match: int | None = None

    def predicate(self) -> Column:
        out = F.lit(True)
        for q in self.must:
            out &= q.predicate()
        least = self.minimum_should_match
        least = (0 if self.must else 1) if least is None else least
        if self.should and least == 1:
            some = F.lit(False)
            for q in self.should:
                some |= q.predicate()
            out &= some
        elif least > 0 and (self.should or least > 1):
            out &= sum((q.predicate().cast("int") for q in self.should), F.lit(0)) >= least
        for q in self.must_not:
            out &= ~q.predicate()
        return out


@dataclass(frozen=True)
class MatchDeleted(Query):
    """Deleted documents that match, all of them by default; inverts wherever it stands."""

    query: Query = MatchAll()

    def predicate(self) -> Column:
        return ~F.col("_live") & self.query.predicate()

    def reach(self) -> Column:
        return F.col("_path").isNull()


class Fuzzy(MatchDeleted):
    """The same predicate under the name ``bm_fuzzy``."""


@dataclass(frozen=True)
class MatchNested(Query):
    """Nested parts that match, all of them by default."""

    query: Query = MatchAll()

    def predicate(self) -> Column:
        return F.col("_path").isNotNull() & self.query.predicate()

    def reach(self) -> Column:
        return F.col("_live")


@dataclass(frozen=True)
class AllowNested(Query):
    """Roots and nested parts that match."""

    query: Query

    def predicate(self) -> Column:
        return self.query.predicate()

    def reach(self) -> Column:
        return F.col("_live")


def search(docs: DataFrame, query: Query) -> DataFrame:
    """The rows that a query finds."""
    return docs.where(query.reach() & query.predicate())


def deleted_since(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """Documents of an earlier snapshot that a later one no longer has."""
    return before.join(now.select(key), key, "left_anti")
