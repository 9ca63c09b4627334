"""Ranges written as text: ``"5"``, ``"2..5"``, ``"..5"``, ``"2.."``; the high end is excluded."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Range:
    """Ends as text, None where open; ``exact`` makes the range a single value."""

    low: str | None
    high: str | None
    exact: bool = False

    def contains(self, value: Column, kind: str | None = None) -> Column:
        """Predicate on a column; ``kind`` is the SQL type that the ends are cast to.

        An end that doesn't cast is an error of the request, so it isn't tried per row.
        """
        def end(text: str) -> Column:
            return F.lit(text).cast(kind) if kind else F.lit(text)

        if self.exact:
            return value == end(self.low)
        tests = []
        if self.low is not None:
            tests.append(value >= end(self.low))
        if self.high is not None:
            tests.append(value < end(self.high))
        if not tests:
            return F.lit(True)
        return tests[0] & tests[1] if len(tests) == 2 else tests[0]

    def holds(self, value) -> bool:
        """The same test on a plain value (``bytes`` compare unsigned)."""
        kind = type(value)
        cast = (lambda t: t.encode()) if kind is bytes else kind
        if self.exact:
            return value == cast(self.low)
        return (self.low is None or value >= cast(self.low)) and (self.high is None or value < cast(self.high))


def int_range(text: str | None) -> Range:
    """Integers: one number is that number, ``"5..5"`` is empty; blanks around numbers are allowed."""
    if text is None or not text.strip():
        return Range(None, None)
    low, dots, high = (part.strip() for part in text.partition(".."))
    for part in (low, high):
        if part:
            int(part)
    if not dots:
        return Range(low, low, exact=True)
    return Range(low or None, high or None)


def value_range(text: str | None) -> Range:
    """Values in their natural order; one value, or equal ends, is that value."""
    if not text:
        return Range(None, None)
    low, dots, high = text.partition("..")
    if not dots or (low and low == high):
        return Range(low, low, exact=True)
    return Range(low or None, high or None)


def compare_bytes(a: bytes, b: bytes) -> int:
    """-1, 0 or 1; bytes are unsigned, a prefix comes first."""
    return (a > b) - (a < b)


def compare_bytes_descending(a: bytes, b: bytes) -> int:
    return compare_bytes(b, a)
