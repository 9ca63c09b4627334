"""Renderings of sizes, bytes and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def size_text(size: Column) -> Column:
    """``"999 bytes"``, ``"1.00 KB"``, ``"12.3 KB"``, ``"1000 KB"``, ``"1.50 MB"``: steps of 1000, taken when exceeded."""
    n = size.cast("double")
    unit = F.when(n / 1e6 > 1000, "GB").when(n / 1e3 > 1000, "MB").otherwise("KB")
    x = F.when(n / 1e6 > 1000, n / 1e9).when(n / 1e3 > 1000, n / 1e6).otherwise(n / 1e3)
    number = F.when(x < 10, F.format_string("%.2f", F.round(x, 2))).when(x < 100, F.format_string("%.1f", F.round(x, 1))).otherwise(F.format_string("%.0f", F.round(x, 0)))
    return F.when(n < 1000, F.format_string("%d bytes", size.cast("long"))).otherwise(F.concat_ws(" ", number, unit))


def grouped_hex(value: Column) -> Column:
    """Upper-case hexadecimal in brackets, with a blank after every 4 bytes: ``[01020304 05]``."""
    return F.concat(F.lit("["), F.regexp_replace(F.hex(value), "(.{8})(?=.)", "$1 "), F.lit("]"))


def plain_hex(value: Column) -> Column:
    """Lower-case bytes without leading zeros, blanks between them."""
    return F.rtrim(F.regexp_replace(F.lower(F.hex(value)), "(?:0([0-9a-f])|([0-9a-f]{2}))", "$1$2 "))


def printable(value: Column) -> Column:
    """Printable ASCII; every run of anything else is one blank."""
    return F.regexp_replace(value, "[^\\x21-\\x7f]+", " ")


def bitset_bytes(length: Column) -> Column:
    """Estimated bytes of a bitset of so many bits; -1 for none."""
    return F.coalesce(F.floor((length + 64) / 8), F.lit(-1)).cast("long")
