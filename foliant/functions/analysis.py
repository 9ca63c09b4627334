"""Text analysis as column expressions.

The simple form of a token stream is an array of strings, one position each; the full form is an array of
structs with offsets, position increments and marks (``TOKEN``).  Everything here stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full form of a token.
TOKEN = "struct<term: string, start: int, end: int, pos_inc: int, pos_len: int, type: string, keyword: boolean>"
WORD = r"[\p{L}\p{N}]+"


def tokens(text: Column, pattern: str = WORD) -> Column:
    """Lower-cased words of a text, in order; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def blank_tokens(text: Column) -> Column:
    """What blanks separate, in order and as it is."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)), F.array().cast("array<string>"))


def full(terms: Column) -> Column:
    """The full form of an array of strings, with offsets as if blanks stood between them."""
    begin = F.aggregate(terms, F.array(F.lit(0)), lambda s, t: F.concat(s, F.array(F.element_at(s, -1) + F.length(t) + 1)))
    return F.transform(F.arrays_zip(terms.alias("term"), F.slice(begin, 1, F.greatest(F.size(terms), F.lit(0))).alias("start")), lambda z: F.struct(
        z["term"].alias("term"), z["start"].alias("start"), (z["start"] + F.length(z["term"])).alias("end"),
        F.lit(1).alias("pos_inc"), F.lit(1).alias("pos_len"), F.lit("word").alias("type"), F.lit(False).alias("keyword")))


def check_shingle_sizes(least: int, most: int) -> None:
    if most < 2:
        raise ValueError("max_shingle_size must be at least 2")
    if not 2 <= least <= most:
        raise ValueError("min_shingle_size must be at least 2 and at most max_shingle_size")


def shingles(terms: Column, min_size: int = 2, max_size: int = 2, unigrams: bool = True, unigrams_if_none: bool = False, separator: str = " ") -> Column:
    """Word n-grams of an array of strings, at each place the unigram, then growing sizes.

    A term with a character other than letters and digits takes part only as the first of an n-gram, or as a
    unigram.  ``unigrams_if_none`` gives the last terms, at most ``min_size - 1``, where nothing else comes out.
    """
    check_shingle_sizes(min_size, max_size)
    sizes = ([1] if unigrams else []) + list(range(min_size, max_size + 1))
    n = F.size(terms)
    plain = F.transform(terms, lambda t: t.rlike(r"^[\p{L}\p{Nd}]*$"))

    def at(i: Column) -> Column:
        def gram(size: int) -> Column:
            fits = (i + size <= n) & F.forall(F.slice(plain, i + 2, size - 1), lambda p: p) if size > 1 else i < n
            text = F.array_join(F.slice(terms, i + 1, size), separator)
            return F.when(fits, text)

        return F.filter(F.array(*[gram(s) for s in sizes]), lambda g: g.isNotNull())

    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    out = F.flatten(F.transform(places, at))
    if unigrams_if_none and not unigrams:
        last = F.least(n, F.lit(min_size - 1))
        rest = F.when(n > 0, F.slice(terms, n - last + 1, last)).otherwise(terms)
        out = F.when(F.size(out) > 0, out).otherwise(rest)
    return out


def global_unique(elements: Column) -> Column:
    """Terms of an array of term arrays without repetitions across all of them; case counts."""
    return F.array_distinct(F.flatten(elements))


def unique_on_position(stream: Column) -> Column:
    """Full tokens without those that repeat a term of the same position."""
    begin = F.struct(F.array().cast(f"array<{TOKEN}>").alias("out"), F.array().cast("array<string>").alias("seen"))

    def step(state: Column, t: Column) -> Column:
        same = t["pos_inc"] == 0
        again = same & F.array_contains(state["seen"], t["term"])
        seen = F.when(same, F.array_append(state["seen"], t["term"])).otherwise(F.array(t["term"]))
        return F.struct(F.when(again, state["out"]).otherwise(F.array_append(state["out"], t)).alias("out"), seen.alias("seen"))

    return F.aggregate(stream, begin, step, lambda s: s["out"])


def skip(terms: Column, min_position: int = 2) -> Column:
    """An array of strings from a position on (>= 0), or without its first ``-min_position`` terms (< 0)."""
    first = 1 - min_position if min_position < 0 else max(min_position, 1)
    return F.when(F.size(terms) >= first, F.slice(terms, first, F.size(terms))).otherwise(F.array().cast("array<string>"))


def skip_tokens(stream: Column, min_position: int = 2) -> Column:
    """The same on full tokens: positions follow the increments, and what shares the last skipped position goes too."""
    place = F.aggregate(F.transform(stream, lambda t: t["pos_inc"]), F.array().cast("array<int>"), lambda s, x: F.array_append(s, F.coalesce(F.element_at(F.concat(F.array(F.lit(0)), s), -1), F.lit(0)) + x))
    if min_position >= 0:
        # the first token at the position and all after it, whatever their own increments
        return F.filter(stream, lambda t, i: F.get(place, i) >= min_position)
    n = -min_position
    following = F.slice(stream, n + 1, F.greatest(F.size(stream) - n, F.lit(0)))
    kept = F.when(F.size(stream) > n, following).otherwise(F.slice(stream, 1, 0))
    fresh = F.array_position(F.transform(kept, lambda t: t["pos_inc"] != 0), F.lit(True)).cast("int")
    return F.when(fresh > 0, F.slice(kept, F.greatest(fresh, F.lit(1)), F.size(kept))).otherwise(F.slice(stream, 1, 0))


def field_count(terms: Column, prefix: str = "") -> Column:
    """Struct of ``terms`` and ``length``: their number, or what the last ``prefix<digits>`` term says (-1 if none); such terms go."""
    if not prefix:
        return F.struct(terms.alias("terms"), F.size(terms).alias("length"))
    marked = F.filter(terms, lambda t: t.startswith(prefix) & F.substring(t, len(prefix) + 1, 1 << 30).rlike("^[0-9]+$"))
    said = F.substring(F.try_element_at(marked, F.lit(-1)), len(prefix) + 1, 1 << 30).cast("int")
    return F.struct(F.filter(terms, lambda t: ~(t.startswith(prefix) & F.substring(t, len(prefix) + 1, 1 << 30).rlike("^[0-9]+$"))).alias("terms"), F.coalesce(said, F.lit(-1)).alias("length"))
