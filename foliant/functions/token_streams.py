"""Token-stream operators whose rules depend on positions: full shingles and word delimiting.

They take and return the full form of tokens (``analysis.TOKEN``) as Arrow batches.  Streams without holes are
served by ``analysis.shingles`` inside the JVM; ``split_words`` below does the same for plain splitting.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.analysis import TOKEN, check_shingle_sizes


@dataclass
class Token:
    term: str
    start: int = 0
    end: int = 0
    pos_inc: int = 1
    pos_len: int = 1
    type: str = "word"
    keyword: bool = False


def _plain(term: str) -> bool:
    return all(c.isalpha() or c.isdecimal() for c in term)


def shingle(stream: list[Token], min_size: int = 2, max_size: int = 2, unigrams: bool = True, unigrams_if_none: bool = False, separator: str = " ", filler: str = "_", trailing_holes: int = 0) -> list[Token]:
    """Word n-grams with positions: holes are filled, n-grams of nothing but fillers don't come out.

    The first token that comes out at a place keeps the place's increment, further ones have 0.  An n-gram is
    marked as keyword and has the type ``shingle``.
    """
    check_shingle_sizes(min_size, max_size)
    window: list[tuple[Token, bool]] = []
    for t in stream:
        window += [(Token(filler, t.start, t.start), True)] * min(max(t.pos_inc - 1, 0), max_size - 1)
        window.append((t if t.pos_inc <= 1 else replace(t, pos_inc=1), False))
    end = stream[-1].end if stream else 0
    window += [(Token(filler, end, end), True)] * min(trailing_holes, max_size - 1)
    sizes = ([1] if unigrams else []) + list(range(min_size, max_size + 1))
    out: list[Token] = []
    any_shingle = False
    fallback_from = len(window) - (min_size - 1) if unigrams_if_none and not unigrams else len(window)
    for i, (first, _) in enumerate(window):
        fresh = True
        own_sizes = [1] if i >= fallback_from and not any_shingle else sizes
        for size in own_sizes:
            part = window[i : i + size]
            if len(part) < size or any(not f and not _plain(t.term) for t, f in part[1:]):
                break
            if all(f for _, f in part):
                continue
            any_shingle |= size > 1
            length = size if unigrams else max(1, size - min_size + 1)
            out.append(Token(separator.join(t.term for t, _ in part), first.start, part[-1][0].end, first.pos_inc if fresh else 0, length, "shingle" if size > 1 else first.type, size > 1 or first.keyword))
            fresh = False
    return out


LOWER, UPPER, DIGIT, DELIM = 1, 2, 4, 8
ALPHA, ALPHANUM = LOWER | UPPER, LOWER | UPPER | DIGIT
_NAMED = {"LOWER": LOWER, "UPPER": UPPER, "ALPHA": ALPHA, "DIGIT": DIGIT, "ALPHANUM": ALPHANUM, "SUBWORD_DELIM": DELIM}
_ESCAPES = {"\\": "\\", "n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def _unescaped(text: str) -> str:
    return re.sub(r"\\(u[0-9a-fA-F]{4}|[\s\S])", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else _ESCAPES[m[1]] if m[1] in _ESCAPES else _bad(m[0]), text)


def _bad(what: str):
    raise ValueError(f"unknown escape {what!r}")


def parse_type_table(rules: list[str]) -> dict[str, int]:
    """Character classes of rules like ``"$ => DIGIT"``; one character a rule."""
    table: dict[str, int] = {}
    for rule in rules:
        m = re.fullmatch(r"(.*)\s*=>\s*(.*)\s*", rule, re.DOTALL)
        if not m:
            raise ValueError(f"invalid rule: {rule!r}")
        char, kind = _unescaped(m[1].strip()), m[2].strip()
        if len(char) != 1:
            raise ValueError(f"a rule must name one character: {rule!r}")
        if kind not in _NAMED:
            raise ValueError(f"unknown class in {rule!r}")
        table[char] = _NAMED[kind]
    return table


def _class(c: str, table: dict[str, int]) -> int:
    if c in table:
        return table[c]
    kind = unicodedata.category(c)
    if kind == "Lu":
        return UPPER
    if kind == "Ll":
        return LOWER
    if kind in ("Lt", "Lm", "Lo", "Mn", "Mc", "Me"):
        return ALPHA
    return DIGIT if kind in ("Nd", "Nl", "No") else DELIM


@dataclass
class WordDelimiter:
    """Splits tokens at delimiters and at changes of case and between letters and digits, with graph positions.

    The parts of a token follow each other; catenated runs and the original lie beside them with the number of
    parts that they span as ``pos_len``.
    """

    generate_word_parts: bool = True
    generate_number_parts: bool = True
    catenate_words: bool = False
    catenate_numbers: bool = False
    catenate_all: bool = False
    split_on_case_change: bool = True
    preserve_original: bool = False
    split_on_numerics: bool = True
    stem_english_possessive: bool = True
    ignore_keywords: bool = True
    adjust_offsets: bool = True
    type_table: dict[str, int] = field(default_factory=dict)
    protected_words: frozenset[str] = frozenset()

    def parts(self, term: str) -> list[tuple[int, int, int]]:
        """Start, end and class of each part."""
        kinds = [_class(c, self.type_table) for c in term]
        out, i, n = [], 0, len(term)
        while i < n:
            if kinds[i] & DELIM:
                i += 1
                continue
            start, last = i, kinds[i]
            i += 1
            while i < n and not kinds[i] & DELIM and not self._breaks(last, kinds[i]):
                last = kinds[i]
                i += 1
            kind = DIGIT if kinds[start] == DIGIT else ALPHA
            out.append((start, i, kind))
            if self.stem_english_possessive and i + 1 < n and term[i] == "'" and term[i + 1] in "sS" and last & ALPHA and (i + 2 == n or kinds[i + 2] & DELIM):
                i += 2
        return out

    def _breaks(self, last: int, kind: int) -> bool:
        if last & kind:
            return False
        if self.split_on_case_change and last & ALPHA and kind & ALPHA:
            return last == LOWER or last & UPPER == 0  # an upper-case letter goes with the lower-case ones after it
        if last & ALPHA and kind & ALPHA:
            return False
        return self.split_on_numerics

    def __call__(self, stream: list[Token]) -> list[Token]:
        out: list[Token] = []
        for t in stream:
            if (self.ignore_keywords and t.keyword) or t.term in self.protected_words:
                out.append(t)
                continue
            parts = self.parts(t.term)
            whole = len(parts) == 1 and parts[0][:2] == (0, len(t.term))
            if whole or (not parts and not self.preserve_original and not t.term):
                out.append(t)
                continue
            if not parts:
                if self.preserve_original:
                    out.append(t)
                continue
            own = self.adjust_offsets and t.end - t.start == len(t.term)

            def made(text: str, lo: int, hi: int, place: int, length: int, t: Token = t, own: bool = own) -> tuple:
                return place, -length, Token(text, t.start + lo if own else t.start, t.start + hi if own else t.end, 1, length, t.type, t.keyword)

            wanted = [bool(self.generate_number_parts if kind == DIGIT else self.generate_word_parts) for _, _, kind in parts]
            # places count the parts that come out; one that doesn't shares the next one's place
            place, places = 0, []
            for yes in wanted:
                places.append(place)
                place += yes
            total = max(place, 1)
            found = [made(t.term[lo:hi], lo, hi, places[i], 1) for i, (lo, hi, _) in enumerate(parts) if wanted[i]]

            def catenated(lo: int, hi: int, found: list = found, parts: list = parts, places: list = places, t: Token = t, total: int = total) -> None:
                text = "".join(t.term[a:b] for a, b, _ in parts[lo:hi])
                begin = min(places[lo], total - 1)
                end = places[hi] if hi < len(parts) else total
                found.append(made(text, parts[lo][0], parts[hi - 1][1], begin, max(1, end - begin)))

            i = 0
            while i < len(parts):
                j = i + 1
                while j < len(parts) and (parts[j][2] == DIGIT) == (parts[i][2] == DIGIT):
                    j += 1
                number = parts[i][2] == DIGIT
                if (self.catenate_numbers if number else self.catenate_words) and (j - i > 1 or not wanted[i]) and not (self.catenate_all and j - i == len(parts)):
                    catenated(i, j)
                i = j
            if self.catenate_all and (len(parts) > 1 or not any(wanted)):
                catenated(0, len(parts))
            if self.preserve_original:
                found.append((0, -total - 1, replace(t, pos_len=total)))
            found.sort(key=lambda f: f[:2])
            before = None
            for at, _, token in found:
                step = t.pos_inc if before is None else at - before
                out.append(replace(token, pos_inc=step))
                before = at
        return out


def _udf(run: Callable[[list[Token]], list[Token]]):
    names = list(Token.__dataclass_fields__)
    kind = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("pos_inc", pa.int32()), ("pos_len", pa.int32()), ("type", pa.string()), ("keyword", pa.bool_())]))

    @F.arrow_udf(f"array<{TOKEN}>")
    def apply(streams: pa.Array) -> pa.Array:
        out = [None if s is None else [{n: getattr(t, n) for n in names} for t in run([Token(**t) for t in s])] for s in streams.to_pylist()]
        return pa.array(out, kind)

    return apply


def shingled(stream: Column, **options) -> Column:
    """``shingle`` of full tokens."""
    check_shingle_sizes(options.get("min_size", 2), options.get("max_size", 2))
    return _udf(lambda tokens: shingle(tokens, **options))(stream)


def word_delimited(stream: Column, delimiter: WordDelimiter | None = None) -> Column:
    """``WordDelimiter`` on full tokens."""
    return _udf(delimiter or WordDelimiter())(stream)


def split_words(terms: Column, possessive: bool = True, on_case: bool = True, on_numerics: bool = True) -> Column:
    """Word and number parts of an array of strings, in the JVM: the delimiter with its defaults, without positions."""
    letters = r"\p{Lu}*[\p{L}\p{M}&&[^\p{Lu}]]+|\p{Lu}+" if on_case else r"[\p{L}\p{M}]+"
    expr = f"{letters}|\\p{{N}}+" if on_numerics else (r"[\p{N}\p{Lu}]*[\p{N}\p{L}\p{M}&&[^\p{Lu}]]+|[\p{N}\p{Lu}]+" if on_case else r"[\p{L}\p{M}\p{N}]+")

    def parts(t: Column) -> Column:
        bare = F.regexp_replace(t, r"(?<=[\p{L}\p{M}])'[sS](?![\p{L}\p{M}\p{N}])", " ") if possessive else t
        return F.regexp_extract_all(bare, F.lit(expr), F.lit(0))

    return F.flatten(F.transform(terms, parts))
