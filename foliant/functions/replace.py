"""Regular-expression replacement and extraction, written as ``expr/replacement``.

A slash inside either part is doubled.  Replacements may be chained with ``||``.  A replacement gives null for
text in which nothing matches.  Expressions are Java's, unanchored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_replacement(text: str) -> tuple[str, str]:
    """Expression and replacement of ``expr/replacement``."""
    parts = [p.replace("\0", "/") for p in text.replace("//", "\0").split("/")]
    if len(parts) != 2 or not parts[0]:
        raise ValueError(f"not an expression and a replacement with one slash between them: {text!r}")
    return parts[0], parts[1]


def parse_chain(text: str) -> list[tuple[str, str]]:
    return [parse_replacement(part) for part in text.split("||")]


def parse_template(text: str | None) -> list[str | int]:
    """Constants and group numbers of a template; ``$$`` is a dollar, ``$0`` to ``$9`` are groups.

    A constant directly before a group is dropped, as the engine that this agrees with does.
    """
    parts: list[str | int] = []
    constant, i = "", 0
    text = text or ""
    while i < len(text):
        following = text[i + 1 : i + 2]
        if text[i] == "$" and following == "$":
            parts.append(constant + "$")
            constant, i = "", i + 2
        elif text[i] == "$" and following.isdigit() and following.isascii():
            parts.append(int(following))
            constant, i = "", i + 2
        else:
            constant, i = constant + text[i], i + 1
    return [*parts, constant] if constant else parts


def replaced(value: Column, chain: str) -> Column:
    """All replacements in turn; null where none of them matched."""
    current, any_ = value, F.lit(False)
    for expr, new in parse_chain(chain):
        matched = current.rlike(expr)
        any_ = any_ | matched
        current = F.when(matched, F.regexp_replace(current, expr, new)).otherwise(current)
    return F.when(any_, current)


def extracted(value: Column, expr: str, template: str) -> Column:
    """The template filled from the first match; null without a match, ``''`` for an empty template."""
    parts = [F.lit(p) if isinstance(p, str) else F.regexp_extract(value, expr, p) for p in parse_template(template)]
    return F.when(value.rlike(expr), F.concat(F.lit(""), *parts))


def extracted_by(value: Column, replacement: str) -> Column:
    """``extracted`` with expression and template written as ``expr/template``."""
    return extracted(value, *parse_replacement(replacement))


def remainder(value: Column, replacement: str) -> Column:
    """What follows the first match of the expression; the whole text without one."""
    expr, _ = parse_replacement(replacement)
    return F.when(value.rlike(expr), F.regexp_replace(value, f"^[\\s\\S]*?(?:{re.sub(r'(?<!\\)\((?!\?)', '(?:', expr)})", "")).otherwise(value)
