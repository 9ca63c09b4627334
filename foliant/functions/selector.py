"""Selection of names by a list and a regular expression."""

from __future__ import annotations

import re


class Selector:
    """``names``: a list split at ``,`` ``;`` ``|``; a leading ``!`` or ``-`` inverts it, alone it selects nothing.

    ``expr`` is searched anywhere in a name, inverted likewise; both must agree.  Names ignore case.
    """

    def __init__(self, names: str | None = None, expr: str | None = None):
        self.names, self.inverted = None, False
        if names:
            if names[0] in "!-":
                self.inverted, names = True, names[1:]
                if not names.strip():
                    self.names, self.inverted = set(), False
            if self.names is None:
                listed = {part.strip().lower() for part in re.split(r"[,;|]", names)} - {""}
                self.names = listed or None
        self.expr, self.expr_inverted = None, False
        if expr:
            if expr[0] in "!-":
                self.expr_inverted, expr = True, expr[1:]
            self.expr = re.compile(expr) if expr else None

    def selects(self, name: str) -> bool:
        low = name.lower()
        if self.names is not None and (low in self.names) == self.inverted:
            return False
        return self.expr is None or bool(self.expr.search(low)) != self.expr_inverted

    def of(self, names: list[str]) -> list[str]:
        return [n for n in names if self.selects(n)]
