"""Main text of web pages by composite text density.

For every node of a page's DOM: characters ``C``, tags ``T``, characters and tags of links ``LC`` and ``LT`` in
its subtree, characters outside links ``C - LC``.  With ``b`` for the body, its density is

    C / T * log((C / LC) * (T / LT)) / log(log(C / (C - LC) * LC + LC_b / C_b * C + e))

where a count of 0 divides as 1 and the denominator is at least ``LEAST_BASE``.  A node's density sum is the sum of
its children's densities.  The smallest density on the path from the body to the node with the largest sum is the
threshold: from the body down, each node that reaches it yields the subtree with the largest sum below it.

Results for odd inputs: a null page has a null text, an empty one or one without text an empty text; markup of
any kind is read as far as it goes (unclosed and unopened tags, broken attributes, text outside the body);
scripts, styles, comments and heads hold no text; pages of any length and depth are read whole, in time linear in
their length whatever their markup; ties between sums go to the first node; repeated rows get equal results; an
empty table gives an empty result; only the named columns are read; a kept column named ``text`` gets an
underscore behind its name.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.session import kept, small_batches, table

LEAST_BASE = 0.05
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_SPECIAL = re.compile(r"[>\"']")
_RAW = {"script", "style", "textarea", "title", "noframes", "iframe", "noembed", "xmp"}
_HIDDEN = {"script", "style", "head", "title", "template", "noframes", "iframe", "noembed", "textarea", "select", "svg", "math", "object"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
_ENDS_P = {"address", "article", "aside", "blockquote", "center", "details", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}}
_BOUND = ("body", "html", "table")


class _Ends:
    """Where tags end, for pages in which a tag's quotes don't close: one pass over a page's ``>`` and quotes, from the end."""

    def __init__(self, page: str):
        self.at: list[int] = []
        kinds: list[str] = []
        for m in _SPECIAL.finditer(page):
            self.at.append(m.start())
            kinds.append(m[0])
        self.closed = [-1] * (len(kinds) + 1)
        following = {"'": -1, '"': -1}
        for i in range(len(kinds) - 1, -1, -1):
            kind = kinds[i]
            if kind == ">":
                self.closed[i] = self.at[i]
            else:
                if following[kind] >= 0:
                    self.closed[i] = self.closed[following[kind] + 1]
                following[kind] = i

    def after(self, place: int) -> int:
        """The first ``>`` from a place on that isn't within quotes, -1 for none."""
        return self.closed[bisect_left(self.at, place)]


class Dom:
    """A page's nodes in document order: tag, parent, end of subtree, and pieces of text with their nodes.

    Time is linear in the page whatever its markup: depths of open nodes are kept by name, so that no end tag or
    implied end searches the stack, and what doesn't close is found to be so once.
    """

    def __init__(self, page: str):
        self.tag, self.parent, self.end = ["#"], [-1], [0]
        self.pieces: list[tuple[int, str]] = []  # the node, text; "\n" where a block begins or ends
        tags, parents, ends_at, pieces = self.tag, self.parent, self.end, self.pieces
        stack, hidden, at, n = [0], 0, 0, len(page)
        open_at: dict[str, list[int]] = {}  # depths of open nodes by name
        solid = [0]  # depths of those that aren't inline
        last = page.rfind(">")
        strict: _Ends | None = None

        def close(depth: int) -> None:
            nonlocal hidden
            while len(stack) > depth:
                node = stack.pop()
                name = tags[node]
                open_at[name].pop()
                ends_at[node] = len(tags)
                if name in _HIDDEN:
                    hidden -= 1
                if name not in _INLINE:
                    solid.pop()
                    pieces.append((stack[-1], "\n"))

        def text(lo: int, hi: int) -> None:
            found = page[lo:hi]
            if "&" in found:
                found = html.unescape(found)
            core = " ".join(found.split())
            if not core:
                core = " " if found else ""
            else:
                core = " " * found[0].isspace() + core + " " * found[-1].isspace()
            pieces.append((stack[-1], core))

        begin = 0  # of the text before the next markup
        while True:
            lt = page.find("<", at)
            if lt < 0:
                break
            m = None
            mark = page[lt + 1 : lt + 2]
            if mark == "!" or mark == "?":
                if page.startswith("<!--", lt):
                    stop = page.find("-->", lt + 4)
                    stop = n if stop < 0 else stop + 3
                elif page.startswith("<![CDATA[", lt):
                    stop = page.find("]]>", lt + 9)
                    inner, stop = (n, n) if stop < 0 else (stop, stop + 3)
                elif lt < last:
                    stop = page.find(">", lt) + 1
                else:
                    at = lt + 1
                    continue
            elif lt > last:
                at = page.find("<!", lt)  # only comments can follow the last ">"
                if at < 0:
                    break
                continue
            else:
                m = _TAG.match(page, lt) if strict is None else None
                if m is None:
                    m = _NAME.match(page, lt)
                    if m is None:
                        at = lt + 1
                        continue
                    strict = strict or _Ends(page)
                    stop = strict.after(m.end()) + 1 or page.find(">", m.end()) + 1
                else:
                    stop = m.end()
            if lt > begin and not hidden:
                text(begin, lt)
            at = begin = stop
            if m is None:
                if mark == "!" and page.startswith("[CDATA[", lt + 2) and inner > lt + 9 and not hidden:
                    text(lt + 9, inner)
                continue
            name = m[2].lower()
            if m[1]:
                if name in _VOID:
                    if name == "br":
                        pieces.append((stack[-1], "\n"))
                    continue
                own = open_at.get(name)
                if own and (name in _BOUND or all(not open_at.get(b) or open_at[b][-1] < own[-1] for b in _BOUND)):
                    close(own[-1])
                continue
            if name in _ENDS:
                stop_at = max((open_at[s][-1] for s in _SCOPE.get(name, ("table",)) if open_at.get(s)), default=0)
                found = len(stack)
                for other in _ENDS[name]:
                    own = open_at.get(other)
                    if own and own[-1] > stop_at:
                        found = min(found, own[bisect_right(own, stop_at)])
                close(found)
            elif name in _ENDS_P and tags[stack[solid[-1]]] == "p":
                close(solid[-1])
            if name == "body" and open_at.get("head"):
                close(open_at["head"][0])
            node = len(tags)
            tags.append(name)
            parents.append(stack[-1])
            ends_at.append(node + 1)
            inline = name in _INLINE
            if not inline:
                pieces.append((stack[-1], "\n"))
            if name in _VOID:
                continue
            depth = len(stack)
            stack.append(node)
            if name in open_at:
                open_at[name].append(depth)
            else:
                open_at[name] = [depth]
            if not inline:
                solid.append(depth)
            if name in _HIDDEN:
                hidden += 1
            if name in _RAW:
                tail = re.compile(f"</{re.escape(name)}[\\s/>]", re.IGNORECASE).search(page, at)
                close_at = tail.start() if tail else n
                if close_at > at and not hidden:
                    text(at, close_at)
                at = begin = close_at
        if n > begin and not hidden:
            text(begin, n)
        close(1)
        self.end[0] = len(self.tag)

    def text(self, spans: list[tuple[int, int]]) -> str:
        """Text of the nodes in ``spans``, a line per block, blanks collapsed."""
        inside = bytearray(len(self.tag))
        for lo, hi in spans:
            inside[lo:hi] = b"\1" * (hi - lo)
        lines: list[str] = []
        line: list[str] = []
        for node, piece in self.pieces:
            if piece == "\n" or not inside[node]:
                if line:
                    lines.append(" ".join("".join(line).split()))
                    line = []
            else:
                line.append(piece)
        if line:
            lines.append(" ".join("".join(line).split()))
        return "\n".join(x for x in lines if x)


_LINKS = {"a", "button", "select"}


def densities(dom: Dom) -> tuple[list[float], list[float]]:
    """Composite text density and density sum of every node."""
    n = len(dom.tag)
    parent = dom.parent
    c, t, lc, lt = [0] * n, [0] * n, [0] * n, [0] * n
    link = [tag in _LINKS for tag in dom.tag]
    in_link = link[:]
    for i in range(1, n):
        if in_link[parent[i]]:
            in_link[i] = True
    for node, piece in dom.pieces:
        if piece != "\n":
            size = len(piece.strip())
            c[node] += size
            if in_link[node]:
                lc[node] += size
    body = dom.tag.index("body") if "body" in dom.tag else 0
    for i in range(n - 1, 0, -1):
        p = parent[i]
        c[p] += c[i]
        t[p] += t[i] + 1
        lc[p] += lc[i]
        lt[p] += lt[i] + link[i]
    ratio = lc[body] / (c[body] or 1)
    density = [0.0] * n
    log, e = math.log, math.e
    for i, chars in enumerate(c):
        if chars:
            linked, tags = lc[i], t[i] or 1
            inner = log(chars / max(chars - linked, 1) * linked + ratio * chars + e)
            density[i] = chars / tags * log(chars / (linked or 1) * (tags / (lt[i] or 1))) / max(log(inner), LEAST_BASE)
    total = [0.0] * n
    for i in range(1, n):
        total[parent[i]] += density[i]
    return density, total


def main_text(page: str) -> str:
    """The main text of one page."""
    dom = Dom(page)
    density, total = densities(dom)
    parent, n = dom.parent, len(dom.tag)
    body = dom.tag.index("body") if "body" in dom.tag else 0
    # the largest sum in each subtree, and the first node that has it
    most = list(range(n))
    for i in range(n - 1, 0, -1):
        p = parent[i]
        own, other = most[i], most[p]
        if total[own] > total[other] or (total[own] == total[other] and own < other):
            most[p] = own
    node, threshold = most[body], density[body]
    while node != body and node > 0:
        threshold = min(threshold, density[node])
        node = parent[node]
    # from the body down: nodes whose parent reaches the threshold are looked at, in document order
    spans: list[tuple[int, int]] = []
    taken, open_ = bytearray(n), bytearray(n)
    open_[body] = 1
    for i in range(body, dom.end[body]):
        if not (open_[i] or open_[parent[i]] == 2) or taken[i]:
            continue
        if density[i] >= threshold and density[i] > 0:
            open_[i] = 2
            best = most[i]
            if not taken[best] and (total[best] > 0 or best == i):
                spans.append((best, dom.end[best]))
                taken[best : dom.end[best]] = b"\1" * (dom.end[best] - best)
    return dom.text(spans)


@F.arrow_udf(T.StringType())
def extracted(pages: pa.Array) -> pa.Array:
    """The main text of a page."""
    return pa.array([None if p is None else main_text(p) for p in pages.to_pylist()], pa.string())


def extract(df: DataFrame, page: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The columns ``keep``, and ``text``; one row per row of ``df``."""
    small_batches()
    return df.select(*kept(df, keep, ("text",)), extracted(F.col(page)).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
