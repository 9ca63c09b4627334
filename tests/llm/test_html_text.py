import collections
import os
import re
import time

import pytest

from foliant.llm import html_text as ht

FOLDER = "/root/testdata/sf0.01"
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "</p><p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">About us</a></li></ul></nav>
<div class="main"><h1>Title of the piece</h1><p>%s</p><p>Caf&eacute; &amp; more <b>bold</b> text, %s.</p></div>
<footer><a href="/x">Terms</a> &copy; someone</footer></body></html>""" % ("long sentence with words " * 20, "and again some words " * 15)


def slow(dom):
    """Densities by their definition, subtree by subtree."""
    n = len(dom.tag)
    inside = [[j for j in range(i, dom.end[i])] for i in range(n)]
    link = [any(dom.tag[k] in ("a", "button", "select") for k in _path(dom, i)) for i in range(n)]
    size = lambda nodes, only=False: sum(len(t.strip()) for k, t in dom.pieces if t != "\n" and k in nodes and (link[k] or not only))
    import math

    body = dom.tag.index("body") if "body" in dom.tag else 0
    ratio = size(set(inside[body]), True) / (size(set(inside[body])) or 1)
    out = []
    for i in range(n):
        s = set(inside[i])
        c, lc, t, lt = size(s), size(s, True), len(s) - 1, sum(dom.tag[j] in ("a", "button", "select") for j in s if j != i)
        if not c:
            out.append(0.0)
            continue
        base = math.log(c / max(c - lc, 1) * lc + ratio * c + math.e)
        out.append(c / (t or 1) * math.log(c / (lc or 1) * (t or 1) / (lt or 1)) / max(math.log(base), ht.LEAST_BASE))
    return out


def _path(dom, i):
    while i >= 0:
        yield i
        i = dom.parent[i]


def test_densities_by_definition():
    for page in (PAGE, "<p>a<p>b<ul><li>c<li><a>d</a></ul>", "no markup", "<body><div><a>only link</a></div>"):
        dom = ht.Dom(page)
        density, total = ht.densities(dom)
        assert density == pytest.approx(slow(dom))
        for i in range(len(dom.tag)):
            assert total[i] == pytest.approx(sum(density[j] for j in range(1, len(dom.tag)) if dom.parent[j] == i))


def test_main_text():
    text = ht.main_text(PAGE)
    assert text.startswith("Title of the piece\nlong sentence") and "Café & more bold text" in text
    assert not any(x in text for x in ("Home", "Terms", "var a", "p{}"))


@pytest.mark.parametrize("page", ["", " ", "<", "<<<>>>", "</p></div>", "<p", "<a href='x>y", "<!-- open", "<script>x", "<div " * 50, "<![CDATA[x", "<br/><br>", "&#xD800; &bogus; &", "<table><tr><td>a<td>b<tr><td>c</table>"])
def test_broken_markup(page):
    assert isinstance(ht.main_text(page), str)


def test_deep_and_long_pages():
    deep = "<div>" * 20000 + "words in the middle of it" + "</div>" * 20000
    assert ht.main_text(deep) == "words in the middle of it"
    assert len(ht.main_text("<body><p>" + "word " * 200000)) > 900000


def test_dom():
    dom = ht.Dom("<body><ul><li>a<li>b<ul><li>c</ul></ul><p>d<div>e</div>")
    assert [(t, dom.tag[p]) for t, p in zip(dom.tag[1:], dom.parent[1:])] == [("body", "#"), ("ul", "body"), ("li", "ul"), ("li", "ul"), ("ul", "li"), ("li", "ul"), ("p", "body"), ("div", "body")]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
def test_pages_hold_the_documents_that_they_show(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    shown = ht.extract(pages, keep=("url",)).selectExpr(r"cast(regexp_extract(url, '/([0-9]+)', 1) as long) as doc_id", "text as found")
    rows = shown.join(spark.read.parquet(f"{FOLDER}/documents.parquet"), "doc_id").collect()

    def f1(a, b):
        a, b = (collections.Counter(re.findall(r"\w+", t)) for t in (a, b))
        return 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values()))

    scores = sorted(f1(r.found, r.text) for r in rows)
    assert sum(scores) / len(scores) > 0.88 and scores[len(scores) // 10] > 0.75


def test_odd_rows(odd, empty, spark):
    pages = spark.createDataFrame([(None, PAGE, "t"), (1, None, "t"), (2, "", None), (3, PAGE, "t"), (3, PAGE, "t")], "page_id long, html string, text string")
    got = ht.extract(pages).collect()
    assert sorted((r.page_id or 0, len(r.text or "")) for r in got)[1:3] == [(1, 0), (2, 0)] and [r.text for r in got if r.page_id == 1] == [None]
    assert len({r.text for r in got if r.page_id in (3, None)}) == 1
    assert ht.extract(odd, "text", ("doc_id",)).count() == odd.count() and ht.extract(empty, "text", ("doc_id",)).count() == 0


@pytest.mark.parametrize("make", [
    lambda k: "<a " * k, lambda k: "<div>" * k + "</b>" * k, lambda k: "<a '>'" * k + "'", lambda k: "<!" * k, lambda k: "<b>" * k + "<p></p>" * k, lambda k: "<div>" * k + "<li></li>" * k,
    lambda k: "<div><p>text here</p></div>" * k, lambda k: "<b><table>" + "<div>" * k + "</b>" * k, lambda k: "<!--" * k, lambda k: "<b" * k + "<!", lambda k: "<div>" * k + "<body>" * k, lambda k: ">" + "<b <! " * k])
def test_time_is_linear_in_broken_markup(make):
    took = []
    for k in (10_000, 40_000):
        page = make(k)
        began = time.process_time()
        ht.main_text(page)
        took.append(time.process_time() - began)
    assert took[1] < 10 and took[1] < 0.2 + 8 * took[0]  # 4 if linear, 16 if quadratic


def test_where_tags_end():
    for page, wanted in (("<a 'x>y' >z", 9), ("<a 'x>y", -1), ("<a \"'\" '\"' >", 11), ("<a >", 3)):
        assert ht._Ends(page).after(2) == wanted


def test_kept_columns_named_like_results(spark):
    df = spark.createDataFrame([("<p>a b c</p>", "old")], "html string, Text string")
    assert ht.extract(df, keep=("Text",)).collect() == [("old", "a b c")]
