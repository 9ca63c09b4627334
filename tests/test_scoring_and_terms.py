import math

import pytest
from pyspark.sql import functions as F

from foliant.operators import admin, similarity, termlist, view
from foliant.operators.diagnostics import parse_ext, with_diagnostics
from foliant.operators.similarity import Settings
from foliant.operators.termlist import Mapping, Request

SCORES = [
    (1, 1, {}, 1.2), (1, 3, {}, 1.073385), (2, 3, {}, 1.14919), (9, 3, {}, 1.2), (1, 100, {}, 1.020386), (300, 1000, {}, 1.16049),
    (1, 3, dict(force_tf=2), 1.14919), (1, 3, dict(boost=2.0), 2.146769), (1, 3, dict(max_idf=1.0, n=10, df=5), 1.421275),
]


@pytest.mark.parametrize("freq, length, options, wanted", SCORES)
def test_scores(spark, freq, length, options, wanted):
    settings = Settings(max_idf=options.get("max_idf", 0.0), force_tf=options.get("force_tf", -1))
    c = similarity.score(F.lit(freq), F.lit(length), F.lit(options.get("n", 1)), F.lit(options.get("df", 1)), settings, options.get("boost", 1.0))
    assert spark.range(1).select(F.round(c, 6).alias("s")).head().s == pytest.approx(wanted)


@pytest.mark.parametrize("most, df, wanted", [(1.0, 1, 2.0), (1.0, 5, 1.34789), (1.0, 10, 1.023348), (0.5, 5, 1.173945)])
def test_idf(spark, most, df, wanted):
    c = similarity.idf(F.lit(10), F.lit(df), Settings(max_idf=most))
    assert spark.range(1).select(F.round(c, 6).alias("s")).head().s == pytest.approx(wanted)


def test_scored_rows(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (3, ["c"]), (4, [])], "id int, t array<string>")
    got = {r.id: r.score for r in similarity.scored(docs, "t", ["a", "b"]).collect()}
    assert got[1] == pytest.approx(2 + 0.2 * (math.log(2.6) + math.log(1.6)) / math.log(3.6)) and got[2] == pytest.approx(1.2) and set(got) == {1, 2}
    explained = similarity.scored(docs, "t", ["a"], Settings(max_idf=1.0), boosts={"a": 3.0}, explain=True).head().explanation[0]
    assert (explained.term, explained.boost, explained.freq, explained.df, explained.idf) == ("a", 3.0, 2, 1, pytest.approx(2.0))
    with_phrase = similarity.scored(docs, "t", ["a", "b"], Settings(max_idf=1.0), phrase=True, explain=True).where("id = 1").head().explanation
    assert [e.df for e in with_phrase] == [2, 2]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "walk walking b", ["x"], 5), (2, "Walk stop stopped", ["x", "y"], 5), (3, None, None, None), (4, "\U0001f600 walk", [], 7)], "id int, text string, tags array<string>, n int")


def _listed(docs, **options):
    request = Request(**({"field": "text"} | options))
    return {r.term: r["count"] for r in termlist.term_list(docs, request, Mapping({"text": "standard"})).collect()}


def test_term_filters(docs):
    assert _listed(docs) == {"walk": 3, "walking": 1, "b": 1, "stop": 1, "stopped": 1}
    assert _listed(docs, filter="^w", not_filter="ing") == {"walk": 3}
    assert _listed(docs, length="4..5") == {"walk": 3, "stop": 1}
    assert _listed(docs, range="stop..walk") == {"stop": 1, "stopped": 1}
    assert _listed(docs, count="2..") == {"walk": 3}
    assert _listed(docs, field="n", length="9") == {5: 2, 7: 1}
    assert _listed(docs, field="n", range="5") == {5: 2}
    assert _listed(docs, field="TAGS,text", range="x..z") == {"x": 2, "y": 1}
    with pytest.raises(ValueError):
        _listed(docs, field="nothing")
    with pytest.raises(ValueError):
        _listed(docs, field="n,text")


def test_utf16_lengths(spark):
    rows = spark.createDataFrame([("a\U0001f600",), ("ab",), ("",)], "t string")
    assert [r.n for r in rows.select(termlist.utf16_length(F.col("t")).alias("n")).collect()] == [3, 2, 0]


def test_term_order_and_limit(docs):
    def order(sort, limit=3):
        request = Request(field="text", sort=sort, result_limit=limit)
        return [r.term for r in termlist.ranked(termlist.term_list(docs, request), request).orderBy("rank").collect()]

    assert order("term") == ["walking", "walk", "stopped"] and order("-TERM") == ["b", "stop", "stopped"]
    assert order("count") == ["b", "stop", "stopped"] and order("-count") == ["walk", "b", "stop"]
    assert len(order("term", 0)) == 5
    with pytest.raises(ValueError):
        Request(sort="size")


def test_collisions(docs):
    request = Request(field="text", repl_expr="(ing|ped)$/||^b$/none")
    listed = termlist.term_list(docs, request)
    assert {tuple(r) for r in termlist.collisions(listed, request).collect()} == {("walking", 1, "walk", 3), ("stopped", 1, "stop", 1)}
    every = Request(field="text", repl_expr="(ing|ped)$/||^b$/none", collisions_only=False)
    assert ("b", 1, "none", 0) in {tuple(r) for r in termlist.collisions(listed, every).collect()}
    same = Request(field="text", repl_expr="^walk$/walk")
    assert {tuple(r) for r in termlist.collisions(listed, same).collect()} == {("walk", 3, "walk", 3)}


def test_field_catalog(docs):
    got = {r.field: (r.type, r.doc_count, r.term_count, r.lo, r.hi) for r in termlist.field_catalog({"d": docs}).collect()}
    assert got == {"id": ("integer", 4, 4, "1", "4"), "n": ("integer", 3, 2, "5", "7"), "tags": ("text", 2, 2, "x", "y"), "text": ("text", 3, 5, "b", "walking")}
    parts = termlist.field_catalog({"d": docs.where("id < 2")}).union(termlist.field_catalog({"d": docs.where("id >= 2")}))
    assert {r.field: (r.doc_count, r.term_count) for r in termlist.combined_stats(parts).collect()}["text"] == (3, 3)
    assert [tuple(r) for r in termlist.term_fields({"d": docs}, "walk").collect()] == [("d", "text", 3)]


def test_views(docs):
    one = view.lookup(docs, "id", 2)
    assert [tuple(r) for r in view.stored(one.drop("tags")).collect()] == [("id", "2", 2.0), ("n", "5", 5.0), ("text", "Walk stop stopped", None)]
    assert [r.term for r in view.indexed(one, "text").orderBy("ord").collect()] == ["walk", "stop", "stopped"]
    dense = {r.term: r.postings for r in view.postings(one, "text", dense=True).collect()}
    assert dense == {"walk": ["pos=0, offset=0..4"], "stop": ["pos=1, offset=5..9"], "stopped": ["pos=2, offset=10..17"]}
    values = {r.field: (r["count"], r["values"]) for r in view.docvalues(one).collect()}
    assert values["tags"] == (2, ["x", "y"]) and values["n"] == (1, ["5"])
    after = view.lookup(docs, "id", 2, 1, F.lit("s"), F.col("id"))
    assert after.head().id == 3
    assert view.lookup(docs, "id", 4, 1, F.lit("s"), F.col("id")).count() == 0
    assert view.lookup(docs, "id", 99).count() == 0
    assert view.field_order(["_b", "a", "_a", "c"]) == ["a", "c", "_a", "_b"]


def test_diagnostics(docs):
    assert parse_ext({"_bm": {}}) and parse_ext({"_bm": None}) and not parse_ext({"_bm": {"diagnostics": False}}) and not parse_ext(None)
    with pytest.raises(ValueError):
        parse_ext({"_bm": {"other": 1}})
    bm = with_diagnostics(docs.where("id = 1"), "id:1", "d", from_files=False).head()._bm
    assert (bm["index"], bm["query"], bm.docvalues["n"]) == ("d", "id:1", "5")


def test_cache_report(spark):
    entries = spark.createDataFrame([("idx sh  \x01body", 10), ("idx sh body", 5), ("x", 1)], "key string, bytes long")
    got = {(r["index"], r["query"]): r.ram for r in admin.cache_report(entries, "request").collect()}
    assert got == {("idx sh", "body"): 15, ("?", "x"): 1}
    assert {r["index"] for r in admin.cache_report(entries, "request", index_expr=None).collect()} == {"_ALL"}
    assert [r.ram for r in admin.cache_report(entries, "bitset", sort="size").collect()] == [10, 5, 1]
    for bad in (dict(kind="other"), dict(sort="other")):
        with pytest.raises(ValueError):
            admin.cache_report(entries, **bad)
    assert admin.cache_dump(spark).columns == ["key", "bytes"]


def test_versions(spark):
    nodes = spark.createDataFrame([("b", "1", {"x": "1", "node.name": "b"}), ("a", "1", {"x": "1", "y": "2", "node.name": "a"}), ("c", "2", {"x": "1", "y": "2", "z": "3"}), ("a", "9", {})], "node string, version string, settings map<string, string>").coalesce(1)
    got = {r.node: (r.differences, r.reason) for r in admin.version_report(nodes).collect()}
    assert got == {"a": ({}, None), "b": ({"y": "2 | -"}, None), "c": ({}, "ES-Version")}
    assert tuple(admin.version_summary(nodes).head()) == (3, False, True)
    assert "termlist" in admin.help_page()["operations"] and admin.node_settings(spark).count() == 1


def test_field_catalog_of_odd_fields(spark):
    rows = [(1, None, [3, 1], -1.5, True, b"\x01"), (2, "", [], 2.5, None, None), (3, "Zed a", None, None, False, b"\xff"), (4, "a", [10], -1.5, None, None)]
    df = spark.createDataFrame(rows, "id int, text string, many array<int>, x double, ok boolean, raw binary").withColumn("none", F.lit(None).cast("long")).withColumn("day", F.expr("timestamp_ntz'2020-01-02' + make_dt_interval(id)"))
    got = {r.field: (r.type, r.doc_count, r.term_count, r.lo, r.hi) for r in termlist.field_catalog({"t": df, "e": df.where("1 = 0").select("id")}).where("index = 't'").collect()}
    assert got == {
        "id": ("integer", 4, 4, "1", "4"), "text": ("text", 2, 2, "a", "zed"), "many": ("integer", 2, 3, "1", "10"), "x": ("double", 3, 2, "-1.5", "2.5"), "ok": ("boolean", 2, 2, "false", "true"),
        "raw": ("binary", 2, 2, "[01]", "[FF]"), "none": ("long", 0, 0, None, None), "day": ("date", 4, 4, "2020-01-03T00:00:00.000Z", "2020-01-06T00:00:00.000Z")}
    assert [r.doc_count for r in termlist.field_catalog({"e": df.where("1 = 0").select("id")}).collect()] == [0]


def test_explanations(spark):
    docs = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["b"])], "id int, t array<string>")
    plain = similarity.scored(docs, "t", ["a"], explain=True).head().explanation[0]
    assert plain.description == "tfBoost (tf=2.0, fieldlen=3, maxTf=0.20, forceTf=-1.0, bias=0.60)" and plain.details == []
    boosted = similarity.scored(docs, "t", ["a"], boost=2.0, explain=True, parent_term="p").head().explanation[0]
    assert boosted.description == "p/Combined from:" and [x.description for x in boosted.details] == [plain.description, "*= boost=2.000"] and boosted.details[0].value == pytest.approx(plain.score)
    full = similarity.scored(docs, "t", ["a", "b"], Settings(max_idf=1.0), explain=True).where("id = 2").head().explanation
    assert full[0].description is None and [x.description.split(" ")[0] for x in full[1].details] == ["tfBoost", "+="]


def test_overlaps_count_only_if_wanted(spark):
    docs = spark.createDataFrame([(1, [("a", 1), ("x", 0), ("b", 1)])], "id int, t array<struct<term: string, pos_inc: int>>")
    for settings, n in ((Settings(), 2), (Settings(discount_overlaps=False), 3)):
        got = similarity.scored(docs, "t", ["a"], settings).head().score
        assert got == pytest.approx(1 + 0.2 * math.log(1.6) / math.log(0.6 + n))
