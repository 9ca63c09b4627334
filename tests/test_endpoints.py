import json

import pytest

from foliant.plans import endpoints as ep


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "walk walking", 5), (2, "Walk stop", 7)], "id int, text string, n int")


def test_term_lists(docs):
    got = ep.termlist_response({"d": docs}, {"field": "text", "sort": "-count", "result_limit": "2", "mode": 0})
    fields = {"d": {"text": {"indexOptions": "DOCS_AND_FREQS_AND_POSITIONS", "docValuesOptions": "FIELDDATA", "es_type": "text", "doc_count": 2, "term_count": 3, "term_lo": "stop", "term_hi": "walking"}}}
    assert got["response"] == {"count": "", "maxOccCount": 2, "itemCount": 3, "filteredItemCount": 3, "fields": fields, "terms": [{"t": "walk", "c": 2}, {"t": "stop", "c": 1}]}
    assert got["request"] == {"field": "text", "range": None, "filter": None, "not_filter": None, "count": "", "length": "", "result_limit": 2, "repl_expr": None, "collisions_only": True, "sort": "-count"}
    assert [t["t"] for t in ep.termlist_response({"d": docs}, {"field": "text", "count": "2.."})["response"]["terms"]] == ["walk"]
    got = ep.termlist_response({"d": docs}, {"field": "text", "repl_expr": "ing$/"})
    assert got["response"]["collisions"] == [dict(term=dict(t="walking", c=1), coll=dict(t="walk", c=2))] and got["response"]["collisionCount"] == 1
    several = ep.termlist_response({"d": docs}, {"field": "text", "repl_expr": "^s/||^w/", "collisions_only": "false", "sort": "-count", "result_limit": 2})["response"]
    assert [c["term"]["t"] for c in several["collisions"]] == ["walking", "walk"] and several["collisionCount"] == 3
    assert ep.termlist_response({"d": docs}, {"field": "text", "repl_expr": "^s/||^w/", "collisions_only": "false", "sort": "-term", "result_limit": 1})["response"]["collisions"][0]["term"]["t"] == "stop"
    assert ep.termlist_response({"d": docs}, {"term": "walk"})["response"]["term_fields"] == [{"index": "d", "field": "text", "count": 2}]
    assert ep.termlist_response({"d": docs}, {})["response"]["fields"]["d"]["n"] == {"indexOptions": "POINTS(1::4)", "docValuesOptions": "SORTED_NUMERIC", "es_type": "integer", "doc_count": 2, "term_count": 2, "term_lo": "5", "term_hi": "7"}
    for bad in ({"limit": 5}, {"collisions_only": "maybe"}, {"field": "text", "sort": "x"}, {"field": "text", "count": "a"}):
        with pytest.raises(ValueError):
            ep.termlist_response({"d": docs}, bad)


def test_views(docs):
    got = ep.view_response(docs, "id", {"id": 2, "postings": "true", "dense": True})
    assert [f["name"] for f in got["doc"]["indexedFields"]] == ["id", "n", "text"]
    assert got["doc"]["indexedFields"][2] == {"name": "text", "class": "StringType", "mappedType": "text", "mappedClass": "standard", "type": "DOCS_AND_FREQS_AND_POSITIONS", "dv-type": "FIELDDATA", "terms": ["walk", "stop"], "postings": {"walk": ["pos=0, offset=0..4"], "stop": ["pos=1, offset=5..9"]}, "docvalues": {"count": 1, "values": ["Walk stop"]}}
    assert got["request"] == {"field": None, "field_expr": None, "output": None, "output_lvl": 0, "postings": True, "dense": True, "offset": 0}
    assert "doc" not in ep.view_response(docs, "id", {"id": 3})
    other = docs.selectExpr("id", "'other' as text", "n").where("id = 1")
    both = {"a": docs, "b": other}
    assert ep.view_response(both, "id", {"id": 1})["doc"]["storedFields"][2]["value"] == "other" and ep.view_response(both, "id", {"id": 2})["doc"]["storedFields"][2]["value"] == "Walk stop"
    more = ep.view_response(docs, "id", {"id": 2, "field": "n", "output_lvl": 1})["doc"]
    assert more["storedFields"] == [{"name": "n", "value": "7", "value_num": 7.0, "value_bin": "[37]", "value_binstr": "7", "type": "integer", "class": "IntegerType"}]
    assert more["indexedFields"][0]["docvalues"] == {"count": 1, "values": ["7", "BIN: [37]"]}
    assert set(ep.view_response(docs, "id", {"id": 2, "output": "stored"})["doc"]) == {"storedFields"}
    json.dumps(got)


def test_caches_and_versions(spark):
    entries = spark.createDataFrame([("/indices/a/0/index/q1", 5), ("/indices/a/1/index/q1", 6)], "key string, bytes long")
    got = ep.cache_response(spark, {"dump_raw": True}, entries)
    assert got["index_caches"] == [{"index": "a", "caches": [{"query": "/q1", "ram": 11, "ram_pretty": "11 bytes"}]}] and len(got["raw_keys"]) == 2
    assert ep.cache_response(spark, {"index_expr": "null"}, entries)["index_caches"][0]["index"] == "_ALL"
    nodes = spark.createDataFrame([("a", "1", {"x": "1"}), ("b", "2", {"x": "1"})], "node string, version string, settings map<string, string>")
    got = ep.version_response(nodes)
    assert not got["all-versions-ok"] and got["version-diff"] == {"node": "b", "reason": "ES-Version"} and got["activeNodes"] == 2 and got["nodes"][1] == {"node": "b", "differences": {}}


def test_help_and_search_orders(spark):
    from foliant.operators.admin import help_response
    from foliant.plans import dsl
    from foliant.sources.tables import model

    assert help_response("text/javascript")["status"] == 200 and help_response(None)["headers"]["Location"]
    docs = model(spark.createDataFrame([("a", 1), ("a", 1), ("a", 1), ("b", 1), ("b", 2)], "k string, p long"), "p")
    parents = {"p": dsl.Parent(spark.range(1, 3).toDF("p"), "p")}
    run = lambda **terms: [tuple(r) for r in dsl.run(docs, {"aggs": {"x": {"terms": {"field": "k", **terms}, "aggs": {"n": {"bm_undup_by_parents": {"parent_paths": "p"}}}}}}, dsl.Schema(parents, {"p": "p"}, from_files=False)).aggs["x"].collect()]
    assert run() == [("a", 3, 1), ("b", 2, 2)] and run(order={"n": "desc"}, size=1) == [("b", 2, 2)] and run(order={"_key": "desc"}) == [("b", 2, 2), ("a", 3, 1)]
    for bad in ({"n": "down"}, {"m": "asc"}, ["n"], {"n": "asc", "_key": "asc"}):
        with pytest.raises(ValueError):
            run(order=bad)


def test_optional_clauses(spark):
    from foliant.operators.queries import Bool, Term, search
    from foliant.sources.tables import model

    docs = model(spark.createDataFrame([(1, "x", "p"), (2, "x", "q"), (3, "y", "p"), (4, None, None)], "id int, a string, b string"), "id")
    x, p = Term("a", "x"), Term("b", "p")
    found = lambda q: sorted(r.id for r in search(docs, q).collect())
    assert found(Bool(must=(x,), should=(p,))) == [1, 2] and found(Bool(should=(x, p))) == [1, 2, 3] and found(Bool()) == [1, 2, 3, 4]
    assert found(Bool(should=(x, p), minimum_should_match=2)) == [1] and found(Bool(must=(x,), should=(p,), minimum_should_match=1)) == [1] and found(Bool(should=(x,), minimum_should_match=2)) == []
