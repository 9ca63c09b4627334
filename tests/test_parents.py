import pytest
from pyspark.sql import functions as F

from foliant.operators.parents import Parent, parse_path, terms, undup
from foliant.operators.queries import AllowNested, Bool, Fuzzy, MatchAll, MatchDeleted, MatchNested, Term, search
from foliant.plans import dsl
from foliant.sources.tables import model, with_nested

LINES = [("l1", "o1", "A"), ("l2", "o1", "A"), ("l3", "o2", "A"), ("l4", "o2", "R"), ("l5", "o3", "R"), ("l6", None, "A"), ("l7", "o9", "R")]


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame(LINES, "line string, order_key string, flag string")


def _parents(spark, c1=True):
    orders = spark.createDataFrame([("o1", "c1", True), ("o2", "c1", True), ("o3", "c2", False)], "id string, customer_key string, live boolean")
    customers = spark.createDataFrame([("c1", c1), ("c2", True)], "id string, live boolean")
    return {"order": Parent(orders, "id", F.col("live")), "customer": Parent(customers, "id", F.col("live"))}


KEYS = {"order": "order_key", "customer": "customer_key"}


@pytest.mark.parametrize("path, compensate, c1, wanted", [
    ("order", True, True, {"A": 2, "R": 1}), ("order", False, True, {"A": 2, "R": 3}),
    ("order,customer", True, True, {"A": 1, "R": 1}), ("order,customer", False, True, {"A": 1, "R": 1}),
    ("order;customer", True, False, {"A": 0, "R": 0}), ("order,customer", False, False, {"A": 1, "R": 1}),
])
def test_counts(spark, lines, path, compensate, c1, wanted):
    got = undup(lines, "flag", path, _parents(spark, c1), KEYS, compensate_non_existing=compensate)
    assert {r.flag: r.doc_count for r in got.collect()} == wanted


def test_paths():
    assert parse_path(" a ,; b") == ["a", "b"]
    for bad in (None, "", " , ", "a,_nested_"):
        with pytest.raises(ValueError):
            parse_path(bad)


def test_resilience_and_empty_buckets(spark, lines):
    with pytest.raises(ValueError):
        undup(lines, "flag", "nothing", _parents(spark), KEYS)
    assert {tuple(r) for r in undup(lines, "flag", "nothing", _parents(spark), KEYS, resilient=True).collect()} == {("A", 0), ("R", 0)}
    buckets = spark.createDataFrame([("A",), ("Z",)], "flag string")
    assert {tuple(r) for r in undup(lines, "flag", "order", _parents(spark), KEYS, buckets=buckets).collect()} == {("A", 2), ("Z", 0)}
    assert undup(lines.where("1 = 0"), "flag", "order", _parents(spark), KEYS).count() == 0


def test_array_buckets(spark):
    rows = spark.createDataFrame([("o1", ["x", "y"]), ("o2", ["x"]), ("o1", [])], "order_key string, tags array<string>")
    got = undup(rows, "tags", "order", _parents(spark), KEYS)
    assert {tuple(r) for r in got.collect()} == {("x", 2), ("y", 1)}
    assert [tuple(r) for r in terms(rows, "tags", 1).collect()] == [("x", 2)]


@pytest.fixture(scope="module")
def nested(spark):
    rows = spark.createDataFrame([(1, "o1", True, [("p", 1), ("q", 2)]), (2, "o2", True, [("p", 3), ("p", 4)]), (3, "o2", False, [("q", 5)]), (4, None, True, None)], "id int, order_key string, alive boolean, parts array<struct<kind: string, n: int>>")
    return with_nested(model(rows, "id", F.col("alive")), "parts")


def test_nested_counts(spark, nested):
    hits = search(nested, MatchNested())
    assert {tuple(r) for r in undup(hits, "kind", "_nested_", {}, {}).collect()} == {("p", 2), ("q", 1)}
    assert {tuple(r) for r in undup(hits, "kind", "_nested_,order,customer", _parents(spark), KEYS).collect()} == {("p", 1), ("q", 1)}
    roots = nested.where("_path is null").select("_root", "order_key")
    by_root = undup(hits.drop("order_key"), "kind", "_nested_,order", _parents(spark), KEYS, roots=roots)
    assert {tuple(r) for r in by_root.collect()} == {("p", 2), ("q", 1)}


def _ids(rows):
    return sorted((r.id, r.n or 0) for r in rows.collect())


def test_queries(nested):
    assert _ids(search(nested, MatchAll())) == [(1, 0), (2, 0), (4, 0)]
    assert _ids(search(nested, MatchNested(Term("kind", "p")))) == [(1, 1), (2, 3), (2, 4)]
    assert _ids(search(nested, AllowNested(Term("id", 1)))) == [(1, 0), (1, 1), (1, 2)]
    assert _ids(search(nested, MatchDeleted())) == _ids(search(nested, Fuzzy())) == [(3, 0)]
    assert _ids(search(nested, MatchDeleted(Term("id", 1)))) == []
    assert _ids(search(nested, Bool(must=(Term("order_key", "o2"),)))) == [(2, 0)]
    assert _ids(search(nested, Bool(must_not=(Term("order_key", "o2"),)))) == [(1, 0), (4, 0)]


def test_bodies(spark, nested):
    schema = dsl.Schema(_parents(spark), KEYS, from_files=False)
    orders = dict(bm_undup_by_parents=dict(parent_paths="_nested_,order"))
    body = dict(query=dict(bm_match_nested={}), aggs=dict(k=dict(terms=dict(field="kind"), aggs=dict(orders=orders))), ext=dict(_bm={}))
    out = dsl.run(nested, body, schema)
    assert sorted(tuple(r) for r in out.aggs["k"].collect()) == [("p", 3, 2), ("q", 1, 1)]
    assert out.hits.select("_bm.docvalues").head().docvalues["kind"] in "pq"
    request = dsl.UndupRequest.parse({"parent_paths": "a", "compensate_non_existing": False})
    assert dsl.UndupRequest.parse(request.body()) == request


@pytest.mark.parametrize("body", [{"no_such": {}}, {"bm_allow_nested": {}}, {"bm_match_deleted": 5}, {"bm_match_nested": {"boost": 2}}, {"term": {}}, {}, {"match_all": {"x": 1}}])
def test_bad_queries(body):
    with pytest.raises(ValueError):
        dsl.parse_query(body)


@pytest.mark.parametrize("body", [{}, {"parent_paths": "a", "more": 1}, {"parent_paths": "a", "resilient": "yes"}])
def test_bad_aggregations(body):
    with pytest.raises(ValueError):
        dsl.UndupRequest.parse(body)


def test_null_buckets_keys_and_parents(spark):
    """A bucket of which no row leads to a parent counts 0; repeated and null parents count once and not at all."""
    hits = spark.createDataFrame([("a", 1), ("a", 2), ("b", None), ("c", 9), (None, 1), ("d", 3)], "bucket string, o long")
    orders = spark.createDataFrame([(1, 7), (1, 7), (2, 7), (3, None), (None, 5)], "id long, c long")
    customers = spark.createDataFrame([(7,), (7,), (None,)], "cid long")
    parents = {"order": Parent(orders, "id"), "customer": Parent(customers, "cid")}
    keys = {"order": "o", "customer": "c"}
    for path, wanted in (("order", {"a": 2, "b": 0, "c": 0, "d": 1}), ("order,customer", {"a": 1, "b": 0, "c": 0, "d": 0})):
        assert {r.bucket: r.doc_count for r in undup(hits, "bucket", path, parents, keys).collect()} == wanted
