"""All registered queries, each with the SQL that computes the same.

A query takes ``(spark, folder)``; ``ORACLES`` has standard SQL over the same tables.  Queries whose result SQL
can't express (places in files, graph positions) have none and are tested on fixtures.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cmp_to_key, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import analysis, formats, token_streams
from foliant.functions.ranges import compare_bytes, compare_bytes_descending
from foliant.functions.replace import extracted, extracted_by
from foliant.functions.selector import Selector
from foliant.functions.typed import decoded, show, sortable
from foliant.operators import admin, diagnostics, similarity, termlist, view
from foliant.operators.parents import Parent, terms, undup
from foliant.operators.queries import AllowNested, Bool, Fuzzy, MatchAll, MatchDeleted, MatchNested, Term, deleted_since, search
from foliant.operators.similarity import Settings
from foliant.operators.termlist import Mapping, Request
from foliant.sources.tables import indexes, model, table, with_nested

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- parents -------------------------------------------------------------------------------------

_LEVELS = ("orders", "o_orderkey"), ("customer", "c_custkey"), ("nation", "n_nationkey"), ("region", "r_regionkey")
_KEYS = {"orders": "l_orderkey", "customer": "o_custkey", "nation": "c_nationkey", "region": "n_regionkey"}


def _parents(spark: SparkSession, d: str, live: Column | None = None) -> dict[str, Parent]:
    return {t: Parent(table(spark, d, t), key, live if t == "orders" else None) for t, key in _LEVELS}



def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem")


@registered("SELECT l_returnflag, count(DISTINCT l_orderkey) AS doc_count FROM lineitem GROUP BY 1")
def undup_single(spark, d):
    return undup(_lines(spark, d), "l_returnflag", "orders", _parents(spark, d), _KEYS)


@registered("SELECT l_returnflag, count(DISTINCT o_custkey) AS doc_count FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def undup_multi2(spark, d):
    return undup(_lines(spark, d), "l_returnflag", "orders,customer", _parents(spark, d), _KEYS)


@registered("""SELECT l_shipmonth, count(DISTINCT n_regionkey) AS doc_count FROM
(SELECT month(l_shipdate)::INTEGER AS l_shipmonth, n_regionkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) GROUP BY 1""")
def undup_multi4(spark, d):
    lines = _lines(spark, d).withColumn("l_shipmonth", F.month("l_shipdate"))
    return undup(lines, "l_shipmonth", "orders, customer; nation,region", _parents(spark, d), _KEYS)


@registered("""SELECT l_returnflag, count(DISTINCT o_orderkey) AS doc_count FROM (SELECT DISTINCT l_returnflag, l_orderkey FROM lineitem)
LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus <> 'P' GROUP BY 1""")
def undup_compensate_on(spark, d):
    return undup(_lines(spark, d), "l_returnflag", "orders", _parents(spark, d, F.expr("o_orderstatus <> 'P'")), _KEYS)


@registered("SELECT l_returnflag, count(DISTINCT l_orderkey) AS doc_count FROM lineitem GROUP BY 1")
def undup_compensate_off(spark, d):
    return undup(_lines(spark, d), "l_returnflag", "orders", _parents(spark, d, F.expr("o_orderstatus <> 'P'")), _KEYS, compensate_non_existing=False)


@registered("""SELECT l_returnflag, count(DISTINCT o_custkey) AS doc_count FROM lineitem JOIN orders ON l_orderkey = o_orderkey
AND o_orderstatus <> 'P' GROUP BY 1""")
def undup_live_hops(spark, d):
    return undup(_lines(spark, d), "l_returnflag", "orders,customer", _parents(spark, d, F.expr("o_orderstatus <> 'P'")), _KEYS)


#: Conversations of fewer than 4 turns count as deleted.
_TALKS = "conv_id IN (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) >= 4)"


def _conversations(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return with_nested(model(turns, "conv_id", live=F.size("turns") >= 4), "turns")


@registered(f"SELECT role, count(DISTINCT conv_id) AS doc_count FROM conversations WHERE {_TALKS} AND role IS NOT NULL GROUP BY 1")
def undup_nested(spark, d):
    return undup(search(_conversations(spark, d), MatchNested()), "role", "_nested_", {}, {})


def _orders_with_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d).groupBy("l_orderkey").agg(F.collect_list(F.struct("l_returnflag", "l_quantity")).alias("lines"))
    orders = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")
    return with_nested(model(orders, "o_orderkey"), "lines")


@registered("SELECT l_returnflag, count(DISTINCT o_custkey) AS doc_count FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def undup_nested_then_parent(spark, d):
    rows = _orders_with_lines(spark, d)
    return undup(search(rows, MatchNested()), "l_returnflag", "_nested_,customer", _parents(spark, d), _KEYS)


@registered("""SELECT f AS l_returnflag, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_returnflag = f) AS doc_count
FROM (SELECT unnest(['A', 'N', 'R', 'X']) AS f)""")
def undup_empty_bucket(spark, d):
    buckets = spark.createDataFrame([(f,) for f in "ANRX"], "l_returnflag string")
    return undup(_lines(spark, d), "l_returnflag", "orders", _parents(spark, d), _KEYS, buckets=buckets)


@registered("SELECT DISTINCT l_returnflag, 0::BIGINT AS doc_count FROM lineitem")
def undup_resilient_noop(spark, d):
    return undup(_lines(spark, d), "l_returnflag", "orders,no_such_parent", _parents(spark, d), _KEYS, resilient=True)


@registered("SELECT event_type AS key, count(*) AS count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def terms_size_order(spark, d):
    return terms(table(spark, d, "events"), "event_type", 3)


# --- queries -------------------------------------------------------------------------------------


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents; those labelled toxic are deleted."""
    toxic = table(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit(False).alias("alive")).distinct()
    return model(table(spark, d, "documents").join(toxic, "doc_id", "left"), "doc_id", F.coalesce(F.col("alive"), F.lit(True)))


_DELETED = "doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"


@registered(f"SELECT doc_id, lang FROM documents WHERE {_DELETED}")
def match_deleted_all(spark, d):
    return search(_documents(spark, d), MatchDeleted()).select("doc_id", "lang")


@registered(f"SELECT doc_id, lang FROM documents WHERE lang = 'en' AND {_DELETED}")
def match_deleted_sub(spark, d):
    return search(_documents(spark, d), MatchDeleted(Term("lang", "en"))).select("doc_id", "lang")


@registered(f"SELECT doc_id, lang FROM documents WHERE lang = 'fr' AND {_DELETED}")
def fuzzy_alias(spark, d):
    return search(_documents(spark, d), Fuzzy(Term("lang", "fr"))).select("doc_id", "lang")


@registered(f"SELECT doc_id FROM documents WHERE {_DELETED}")
def deleted_by_snapshot(spark, d):
    docs = table(spark, d, "documents")
    return deleted_since(docs, search(_documents(spark, d), MatchAll()), "doc_id").select("doc_id")


@registered(f"SELECT conv_id, turn FROM conversations WHERE {_TALKS}")
def match_nested_all(spark, d):
    return search(_conversations(spark, d), MatchNested()).select("conv_id", "turn")


@registered(f"SELECT conv_id, turn FROM conversations WHERE {_TALKS} AND role = 'assistant'")
def match_nested_sub(spark, d):
    return search(_conversations(spark, d), MatchNested(Term("role", "assistant"))).select("conv_id", "turn")


@registered(f"""SELECT conv_id, turn FROM conversations WHERE {_TALKS}
UNION ALL SELECT DISTINCT conv_id, NULL::BIGINT FROM conversations WHERE {_TALKS}""")
def allow_nested(spark, d):
    return search(_conversations(spark, d), AllowNested(MatchAll())).select("conv_id", "turn")


@registered(f"SELECT DISTINCT conv_id FROM conversations WHERE {_TALKS}")
def root_only_default(spark, d):
    return search(_conversations(spark, d), MatchAll()).select("conv_id")


@registered(f"""SELECT doc_id FROM documents WHERE lang IN ('de', 'es') AND source <> 'src0' AND NOT ({_DELETED})""")
def bool_query(spark, d):
    q = Bool(should=(Term("lang", "de"), Term("lang", "es")), must_not=(Term("source", "src0"),))
    return search(_documents(spark, d), q).select("doc_id")


@registered(f"SELECT doc_id FROM documents WHERE lang = 'en' AND NOT ({_DELETED})")
def bool_must_should(spark, d):
    q = Bool(must=(Term("lang", "en"),), should=(Term("source", "src0"), Term("source", "src1")))
    return search(_documents(spark, d), q).select("doc_id")


@registered(f"""SELECT doc_id FROM documents WHERE NOT ({_DELETED})
AND (lang = 'en')::INTEGER + (source = 'src0')::INTEGER + (n_chars > 0 AND source = 'src1')::INTEGER + (lang = 'fr')::INTEGER >= 2""")
def bool_least_should(spark, d):
    from foliant.plans import dsl

    some = [dict(term=dict(lang="en")), dict(term=dict(source="src0")), dict(term=dict(source=dict(value="src1"))), dict(term=dict(lang="fr"))]
    body = dict(query=dict(bool=dict(should=some, minimum_should_match=2)))
    return dsl.run(_documents(spark, d), body, dsl.Schema(from_files=False)).hits.select("doc_id")


# --- term lists ----------------------------------------------------------------------------------

_POSTINGS = r"""p AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents),
tl AS MATERIALIZED (SELECT term, count(*) AS count FROM (SELECT DISTINCT doc_id, term FROM p) GROUP BY term)"""


def _docs_list(spark: SparkSession, d: str, request: Request, mapping: Mapping = Mapping()) -> DataFrame:
    return termlist.term_list(table(spark, d, "documents"), request, mapping)


@registered(f"WITH {_POSTINGS} SELECT * FROM tl")
def termlist_text(spark, d):
    return _docs_list(spark, d, Request(field="TEXT"))


@registered("SELECT p_brand AS term, count(*) AS count FROM part GROUP BY 1")
def termlist_keyword(spark, d):
    return termlist.term_list(table(spark, d, "part"), Request(field="p_brand"), Mapping({"p_brand": "keyword"}))


@registered("SELECT p_size AS term, count(*) AS count FROM part GROUP BY 1")
def termlist_numeric(spark, d):
    return termlist.term_list(table(spark, d, "part"), Request(field="p_size"))


@registered("SELECT strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS term, count(*) AS count FROM orders WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1996-01-01' GROUP BY 1")
def termlist_date(spark, d):
    out = termlist.term_list(table(spark, d, "orders"), Request(field="o_orderdate", range="1995-01-01..1996-01-01"))
    return out.select(show(F.col("term"), "date").alias("term"), "count")


@registered(f"WITH {_POSTINGS} SELECT * FROM tl WHERE regexp_matches(term, 'the[a-m]')")
def termlist_filter(spark, d):
    return _docs_list(spark, d, Request(field="text", filter="the[a-m]"))


@registered(f"WITH {_POSTINGS} SELECT * FROM tl WHERE NOT regexp_matches(term, '[aeiou]')")
def termlist_not_filter(spark, d):
    return _docs_list(spark, d, Request(field="text", not_filter="[aeiou]"))


@registered(f"WITH {_POSTINGS} SELECT * FROM tl WHERE length(term) >= 3 AND length(term) < 5")
def termlist_length(spark, d):
    return _docs_list(spark, d, Request(field="text", length="3..5"))


@registered(f"WITH {_POSTINGS} SELECT * FROM tl WHERE term >= 'th' AND term < 'to'")
def termlist_range(spark, d):
    return _docs_list(spark, d, Request(field="text", range="th..to"))


@registered("SELECT p_size AS term, count(*) AS count FROM part WHERE p_size >= 10 AND p_size < 20 GROUP BY 1")
def termlist_range_numeric(spark, d):
    return termlist.term_list(table(spark, d, "part"), Request(field="p_size", range="10..20"))


@registered(f"WITH {_POSTINGS} SELECT * FROM tl WHERE count >= 50 AND count < 200")
def termlist_count(spark, d):
    return _docs_list(spark, d, Request(field="text", count="50..200"))


@registered(f"WITH {_POSTINGS} SELECT term, count, row_number() OVER (ORDER BY count DESC, term)::INTEGER AS rank FROM tl ORDER BY count DESC, term LIMIT 25")
def termlist_sort_count_limit(spark, d):
    request = Request(field="text", sort="-count", result_limit=25)
    return termlist.ranked(_docs_list(spark, d, request), request)


@registered(f"WITH {_POSTINGS} SELECT term, count, row_number() OVER (ORDER BY term DESC)::INTEGER AS rank FROM tl WHERE term < 'z' ORDER BY term DESC LIMIT 40")
def termlist_sort_term_limit(spark, d):
    request = Request(field="text", sort="term", range="..z", result_limit=40)
    return termlist.ranked(_docs_list(spark, d, request), request)


@registered(f"WITH {_POSTINGS} SELECT count(*) AS item_count, count(*) FILTER (count >= 5) AS filtered_item_count, max(count) AS max_occ_count FROM tl")
def termlist_limits(spark, d):
    return termlist.limits(_docs_list(spark, d, Request(field="text")), Request(count="5.."))


@registered("SELECT term, count(*) AS count FROM (SELECT p_brand AS term FROM part UNION ALL SELECT p_type FROM part) GROUP BY 1")
def termlist_multi_field(spark, d):
    return termlist.term_list(table(spark, d, "part"), Request(field="p_brand,P_TYPE"), Mapping({"p_brand": "keyword", "p_type": "keyword"}))


@registered(r"""WITH a AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term, 0 AS i FROM documents
UNION ALL SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')), 1 FROM benchmark)
SELECT term, count(DISTINCT (i, id)) AS count FROM a GROUP BY 1""")
def termlist_multi_index(spark, d):
    return termlist.term_list({t: table(spark, d, t) for t in ("documents", "benchmark")}, Request(field="text"))


@registered("""SELECT 'part' AS "index", 'p_size' AS field, 'integer' AS type, count(p_size) AS doc_count, count(DISTINCT p_size) AS term_count, min(p_size)::VARCHAR AS lo, max(p_size)::VARCHAR AS hi FROM part
UNION ALL SELECT 'part', 'p_partkey', 'long', count(p_partkey), count(DISTINCT p_partkey), min(p_partkey)::VARCHAR, max(p_partkey)::VARCHAR FROM part
UNION ALL SELECT 'part', 'p_brand', 'keyword', count(p_brand), count(DISTINCT p_brand), min(p_brand), max(p_brand) FROM part
UNION ALL SELECT 'part', 'p_type', 'keyword', count(p_type), count(DISTINCT p_type), min(p_type), max(p_type) FROM part
UNION ALL SELECT 'orders', 'o_orderdate', 'date', count(o_orderdate), count(DISTINCT o_orderdate), strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%S.000Z'), strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S.000Z') FROM orders
UNION ALL SELECT 'orders', 'o_orderstatus', 'keyword', count(o_orderstatus), count(DISTINCT o_orderstatus), min(o_orderstatus), max(o_orderstatus) FROM orders
UNION ALL SELECT 'nation', 'n_name', 'keyword', count(n_name), count(DISTINCT n_name), min(n_name), max(n_name) FROM nation""")
def termlist_fields(spark, d):
    wanted = ["p_size", "p_partkey", "p_brand", "p_type", "o_orderdate", "o_orderstatus", "n_name"]
    keyword = ("p_brand", "p_type", "o_orderstatus", "n_name")
    mapping = Mapping(dict.fromkeys(keyword, "keyword"), dict.fromkeys(keyword, "keyword"))
    return termlist.field_catalog({t: table(spark, d, t) for t in ("part", "orders", "nation")}, mapping, wanted)


@registered(r"""SELECT * FROM (SELECT 'documents' AS "index", 'text' AS field, count(*) FILTER (list_contains(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), 'en')) AS count FROM documents
UNION ALL SELECT 'documents', 'lang', count(*) FILTER (list_contains(regexp_extract_all(lower(lang), '[\p{L}\p{N}]+'), 'en')) FROM documents
UNION ALL SELECT 'documents', 'source', count(*) FILTER (list_contains(regexp_extract_all(lower(source), '[\p{L}\p{N}]+'), 'en')) FROM documents
UNION ALL SELECT 'benchmark', 'text', count(*) FILTER (list_contains(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), 'en')) FROM benchmark) WHERE count > 0""")
def termlist_term_fields(spark, d):
    return termlist.term_fields({t: table(spark, d, t) for t in ("documents", "benchmark")}, "en")


_COLLIDE = "regexp_replace(regexp_replace(term, '(ing|ed|er)$', ''), '^un', '')"


@registered(f"""WITH {_POSTINGS}, c AS (SELECT term, count, {_COLLIDE} AS collision FROM tl WHERE regexp_matches(term, '(ing|ed|er)$') OR regexp_matches(term, '^un'))
SELECT c.term, c.count, c.collision, tl.count AS collision_count FROM c JOIN tl ON tl.term = c.collision""")
def termlist_collisions(spark, d):
    request = Request(field="text", repl_expr="(ing|ed|er)$/||^un/")
    return termlist.collisions(_docs_list(spark, d, request), request)


@registered(f"""WITH {_POSTINGS}, c AS (SELECT term, count, {_COLLIDE} AS collision FROM tl WHERE regexp_matches(term, '(ing|ed|er)$') OR regexp_matches(term, '^un'))
SELECT c.term, c.count, c.collision, coalesce(tl.count, 0) AS collision_count FROM c LEFT JOIN tl ON tl.term = c.collision""")
def termlist_collisions_all(spark, d):
    request = Request(field="text", repl_expr="(ing|ed|er)$/||^un/", collisions_only=False)
    return termlist.collisions(_docs_list(spark, d, request), request)


@registered("SELECT printf('%6d;%s', count(*), p_brand) AS line FROM part GROUP BY p_brand")
def termlist_text_output(spark, d):
    listed = termlist.term_list(table(spark, d, "part"), Request(field="p_brand"), Mapping({"p_brand": "keyword"}))
    return termlist.text_rows(listed).select(F.rtrim("line", F.lit("\r\n")).alias("line"))


@registered(f"""WITH tl AS (SELECT p_brand AS term, count(*) AS count FROM part GROUP BY 1),
c AS (SELECT a.term, a.count, b.term AS collision, b.count AS collision_count FROM tl a JOIN tl b ON b.term = regexp_replace(a.term, '[0-9]$', '1'))
SELECT term, count, collision, collision_count FROM c ORDER BY term DESC LIMIT 7""")
def termlist_collisions_limit(spark, d):
    request = Request(field="p_brand", repl_expr="[0-9]$/1", sort="-count", result_limit=7)
    listed = termlist.term_list(table(spark, d, "part"), request, Mapping({"p_brand": "keyword"}))
    return termlist.limited_collisions(termlist.collisions(listed, request), request)


@registered("""WITH tl AS (SELECT p_brand AS t, count(*) AS c FROM part GROUP BY 1),
lim AS (SELECT max(c) AS max_occ_count, count(*) AS item_count, count(*) FILTER (c >= 2) AS filtered_item_count FROM tl),
f AS (SELECT count(p_brand) AS doc_count, count(DISTINCT p_brand) AS term_count, min(p_brand) AS term_lo, max(p_brand) AS term_hi FROM part)
SELECT * FROM (SELECT t, c, row_number() OVER (ORDER BY c DESC, t) AS nr FROM tl WHERE c >= 2), lim, f WHERE nr <= 5""")
def termlist_response(spark, d):
    """The response of a request; its terms are limited by the request, as they are in any response."""
    from foliant.plans import endpoints

    mapping = Mapping({"p_brand": "keyword"}, {"p_brand": "keyword"})
    got = endpoints.termlist_response({"part": table(spark, d, "part")}, {"field": "p_brand", "sort": "-count", "count": "2..", "result_limit": 5}, mapping)["response"]
    f = got["fields"]["part"]["p_brand"]
    rows = [(t["t"], t["c"], i + 1, got["maxOccCount"], got["itemCount"], got["filteredItemCount"], f["doc_count"], f["term_count"], f["term_lo"], f["term_hi"]) for i, t in enumerate(got["terms"])]
    return spark.createDataFrame(rows, "t string, c long, nr long, max_occ_count long, item_count long, filtered_item_count long, doc_count long, term_count long, term_lo string, term_hi string")


@registered("""SELECT row_number() OVER (ORDER BY i, lower(f)) AS nr, i AS "index", f AS field FROM (VALUES
('nation', 'n_name'), ('nation', 'n_nationkey'), ('nation', 'n_regionkey'), ('region', 'r_name'), ('region', 'r_regionkey')) v(i, f)""")
def termlist_field_order(spark, d):
    rows = termlist.field_catalog({t: table(spark, d, t) for t in ("region", "nation")}).collect()
    return spark.createDataFrame([(k + 1, r["index"], r.field) for k, r in enumerate(rows)], "nr long, index string, field string")


# --- scoring -------------------------------------------------------------------------------------


def _score_sql(query: list[str], settings: Settings = Settings(), boost: float = 1.0) -> str:
    tokens = r"SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents"
    parts, stats = [], ["count(*) AS n"]
    for i, q in enumerate(query):
        stats.append(f"count(*) FILTER (list_contains(t, '{q}')) AS df{i}")
        f = str(float(settings.force_tf)) if settings.force_tf > 0 else f"len(list_filter(t, lambda x: x = '{q}'))::DOUBLE"
        f = f"least({f}, 255.0::DOUBLE, len(t)::DOUBLE)"
        idf = "1.0" if settings.max_idf == 0 else f"(1 + {settings.max_idf}::DOUBLE * ln(1 + (n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) / ln(1 + (n - 0.5::DOUBLE) / 1.5::DOUBLE))"
        parts.append(f"CASE WHEN list_contains(t, '{q}') THEN {boost}::DOUBLE * ({idf} + {settings.max_tf}::DOUBLE * ln({settings.bias_tf}::DOUBLE + {f}) / ln({settings.bias_tf}::DOUBLE + len(t))) ELSE 0 END")
    any_ = " OR ".join(f"list_contains(t, '{q}')" for q in query)
    return f"WITH d AS ({tokens}), s AS (SELECT {', '.join(stats)} FROM d) SELECT doc_id, round({' + '.join(parts)}, 6) AS score FROM d, s WHERE {any_}"


def _scored(spark: SparkSession, d: str, query: list[str], settings: Settings = Settings(), boost: float = 1.0) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", analysis.tokens(F.col("text")).alias("t"))
    return similarity.scored(docs, "t", query, settings, boost).select("doc_id", F.round("score", 6).alias("score"))


@registered(_score_sql(["with"]))
def similarity_default(spark, d):
    return _scored(spark, d, ["with"])


@registered(_score_sql(["with"], Settings(max_idf=0.7)))
def similarity_idf(spark, d):
    return _scored(spark, d, ["with"], Settings(max_idf=0.7))


@registered(_score_sql(["the"], Settings(force_tf=2, max_tf=0.4)))
def similarity_force_tf(spark, d):
    return _scored(spark, d, ["the"], Settings(force_tf=2, max_tf=0.4))


@registered(_score_sql(["les"], boost=2.5))
def similarity_boost(spark, d):
    return _scored(spark, d, ["les"], boost=2.5)


@registered(_score_sql(["with", "from"], Settings(max_idf=1.0)))
def similarity_two_terms(spark, d):
    return _scored(spark, d, ["with", "from"], Settings(max_idf=1.0))


def _overlapping(spark: SparkSession, d: str) -> DataFrame:
    """Documents as full tokens; one-letter tokens lie on the position of the one before."""
    stream = F.transform(analysis.tokens(F.col("text")), lambda t: F.struct(t.alias("term"), F.when(F.length(t) == 1, 0).otherwise(1).alias("pos_inc")))
    return table(spark, d, "documents").select("doc_id", stream.alias("t"))


def _overlap_sql(length: str) -> str:
    tokens = r"SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents"
    return f"""WITH d AS ({tokens}), e AS (SELECT doc_id, len(list_filter(t, lambda x: x = 'with'))::DOUBLE AS f, {length}::DOUBLE AS n FROM d WHERE list_contains(t, 'with'))
SELECT doc_id, round(1.0 + 0.2::DOUBLE * ln(0.6::DOUBLE + least(f, 255.0::DOUBLE, n)) / ln(0.6::DOUBLE + n), 6) AS score FROM e"""


@registered(_overlap_sql("len(list_filter(t, lambda x: length(x) > 1))"))
def similarity_discount_overlaps(spark, d):
    return similarity.scored(_overlapping(spark, d), "t", ["with"]).select("doc_id", F.round("score", 6).alias("score"))


@registered(_overlap_sql("len(t)"))
def similarity_with_overlaps(spark, d):
    return similarity.scored(_overlapping(spark, d), "t", ["with"], Settings(discount_overlaps=False)).select("doc_id", F.round("score", 6).alias("score"))


_EXPLAIN_D = r"""d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents),
s AS (SELECT count(*) AS n, count(*) FILTER (list_contains(t, 'with')) AS df FROM d),
e AS (SELECT doc_id, len(list_filter(t, lambda x: x = 'with')) AS f, len(t) AS l, n, df FROM d, s WHERE list_contains(t, 'with'))"""


@registered(rf"""WITH {_EXPLAIN_D} SELECT doc_id, printf('tfBoost (tf=%.1f, fieldlen=%d, maxTf=0.20, forceTf=-1.0, bias=0.60)', f::DOUBLE, l) AS description, 0 AS details FROM e""")
def similarity_explain(spark, d):
    docs = table(spark, d, "documents").select("doc_id", analysis.tokens(F.col("text")).alias("t"))
    e = F.get("explanation", F.lit(0))
    return similarity.scored(docs, "t", ["with"], explain=True).select("doc_id", e["description"].alias("description"), F.size(e["details"]).alias("details"))


@registered(rf"""WITH {_EXPLAIN_D}, g AS (SELECT *, 1 + 0.7::DOUBLE * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) / ln(1 + (n - 0.5::DOUBLE) / 1.5::DOUBLE) AS idf FROM e)
SELECT doc_id, 'near/Combined from: | ' || printf('tfBoost (tf=%.1f, fieldlen=%d, maxTf=0.20, forceTf=-1.0, bias=0.60)', f::DOUBLE, l) || ' | '
|| printf('+= idf=%.3f (docs=%d out of %d, maxIdf=0.700)', idf, df, n) || ' | *= boost=2.500' AS said FROM g""")
def similarity_explain_all(spark, d):
    docs = table(spark, d, "documents").select("doc_id", analysis.tokens(F.col("text")).alias("t"))
    e = F.get("explanation", F.lit(0))
    lines = F.concat(F.array(e["description"]), F.transform(e["details"], lambda x: x["description"]))
    return similarity.scored(docs, "t", ["with"], Settings(max_idf=0.7), boost=2.5, explain=True, parent_term="near").select("doc_id", F.array_join(lines, " | ").alias("said"))


@registered(rf"""WITH {_EXPLAIN_D} SELECT doc_id, round(3.0::DOUBLE * (1.0 + 0.2::DOUBLE * ln(0.6::DOUBLE + least(f, 255, l)::DOUBLE) / ln(0.6::DOUBLE + l)), 6) AS score FROM e""")
def similarity_weighted_term(spark, d):
    docs = table(spark, d, "documents").select("doc_id", analysis.tokens(F.col("text")).alias("t"))
    own = similarity.scored(docs, "t", ["with"])
    return own.select("doc_id", F.round(similarity.weighted_term("t", "with", F.col("score"), 3.0), 6).alias("score"))


# --- text analysis -------------------------------------------------------------------------------


def _shingle_sql(tokens: str, sizes: list[int]) -> str:
    grams = " UNION ALL ".join(
        f"SELECT item_id, list_aggregate(list_slice(a, i, i + {n - 1}), 'string_agg', ' ') AS shingle FROM (SELECT item_id, a, unnest(range(1, len(a) + 1)) AS i FROM t) WHERE i + {n - 1} <= len(a)"
        + (f" AND len(list_filter(list_slice(a, i + 1, i + {n - 1}), lambda x: regexp_matches(x, '[^\\p{{L}}\\p{{Nd}}]'))) = 0" if n > 1 else "") for n in sizes)
    return f"WITH t AS (SELECT item_id, {tokens} AS a FROM benchmark), g AS ({grams}) SELECT item_id, shingle, count(*) AS n FROM g GROUP BY 1, 2"


def _shingled(spark: SparkSession, d: str, tokens: Column, **options) -> DataFrame:
    rows = table(spark, d, "benchmark").select("item_id", F.explode(analysis.shingles(tokens, **options)).alias("shingle"))
    return rows.groupBy("item_id", "shingle").agg(F.count("*").alias("n"))


_SQL_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


@registered(_shingle_sql(_SQL_WORDS, [1, 2]))
def shingle_2(spark, d):
    return _shingled(spark, d, analysis.tokens(F.col("text")))


@registered(_shingle_sql(_SQL_WORDS, [2, 3]))
def shingle_2_3_no_unigrams(spark, d):
    return _shingled(spark, d, analysis.tokens(F.col("text")), min_size=2, max_size=3, unigrams=False)


@registered(_shingle_sql("regexp_extract_all(text, '[^ \\n\\t\\r]+')", [1, 2, 3]))
def shingle_special_chars(spark, d):
    return _shingled(spark, d, F.regexp_extract_all("text", F.lit("[^ \\n\\t\\r]+"), F.lit(0)), max_size=3)


@registered(r"""WITH t AS (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM conversations)
SELECT conv_id, term FROM t GROUP BY 1, 2""")
def global_unique(spark, d):
    turns = table(spark, d, "conversations").withColumn("a", analysis.tokens(F.col("text"))).groupBy("conv_id").agg(F.collect_list("a").alias("e"))
    return turns.select("conv_id", F.explode(analysis.global_unique(F.col("e"))).alias("term"))


@registered(f"SELECT item_id, array_to_string({_SQL_WORDS}[4:], ' ') AS rest FROM benchmark")
def skip_tokens(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(analysis.skip(analysis.tokens(F.col("text")), -3), " ").alias("rest"))


@registered(f"SELECT doc_id, len({_SQL_WORDS}) AS length FROM documents")
def field_count(spark, d):
    return table(spark, d, "documents").select("doc_id", analysis.field_count(analysis.tokens(F.col("text")))["length"].cast("long").alias("length"))


@registered("""SELECT source, CASE WHEN regexp_matches(source, '^src[0-9]+$') THEN substr(source, 4)::INTEGER ELSE -1 END AS length, count(*) AS n FROM documents GROUP BY 1, 2""")
def field_count_prefix(spark, d):
    return table(spark, d, "documents").select("source", analysis.field_count(F.array("source", "lang"), "src")["length"].alias("length")).groupBy("source", "length").agg(F.count("*").alias("n"))


@registered(r"""SELECT page_id, unnest(regexp_extract_all(url, '\p{Lu}*\p{Ll}+|\p{Lu}+|\p{Nd}+')) AS part FROM pages""")
def word_delimiter_split(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(token_streams.split_words(F.array("url"))).alias("part"))


@registered(r"""SELECT page_id, array_to_string(regexp_extract_all(url, '[\p{L}\p{Nd}]+'), '') AS joined FROM pages""")
def word_delimiter_catenate_all(spark, d):
    only = token_streams.WordDelimiter(generate_word_parts=False, generate_number_parts=False, catenate_all=True)
    stream = token_streams.word_delimited(analysis.full(F.array("url")), only)
    return table(spark, d, "pages").select("page_id", F.get(stream, F.lit(0))["term"].alias("joined"))


@registered(r"""SELECT page_id, unnest(regexp_extract_all(url, '[\p{L}\p{N}./]+')) AS part FROM pages""")
def word_delimiter_type_table(spark, d):
    rules = token_streams.parse_type_table([". => ALPHANUM", "/ => ALPHANUM"])
    own = token_streams.WordDelimiter(split_on_case_change=False, split_on_numerics=False, stem_english_possessive=False, type_table=rules)
    stream = token_streams.word_delimited(analysis.full(F.array("url")), own)
    return table(spark, d, "pages").select("page_id", F.explode(F.transform(stream, lambda t: t["term"])).alias("part"))


# --- views ---------------------------------------------------------------------------------------

_ONE = 17


@registered(f"""SELECT * FROM (SELECT unnest(['doc_id', 'lang', 'n_chars', 'source', 'text']) AS field, unnest([doc_id::VARCHAR, lang, n_chars::VARCHAR, source, text]) AS value,
unnest([doc_id::DOUBLE, NULL, n_chars::DOUBLE, NULL, NULL]) AS value_num FROM documents WHERE doc_id = {_ONE})""")
def view_stored(spark, d):
    return view.stored(view.lookup(table(spark, d, "documents"), "doc_id", _ONE))


@registered(rf"""WITH t AS (SELECT regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS a FROM documents WHERE doc_id = {_ONE}),
u AS (SELECT unnest(a) AS term, unnest(range(len(a))) AS pos FROM t),
f AS (SELECT term, min(pos)::INTEGER AS first_pos FROM u GROUP BY 1)
SELECT 'text' AS field, term, first_pos, row_number() OVER (ORDER BY first_pos, strlen(term), term)::INTEGER AS ord FROM f""")
def view_indexed(spark, d):
    return view.indexed(view.lookup(table(spark, d, "documents"), "doc_id", _ONE), "text")


@registered(rf"""WITH t AS (SELECT regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS a FROM documents WHERE doc_id = {_ONE}),
u AS (SELECT unnest(a) AS term, unnest(range(len(a))) AS pos FROM t)
SELECT term, count(*) AS count, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS places FROM u GROUP BY 1""")
def view_postings(spark, d):
    p = view.postings(view.lookup(table(spark, d, "documents"), "doc_id", _ONE), "text")
    return p.select("term", "count", F.array_join(F.transform("postings", lambda x: x["pos"].cast("string")), ",").alias("places"))


@registered(f"""SELECT unnest(['doc_id', 'lang', 'n_chars', 'source', 'text']) AS field, 1 AS count,
unnest([doc_id::VARCHAR, lang, n_chars::VARCHAR, source, text]) AS "values" FROM documents WHERE doc_id = {_ONE}""")
def view_docvalues(spark, d):
    v = view.docvalues(view.lookup(table(spark, d, "documents"), "doc_id", _ONE))
    return v.select("field", "count", F.array_join("values", "|").alias("values"))


@registered(f"SELECT doc_id, lang FROM documents WHERE doc_id = {_ONE + 3}")
def view_offset(spark, d):
    return view.lookup(table(spark, d, "documents"), "doc_id", _ONE, offset=3).select("doc_id", "lang")


@registered(f"""SELECT 'stored' AS section, 'lang' AS field, lang AS item FROM documents WHERE doc_id = {_ONE}
UNION ALL SELECT 'docvalues', 'lang', lang FROM documents WHERE doc_id = {_ONE}""")
def view_selected(spark, d):
    return view.view(view.lookup(table(spark, d, "documents"), "doc_id", _ONE), output="!indexed", fields="LANG;no_such")


@registered(rf"""WITH RECURSIVE t AS (SELECT lower(text) AS x, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS a FROM documents WHERE doc_id = {_ONE}),
w AS (SELECT 1 AS i, instr(x, a[1]) - 1 AS b FROM t WHERE len(a) > 0
UNION ALL SELECT i + 1, b + length(a[i]) + instr(substr(x, (b + length(a[i]) + 1)::BIGINT), a[i + 1]) - 1 FROM w, t WHERE i < len(a)),
p AS (SELECT a[i] AS term, i - 1 AS pos, b AS s, b + length(a[i]) AS e FROM w, t)
SELECT 'text' AS field, term, count(*) AS count, string_agg('pos=' || pos || ', offset=' || s || '..' || e, ' | ' ORDER BY pos) AS postings FROM p GROUP BY term""")
def view_dense_postings(spark, d):
    p = view.postings(view.lookup(table(spark, d, "documents"), "doc_id", _ONE), "text", dense=True)
    return p.withColumn("postings", F.array_join("postings", " | "))


@registered(f"""SELECT 'n_chars' AS field, n_chars::VARCHAR AS term FROM documents WHERE doc_id = {_ONE}
UNION ALL SELECT 'doc_id', doc_id::VARCHAR FROM documents WHERE doc_id = {_ONE}""")
def view_points(spark, d):
    doc = view.lookup(table(spark, d, "documents"), "doc_id", _ONE)
    return view.indexed(doc, "n_chars").unionByName(view.indexed(doc, "doc_id"))


@registered(f"""SELECT f AS field, v AS value, NULL::DOUBLE AS value_num, '[' || rtrim(regexp_replace(hex(v), '(.{{8}})', '\\1 ', 'g')) || ']' AS value_bin, v AS value_binstr, 'text' AS type, 'StringType' AS "class"
FROM (SELECT unnest(['lang', 'source']) AS f, unnest([lang, source]) AS v FROM documents WHERE doc_id = {_ONE})""")
def view_stored_bytes(spark, d):
    return view.stored(view.lookup(table(spark, d, "documents"), "doc_id", _ONE), Selector("lang,source"), level=1)


@registered(f"SELECT coalesce((SELECT text FROM benchmark WHERE item_id = {_ONE}), (SELECT text FROM documents WHERE doc_id = {_ONE})) AS text")
def view_merge(spark, d):
    from foliant.plans import endpoints

    both = {"documents": table(spark, d, "documents").select("doc_id", "text"), "benchmark": table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")}
    doc = endpoints.view_response(both, "doc_id", {"id": _ONE, "output": "stored", "field": "text"})["doc"]
    return spark.createDataFrame([(f["value"],) for f in doc["storedFields"]], "text string")


@registered("SELECT row_number() OVER (ORDER BY n LIKE '!_%' ESCAPE '!', n) AS nr, n AS name FROM (SELECT unnest(['doc_id', 'text', 'lang', 'source', 'n_chars', '_root', '_live', '_path']) AS n)")
def view_field_order(spark, d):
    names = view.field_order(model(table(spark, d, "documents"), "doc_id").columns)
    return spark.createDataFrame([(k + 1, n) for k, n in enumerate(names)], "nr long, name string")


@registered("""SELECT o_orderkey, 'orders' AS "index", 'o_totalprice > 0' AS query, o_orderstatus AS status, o_orderkey::VARCHAR AS key, true AS placed FROM orders WHERE o_totalprice > 0""")
def diagnostics_hits(spark, d):
    hits = diagnostics.with_diagnostics(table(spark, d, "orders").where("o_totalprice > 0"), "o_totalprice > 0", "orders")
    placed = F.col("_bm.segment").isNotNull() & (F.col("_bm.docid_rel") >= 0) & (F.col("_bm.docid") >= 0) & (F.length("_bm.index_uuid") == 36)
    values = F.col("_bm.docvalues")
    return hits.select("o_orderkey", "_bm.index", "_bm.query", values["o_orderstatus"].alias("status"), values["o_orderkey"].alias("key"), placed.alias("placed"))


# --- reports and formats -------------------------------------------------------------------------


def _cache_entries(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat(F.lit("/indices/"), F.col("n_name"), F.lit("/0/index/term:"), F.col("c_mktsegment"))
    both = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return both.select(key.alias("key"), F.length("c_name").cast("long").alias("bytes"))


_PRETTY = """CASE WHEN {x} < 1000 THEN printf('%d bytes', {x}) ELSE
 CASE WHEN u < 10 THEN printf('%.2f', round(u, 2)) WHEN u < 100 THEN printf('%.1f', round(u, 1)) ELSE printf('%.0f', round(u)) END || ' ' || unit END"""
_UNITS = """CASE WHEN {x} / 1e6::DOUBLE > 1000 THEN {x} / 1e9::DOUBLE WHEN {x} / 1e3::DOUBLE > 1000 THEN {x} / 1e6::DOUBLE ELSE {x} / 1e3::DOUBLE END AS u,
 CASE WHEN {x} / 1e6::DOUBLE > 1000 THEN 'GB' WHEN {x} / 1e3::DOUBLE > 1000 THEN 'MB' ELSE 'KB' END AS unit"""


@registered(f"""WITH e AS (SELECT n_name AS "index", '/term:' || c_mktsegment AS query, sum(length(c_name))::BIGINT AS ram FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
f AS (SELECT *, {_UNITS.format(x='ram')} FROM e) SELECT "index", query, ram, {_PRETTY.format(x='ram')} AS ram_pretty FROM f""")
def cache_dump(spark, d):
    return admin.cache_report(_cache_entries(spark, d), "query")


@registered("""WITH e AS (SELECT n_name AS i, '/term:' || c_mktsegment AS q, sum(length(c_name)) AS ram FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT i AS "index", q AS query, row_number() OVER (ORDER BY i, q) AS by_query, row_number() OVER (ORDER BY i, ram DESC, q) AS by_size FROM e""")
def cache_orders(spark, d):
    places: dict = {}
    for sort in ("query", "size"):
        for k, r in enumerate(admin.cache_report(_cache_entries(spark, d), "query", sort=sort).collect()):
            places.setdefault((r["index"], r["query"]), []).append(k + 1)
    return spark.createDataFrame([(*key, *nr) for key, nr in places.items()], "index string, query string, by_query long, by_size long")


@registered("SELECT DISTINCT '/indices/' || n_name || '/0/index/term:' || c_mktsegment AS key FROM customer JOIN nation ON c_nationkey = n_nationkey")
def cache_keys(spark, d):
    return admin.raw_keys(_cache_entries(spark, d).unionByName(_cache_entries(spark, d).where("bytes > 10")))


@registered("SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN -1 ELSE (p_size + 64) // 8 END::BIGINT AS bytes FROM part")
def bitset_size(spark, d):
    return table(spark, d, "part").select("p_partkey", formats.bitset_bytes(F.when(F.col("p_size") % 7 != 0, F.col("p_size"))).alias("bytes"))


@registered(r"SELECT doc_id, regexp_replace(text, '[^\x21-\x7f]+', ' ', 'g') AS shown FROM documents")
def printable_text(spark, d):
    return table(spark, d, "documents").select("doc_id", formats.printable(F.col("text")).alias("shown"))


@registered(r"SELECT n_name, rtrim(regexp_replace(lower(regexp_replace(hex(n_name || chr(5) || chr(31)), '(..)', '\1 ', 'g')), '(^| )0', '\1', 'g')) AS hex FROM nation")
def plain_hex_format(spark, d):
    return table(spark, d, "nation").select("n_name", formats.plain_hex(F.concat("n_name", F.lit("\x05\x1f")).cast("binary")).alias("hex"))


@registered("""SELECT 'long' AS type, o_orderkey::VARCHAR AS key, o_orderkey::VARCHAR AS shown FROM orders
UNION ALL SELECT 'date', o_orderkey::VARCHAR, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') FROM orders
UNION ALL SELECT 'double', o_orderkey::VARCHAR, round(o_totalprice * 100)::BIGINT::VARCHAR FROM orders
UNION ALL SELECT 'text', o_orderkey::VARCHAR, o_orderstatus FROM orders
UNION ALL SELECT 'boolean', o_orderkey::VARCHAR, CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END FROM orders
UNION ALL SELECT 'integer', p_partkey::VARCHAR, (p_size - 25)::VARCHAR FROM part
UNION ALL SELECT 'float', p_partkey::VARCHAR, (p_size - 25)::VARCHAR FROM part""")
def typed_codecs(spark, d):
    """Values through their indexed bytes and back."""
    orders, part = table(spark, d, "orders"), table(spark, d, "part")

    def shown(rows: DataFrame, key: str, kind: str, value: Column, back=lambda c: c) -> DataFrame:
        coded = rows.select(F.col(key).cast("string").alias("key"), sortable(value, kind).alias("b"))
        return coded.select(F.lit(kind).alias("type"), "key", back(decoded(F.col("b"), kind)).alias("shown"))

    whole = lambda c: c.cast("double").cast("long").cast("string")
    cents = lambda c: F.round(c.cast("double") * 100).cast("long").cast("string")
    parts = [
        shown(orders, "o_orderkey", "long", F.col("o_orderkey")), shown(orders, "o_orderkey", "date", F.col("o_orderdate")), shown(orders, "o_orderkey", "double", F.col("o_totalprice"), cents),
        shown(orders, "o_orderkey", "text", F.col("o_orderstatus")), shown(orders, "o_orderkey", "boolean", F.col("o_orderstatus") == "F"),
        shown(part, "p_partkey", "integer", F.col("p_size") - 25), shown(part, "p_partkey", "float", F.col("p_size") - 25, whole)]
    return reduce(DataFrame.unionByName, parts)


@registered("""WITH v AS (SELECT p_partkey, p_size - 25 AS x FROM part)
SELECT p_partkey, upper(lpad(hex((x::BIGINT + 2147483648)::BIGINT), 8, '0')) AS as_integer, rank() OVER (ORDER BY x) AS by_bytes, rank() OVER (ORDER BY -x) AS by_float FROM v""")
def sortable_bytes(spark, d):
    """Bytes of numbers, which sort as the numbers do."""
    x = F.col("p_size") - 25
    rows = table(spark, d, "part").select("p_partkey", sortable(x, "integer").alias("i"), sortable(-x / 4.0, "double").alias("f"))
    counts = lambda c: rows.groupBy(c).count().select(F.col(c), (F.sum("count").over(Window.orderBy(c)) - F.col("count") + 1).alias(f"nr_{c}"))
    ranked = rows.join(counts("i"), "i").join(counts("f"), "f")
    return ranked.select("p_partkey", F.hex("i").alias("as_integer"), F.col("nr_i").alias("by_bytes"), F.col("nr_f").alias("by_float"))


@registered("""SELECT n_name, row_number() OVER (ORDER BY n_name) AS up, row_number() OVER (ORDER BY n_name DESC) AS down FROM nation""")
def byte_orders(spark, d):
    """Names by the comparators of bytes, forwards and backwards."""
    names = [r.n_name.encode() for r in table(spark, d, "nation").select("n_name").collect()]
    up, down = (sorted(names, key=cmp_to_key(f)) for f in (compare_bytes, compare_bytes_descending))
    return spark.createDataFrame([(n.decode(), up.index(n) + 1, down.index(n) + 1) for n in names], "n_name string, up long, down long")


@registered("""SELECT * FROM (VALUES ('application/json', 200), ('text/javascript, */*', 200), ('text/html', 302), (NULL, 302)) v(accept, status)""")
def help_status(spark, d):
    kinds = ["application/json", "text/javascript, */*", "text/html", None]
    return spark.createDataFrame([(a, admin.help_response(a)["status"]) for a in kinds], "accept string, status int")


@registered(f"""WITH e AS (SELECT o_orderkey, floor(o_totalprice * o_orderkey)::BIGINT AS size FROM orders), f AS (SELECT *, {_UNITS.format(x='size')} FROM e)
SELECT o_orderkey, {_PRETTY.format(x='size')} AS pretty FROM f""")
def pretty_size(spark, d):
    return table(spark, d, "orders").select("o_orderkey", formats.size_text(F.floor(F.col("o_totalprice") * F.col("o_orderkey"))).alias("pretty"))


@registered("SELECT n_name, '[' || rtrim(regexp_replace(hex(n_name), '(.{8})', '\\1 ', 'g')) || ']' AS hex FROM nation")
def hex_format(spark, d):
    return table(spark, d, "nation").select("n_name", formats.grouped_hex(F.col("n_name").cast("binary")).alias("hex"))


@registered(r"""SELECT page_id, regexp_extract(url, '^https?://([^/]+)/([a-z]+)/(\d+)', 2) || ':' || regexp_extract(url, '^https?://([^/]+)/([a-z]+)/(\d+)', 3) AS filled
FROM pages WHERE regexp_matches(url, '^https?://([^/]+)/([a-z]+)/(\d+)')
UNION ALL SELECT page_id, NULL FROM pages WHERE NOT regexp_matches(url, '^https?://([^/]+)/([a-z]+)/(\d+)')""")
def regex_extract_template(spark, d):
    # a constant directly before a group is dropped, so the colon stands between two templates
    expr = r"^https?://([^/]+)/([a-z]+)/(\d+)"
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", F.concat(extracted(url, expr, "$2"), F.lit(":"), extracted(url, expr, "$3")).alias("filled"))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    settings = F.map_from_arrays(F.array(F.lit("region"), F.lit("size"), F.lit("node.name")), F.array(F.col("n_regionkey").cast("string"), F.length("n_name").cast("string"), F.col("n_name")))
    version = F.when(F.col("n_regionkey") == 4, "2").otherwise("1")
    location = F.concat(F.lit("lib"), (F.col("n_regionkey") % 2).cast("string"))
    return table(spark, d, "nation").select(F.col("n_name").alias("node"), version.alias("version"), location.alias("location"), F.length("n_name").alias("size"), settings.alias("settings"))


_NODES = """n AS (SELECT n_name AS node, CASE WHEN n_regionkey = 4 THEN '2' ELSE '1' END AS version, 'lib' || (n_regionkey % 2) AS location, length(n_name) AS size, n_regionkey AS r FROM nation),
f AS (SELECT node AS f_node, version AS f_version, location AS f_location, size AS f_size, r AS f_r FROM n ORDER BY node LIMIT 1),
v AS (SELECT node, (r <> f_r)::INTEGER + (size <> f_size)::INTEGER AS different,
CASE WHEN node = f_node THEN NULL WHEN version <> f_version THEN 'ES-Version' WHEN location <> f_location THEN 'location' WHEN size <> f_size OR f_size = 0 THEN 'size' END AS reason FROM n, f)"""


@registered(f"WITH {_NODES} SELECT * FROM v")
def version_diff(spark, d):
    return admin.version_report(_nodes(spark, d)).select("node", F.size("differences").alias("different"), "reason")


@registered(f"WITH {_NODES} SELECT count(*) AS active_nodes, count(reason) = 0 AS all_versions_ok, count(*) FILTER (different > 0) > 0 AS settings_differences FROM v")
def version_summary(spark, d):
    return admin.version_summary(_nodes(spark, d))


@registered(f"WITH {_NODES}, o AS (SELECT node, reason, row_number() OVER (ORDER BY node) AS nr FROM v) SELECT node, nr, nr = (SELECT min(nr) FROM o WHERE reason IS NOT NULL) AS named FROM o")
def version_node_order(spark, d):
    from foliant.plans import endpoints

    got = endpoints.version_response(_nodes(spark, d))
    named = got.get("version-diff", {}).get("node")
    return spark.createDataFrame([(n["node"], k + 1, n["node"] == named) for k, n in enumerate(got["nodes"])], "node string, nr long, named boolean")


@registered("""SELECT n_name AS node, CASE WHEN n_nationkey % 3 = 0 THEN 'early' ELSE 'late' END AS version FROM nation""")
def node_merge(spark, d):
    """The first report of each node counts; for every third it is the one that another came before."""
    late = _nodes(spark, d).withColumn("version", F.lit("late")).withColumn("at", F.lit(5))
    keys = table(spark, d, "nation").where("n_nationkey % 3 = 0").select(F.col("n_name").alias("node"))
    early = _nodes(spark, d).join(keys, "node").withColumn("version", F.lit("early")).withColumn("at", F.lit(2))
    return admin.merged_nodes(late.unionByName(early), "at").select("node", "version")


@registered("SELECT \"index\", count(*) AS n FROM (SELECT 'documents' AS \"index\" FROM documents UNION ALL SELECT 'benchmark' FROM benchmark) GROUP BY 1")
def index_selection(spark, d):
    tables = {t: table(spark, d, t) for t in ("documents", "benchmark", "nation")}
    return indexes(tables, "documents,benchmark").groupBy(F.col("_index").alias("index")).agg(F.count("*").alias("n"))


@registered("SELECT 'p_brand' AS name UNION ALL SELECT 'p_type'")
def selector_names(spark, d):
    names = Selector("!p_size,p_name", "^p_[bt]").of(table(spark, d, "part").columns)
    return spark.createDataFrame([(n,) for n in names], "name string")


@registered("SELECT n_name, regexp_extract(n_name, '([A-Z]+)', 1) || 'x' AS made FROM nation")
def regex_template_escape(spark, d):
    return table(spark, d, "nation").select("n_name", extracted_by(F.col("n_name"), "([A-Z]+)/$1x").alias("made"))


@registered(f"""SELECT role, count(*) AS count, count(DISTINCT conv_id) AS conversations FROM conversations WHERE {_TALKS} GROUP BY 1""")
def search_body(spark, d):
    from foliant.plans import dsl

    nested = dict(bm_match_nested={"query": {"match_all": {}}})
    counted = dict(bm_undup_by_parents=dict(parent_paths="_nested_"))
    roles = dict(terms=dict(field="role", size=10), aggs=dict(conversations=counted))
    body = dict(query=nested, aggs=dict(roles=roles))
    return dsl.run(_conversations(spark, d), body, dsl.Schema(from_files=False)).aggs["roles"]


@registered("""SELECT l_linenumber, count(*) AS count, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1 ORDER BY orders, l_linenumber DESC LIMIT 4""")
def search_body_order(spark, d):
    """Buckets ordered by a count of parents; the limit is the aggregation's size."""
    from foliant.plans import dsl

    counted = dict(bm_undup_by_parents=dict(parent_paths="orders"))
    by = dict(field="l_linenumber", size=4, order=[dict(orders="asc"), dict(_key="desc")])
    lines = model(_lines(spark, d), "l_orderkey")
    schema = dsl.Schema(_parents(spark, d), _KEYS, from_files=False)
    return dsl.run(lines, dict(aggs=dict(numbers=dict(terms=by, aggs=dict(orders=counted)))), schema).aggs["numbers"]
