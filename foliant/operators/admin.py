"""Reports about caches and settings, and help."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.formats import printable, size_text
from foliant.functions.replace import extracted_by, remainder

#: Default expressions that split a cache key into index and query.
_SHARD_PATH = "/indices/(.*)/[0-9]*/index"
INDEX_EXPR = {"request": "([^ ]+ [^ ]+ )/$1", "query": _SHARD_PATH.replace("/", "//") + "/$1", "bitset": "(.*)/$1"}
#: Settings in which nodes may differ.
IGNORED_SETTINGS = ("name", "node.name", "node.id", "node.tag", "node.data", "http.enabled")

HELP = {
    "termlist": "Terms of fields, with filters, ranges, sorting and collisions",
    "view": "Stored values, terms and columns of one document",
    "cache_dump": "What is cached, by index and query",
    "version": "Versions and settings of the nodes, and how they differ",
}


#: Where those are sent who don't ask for JSON.
HELP_PAGE = "README.md#how-the-operators-map-to-plans"


def help_page() -> dict:
    """The operations on offer, the settings of the score, and the parameters of parent counts."""
    from dataclasses import asdict

    from foliant.operators.similarity import Settings

    return {"operations": HELP, "score_settings": asdict(Settings()), "parent_counts": ["parent_paths", "compensate_non_existing", "resilient"]}


def help_response(accept: str | None = None) -> dict:
    """The help for a request that accepts JSON or JavaScript, a redirect to the page for any other."""
    if accept is not None and ("application/json" in accept or "text/javascript" in accept):
        return {"status": 200, "body": help_page()}
    return {"status": 302, "headers": {"Location": HELP_PAGE}, "body": HELP_PAGE}


def split_key(key: Column, kind: str, index_expr: str | None = "") -> tuple[Column, Column]:
    """Index and query of a cache key.

    An empty expression takes the default of the kind; None keeps all in one index, ``_ALL``.  A key that the
    expression doesn't match belongs to ``?``.
    """
    text = printable(key) if kind == "request" else key
    if index_expr is None:
        return F.lit("_ALL"), text
    expr = index_expr or INDEX_EXPR[kind]
    return F.coalesce(F.trim(extracted_by(text, expr)), F.lit("?")), F.trim(remainder(text, expr))


def cache_report(entries: DataFrame, kind: str = "query", index_expr: str | None = "", sort: str = "size") -> DataFrame:
    """``index, query, ram, ram_pretty`` of entries ``key, bytes``, the same index and query added up."""
    if kind not in INDEX_EXPR:
        raise ValueError(f"unknown kind of cache: {kind!r}")
    if sort not in ("query", "size"):
        raise ValueError(f"unknown sort order: {sort!r}")
    index, query = split_key(F.col("key"), kind, index_expr)
    out = entries.select(index.alias("index"), query.alias("query"), "bytes").groupBy("index", "query").agg(F.sum("bytes").alias("ram"))
    out = out.withColumn("ram_pretty", size_text(F.col("ram")))
    return out.orderBy("index", "query") if sort == "query" else out.orderBy("index", F.desc("ram"), "query")


def raw_keys(entries: DataFrame) -> DataFrame:
    """Distinct keys of all nodes."""
    return entries.select("key").distinct()


def cache_dump(spark: SparkSession) -> DataFrame:
    """``key, bytes`` of what this session has cached; one entry per cached plan."""
    infos = spark.sparkContext._jsc.sc().getRDDStorageInfo()
    rows = [(i.name(), int(i.memSize() + i.diskSize())) for i in infos]
    return spark.createDataFrame(rows, "key string, bytes long")


def node_settings(spark: SparkSession) -> DataFrame:
    """``node, version, settings`` of this session, as one node."""
    settings = dict(spark.sparkContext.getConf().getAll())
    return spark.createDataFrame([(settings.get("spark.driver.host", "driver"), spark.version, settings)], "node string, version string, settings map<string, string>")


def merged_nodes(nodes: DataFrame, order: str | None = None) -> DataFrame:
    """One row per node, the first by ``order``; without one, the first by its values, so that the result is fixed."""
    rest = [c for c in nodes.columns if c != "node"]
    plain = [F.to_json(F.struct(F.array_sort(F.map_entries(c)))).alias(c) if isinstance(nodes.schema[c].dataType, T.MapType) else F.col(c) for c in rest]
    by = F.struct(*([F.col(order)] if order else []), *plain)
    return nodes.groupBy("node").agg(*[F.min_by(c, by).alias(c) for c in rest])


def version_report(nodes: DataFrame, order: str | None = None) -> DataFrame:
    """``node, differences, reason`` of each node against the first by name.

    ``differences`` maps settings of the first node that this one lacks or has otherwise to both values; settings
    alone are no reason.  That is the first of ``ES-Version``, ``location`` and ``size`` in which the nodes differ;
    what the first node doesn't know differs from everything, and so does a size of 0.  Of repeated nodes the first
    by ``order`` counts.
    """
    fields = [("version", "ES-Version"), *((c, c) for c in ("location", "size") if c in nodes.columns)]
    unique = merged_nodes(nodes, order)
    first = unique.orderBy("node").limit(1).select(*[F.col(c).alias(f"first_{c}") for c in ("node", "settings", *(c for c, _ in fields))])
    both = unique.crossJoin(F.broadcast(first))  # one row
    kept = F.map_filter(F.coalesce("first_settings", F.create_map().cast("map<string, string>")), lambda k, v: ~k.isin(*IGNORED_SETTINGS) & ~F.coalesce(F.try_element_at(F.col("settings"), k) == v, F.lit(False)))
    differences = F.transform_values(kept, lambda k, v: F.concat_ws(" | ", v, F.coalesce(F.try_element_at(F.col("settings"), k), F.lit("-"))))
    reason = F.when(F.col("node") == F.col("first_node"), F.lit(None).cast("string"))
    for c, name in fields:
        other = F.col(f"first_{c}").isNull() | ~F.col(c).eqNullSafe(F.col(f"first_{c}"))
        reason = reason.when(other | (F.col(f"first_{c}") == 0) if c == "size" else other, name)
    return both.select("node", differences.alias("differences"), reason.alias("reason"))


def version_summary(nodes: DataFrame) -> DataFrame:
    """One row: ``active_nodes, all_versions_ok, settings_differences``."""
    return version_report(nodes).agg(F.count("*").alias("active_nodes"), ((F.count("reason") == 0) & (F.count("*") > 0)).alias("all_versions_ok"), (F.count_if(F.size("differences") > 0) > 0).alias("settings_differences"))
