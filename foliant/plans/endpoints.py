"""Requests as flat parameters, responses as JSON-able dictionaries with a header and a payload.

The work is a plan each; only what a response lists is collected, and lists have a limit unless the request
lifts it.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.ranges import int_range
from foliant.functions.selector import Selector
from foliant.operators import admin, termlist, view
from foliant.operators.termlist import Mapping, Request


def _checked(params: dict, allowed: set[str]) -> dict:
    unknown = set(params) - allowed
    if unknown:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    return params


def _flag(params: dict, name: str, default: bool) -> bool:
    value = params.get(name, default)
    if isinstance(value, bool):
        return value
    if str(value).lower() not in ("true", "false"):
        raise ValueError(f"{name} must be true or false")
    return str(value).lower() == "true"


def parse_termlist(params: dict) -> Request:
    """A term-list request; ``mode`` and ``output`` are accepted and have no effect."""
    own = _checked(params, set(Request.__dataclass_fields__) | {"mode", "output"})
    values = {k: own[k] for k in Request.__dataclass_fields__ if own.get(k) not in (None, "")}
    values["result_limit"] = int(values.get("result_limit", Request.result_limit))
    values["collisions_only"] = _flag(own, "collisions_only", True)
    return Request(**values)


def _echo(request: Request) -> dict:
    """A request as it is understood, all defaults in place."""
    names = ("field", "range", "filter", "not_filter", "count", "length", "result_limit", "repl_expr", "collisions_only", "sort")
    out = {n: getattr(request, n) for n in names}
    return out | {n: out[n] or "" for n in ("count", "length")} | {"sort": termlist.order_name(request.sort)}


def _fields(tables: dict[str, DataFrame], mapping: Mapping, wanted: list[str] | None = None) -> dict:
    """What is known of each field, by index, then field."""
    out: dict = {}
    for r in termlist.field_catalog(tables, mapping, wanted).collect():
        numbers = {"es_type": r.type, "doc_count": r.doc_count, "term_count": r.term_count, "term_lo": r.lo, "term_hi": r.hi}
        out.setdefault(r["index"], {})[r.field] = termlist.field_options(tables[r["index"]], r.field, mapping) | numbers
    return out


def termlist_response(tables: dict[str, DataFrame], params: dict, mapping: Mapping = Mapping()) -> dict:
    """Terms, collisions, fields of a term, or without a field the catalog of all fields.

    The list is aggregated once: totals, limit and collisions are taken from it.
    """
    request = parse_termlist(params)
    head = {"request": _echo(request)}
    none = {"count": request.count or "", "maxOccCount": 0, "itemCount": 0, "filteredItemCount": 0}
    if request.term is not None:
        rows = termlist.term_fields(tables, request.term, mapping).orderBy("index", F.lower("field")).collect()
        names = {r.field for r in rows}
        found = {"maxOccCount": max((sum(r["count"] for r in rows if r.field == n) for n in names), default=0), "itemCount": len(names), "filteredItemCount": len(names)}
        return head | {"response": none | found | {"fields": {}, "term_fields": [r.asDict() for r in rows]}}
    if request.field is None:
        return head | {"response": none | {"fields": _fields(tables, mapping), "terms": []}}
    every = termlist.term_list(tables, replace(request, count=None), mapping).persist()
    try:
        stats = termlist.limits(every, request).head()
        out = {"count": request.count or "", "maxOccCount": stats.max_occ_count, "itemCount": stats.item_count, "filteredItemCount": stats.filtered_item_count}
        out["fields"] = _fields({i: df for i, df in tables.items() if request.fields(df)}, mapping, request.field.split(","))
        if request.repl_expr:
            found = termlist.collisions(every, request).persist()
            out["collisionCount"] = found.count()
            out["collisions"] = [{"term": {"t": r["term"], "c": r["count"]}, "coll": {"t": r["collision"], "c": r["collision_count"]}} for r in termlist.limited_collisions(found, request).collect()]
            found.unpersist()
        else:
            listed = every.where(int_range(request.count).contains(F.col("count"))) if request.count else every
            out["terms"] = [{"t": r["term"], "c": r["count"]} for r in termlist.limited(listed, request).collect()]
    finally:
        every.unpersist()
    return head | {"response": out}


def view_response(tables: dict[str, DataFrame] | DataFrame, key: str, params: dict, mapping: Mapping = Mapping()) -> dict:
    """The document with ``id``: its stored fields, and per field terms, places and values.

    Of several tables that hold the id, the last one's document is shown.
    """
    own = _checked(params, {"type", "id", "field", "field_expr", "output", "output_lvl", "offset", "postings", "dense"})
    asked = {"field": own.get("field"), "field_expr": own.get("field_expr"), "output": own.get("output"), "output_lvl": int(own.get("output_lvl", 0)), "postings": _flag(own, "postings", False), "dense": _flag(own, "dense", False), "offset": int(own.get("offset", 0))}
    shown = None
    for df in tables.values() if isinstance(tables, dict) else [tables]:
        doc = view.lookup(df, key, own["id"], asked["offset"])
        if not doc.isEmpty():
            shown = _document(doc, asked, mapping)
    return {"request": asked} | ({"doc": shown} if shown is not None else {})


def _document(doc: DataFrame, asked: dict, mapping: Mapping) -> dict:
    fields, output, level = Selector(asked["field"], asked["field_expr"]), Selector(asked["output"]), asked["output_lvl"]
    out: dict = {}
    if output.selects("stored"):
        out["storedFields"] = [{k: v for k, v in r.asDict().items() if level > 0 or k not in ("value_bin", "value_binstr", "type", "class")} for r in view.stored(doc, fields, mapping, level).withColumnRenamed("field", "name").collect()]
    if not output.selects("indexed") and not output.selects("docvalues"):
        return out
    values = {r.field: {"count": r["count"], "values": r["values"]} for r in view.docvalues(doc, fields, mapping, level).collect()} if output.selects("docvalues") else {}
    items = []
    for name in view.field_order(fields.of(doc.columns)):
        options = termlist.field_options(doc, name, mapping)
        kind = doc.schema[name].dataType
        item: dict = {"name": name, "class": type(kind).__name__, "mappedType": mapping.type_of(doc, name), "mappedClass": mapping.class_of(doc, name), "type": options["indexOptions"], "dv-type": options["docValuesOptions"]}
        if output.selects("indexed"):
            text = mapping.is_text(doc, name)
            rows = view.indexed(doc, name, mapping)
            item["terms"] = [r["term"] for r in (rows.orderBy("ord") if text else rows).collect()]
            if text and asked["postings"]:
                item["postings"] = {r["term"]: [p if isinstance(p, str) else p.asDict() for p in r.postings] for r in view.postings(doc, name, mapping, asked["dense"]).collect()}
        if name in values:
            item["docvalues"] = values[name]
        items.append(item)
    return out | {"indexedFields": items}


def cache_response(spark: SparkSession, params: dict, entries: DataFrame | None = None) -> dict:
    """What is cached, by index; ``index_expr`` of ``null`` or nothing keeps all in one index."""
    own = _checked(params, {"type", "index_expr", "sort", "dump_raw"})
    entries = admin.cache_dump(spark) if entries is None else entries
    expr = own.get("index_expr", "default")
    expr = "" if expr == "default" else None if expr in (None, "", "null") else expr
    by_index: dict = {}
    for r in admin.cache_report(entries, own.get("type", "query"), expr, own.get("sort", "size")).collect():
        by_index.setdefault(r["index"], []).append({"query": r["query"], "ram": r.ram, "ram_pretty": r.ram_pretty})
    out: dict = {"request": own, "index_caches": [{"index": i, "caches": c} for i, c in by_index.items()]}
    if _flag(own, "dump_raw", False):
        out["raw_keys"] = [r.key for r in admin.raw_keys(entries).orderBy("key").collect()]
    return out


def version_response(nodes: DataFrame, order: str | None = None) -> dict:
    """The first node in full, the others by how they differ from it; the first that differs is named with the reason."""
    unique = admin.merged_nodes(nodes, order).persist()
    try:
        report = admin.version_report(unique).orderBy("node").collect()
        first = unique.orderBy("node").head()
        rest = [r for r in report if r.node != first.node]
        differing = next((r for r in rest if r.reason), None)
        # settings are compared up to the first node that differs otherwise
        compared = rest[: rest.index(differing) + 1] if differing else rest
        settings = sorted({k for r in compared for k in r.differences})
        out: dict = {"all-versions-ok": first is not None and differing is None}
        if settings:
            out["settings-differences"] = ", ".join(settings)
        if differing:
            out["version-diff"] = {"node": differing.node, "reason": differing.reason}
        return out | {"activeNodes": len(report), "nodes": ([first.asDict()] if first else []) + [{"node": r.node, "differences": r.differences} for r in rest]}
    finally:
        unique.unpersist()
