"""Search bodies, as JSON objects, to plans.

``{"query": …, "aggs": …, "ext": …, "size": n}`` becomes a DataFrame of hits and one per aggregation.  Parsing is
strict: unknown keys and values of the wrong kind are errors.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators import queries as Q
from foliant.operators.diagnostics import parse_ext, with_diagnostics
from foliant.operators.parents import Parent, terms, undup


def _only(body, name: str, allowed: set[str]) -> dict:
    if not isinstance(body, dict):
        raise ValueError(f"[{name}] must be an object")
    unknown = set(body) - allowed
    if unknown:
        raise ValueError(f"[{name}] doesn't support {sorted(unknown)}")
    return body


def parse_query(body: dict | None) -> Q.Query:
    """A query object with exactly one query in it; None matches all."""
    if body is None:
        return Q.MatchAll()
    if not isinstance(body, dict) or len(body) != 1:
        raise ValueError("a query is an object with one key")
    name, own = next(iter(body.items()))
    if name == "match_all":
        _only(own, name, set())
        return Q.MatchAll()
    if name == "term":
        if not isinstance(own, dict) or len(own) != 1:
            raise ValueError("[term] takes one field")
        column, value = next(iter(own.items()))
        if isinstance(value, dict):
            value = _only(value, name, {"value"})["value"]
        return Q.Term(column, value)
    if name == "bool":
        def many(key: str) -> tuple[Q.Query, ...]:
            found = own.get(key, [])
            return tuple(parse_query(q) for q in (found if isinstance(found, list) else [found]))

        _only(own, name, {"must", "filter", "should", "must_not", "minimum_should_match"})
        least = own.get("minimum_should_match")
        return Q.Bool(many("must") + many("filter"), many("should"), many("must_not"), None if least is None else int(least))
    wrapped = {"bm_match_deleted": Q.MatchDeleted, "bm_fuzzy": Q.Fuzzy, "bm_match_nested": Q.MatchNested, "bm_allow_nested": Q.AllowNested}
    if name not in wrapped:
        raise ValueError(f"no such query: {name}")
    _only(own, name, {"query"})
    if name == "bm_allow_nested" and "query" not in own:
        raise ValueError("[bm_allow_nested] requires a query")
    return wrapped[name](parse_query(own.get("query")))


@dataclass(frozen=True)
class UndupRequest:
    parent_paths: str
    resilient: bool = False
    cache_bitsets: bool = True
    compensate_non_existing: bool = True
    debug: object = 0

    @staticmethod
    def parse(body: dict) -> UndupRequest:
        own = _only(body, "bm_undup_by_parents", set(UndupRequest.__dataclass_fields__))
        if "parent_paths" not in own:
            raise ValueError("[bm_undup_by_parents] requires parent_paths")
        for flag in ("resilient", "cache_bitsets", "compensate_non_existing"):
            if not isinstance(own.get(flag, True), bool):
                raise ValueError(f"[bm_undup_by_parents] {flag} must be true or false")
        return UndupRequest(**own)

    def body(self) -> dict:
        return {k: getattr(self, k) for k in self.__dataclass_fields__}


@dataclass(frozen=True)
class Schema:
    """What aggregations need to know: parents by type, key columns by level, and the name of the table."""

    parents: dict[str, Parent] = field(default_factory=dict)
    keys: dict[str, str] = field(default_factory=dict)
    index: str = ""
    from_files: bool = True


@dataclass(frozen=True)
class Result:
    hits: DataFrame
    aggs: dict[str, DataFrame]


def run(docs: DataFrame, body: dict, schema: Schema = Schema()) -> Result:
    """Hits, and for each ``terms`` aggregation its buckets with a column per sub-aggregation."""
    _only(body, "search", {"query", "aggs", "aggregations", "ext", "size"})
    found = Q.search(docs, parse_query(body.get("query")))
    aggs = {name: _terms(found, own, schema) for name, own in (body.get("aggs") or body.get("aggregations") or {}).items()}
    hits = found
    if parse_ext(body.get("ext")):
        hits = with_diagnostics(hits, str(body.get("query", {"match_all": {}})), schema.index, schema.from_files)
    if "size" in body:
        hits = hits.limit(int(body["size"]))
    return Result(hits, aggs)


def _terms(found: DataFrame, body: dict, schema: Schema) -> DataFrame:
    """Buckets with a column per count of parents; ordered by rows, key or one of these counts.

    Without an order, or by rows or key, only the buckets that are shown are counted by parents; by such a count all are.
    """
    own = _only(body, "aggregation", {"terms", "aggs", "aggregations"})
    by = _only(own.get("terms"), "terms", {"field", "size", "order"})
    subs = {}
    for name, sub in (own.get("aggs") or own.get("aggregations") or {}).items():
        subs[name] = UndupRequest.parse(_only(sub, "aggregation", {"bm_undup_by_parents"})["bm_undup_by_parents"])
    field, size = by["field"], by.get("size", 10)
    order, metric = _bucket_order(by.get("order"), subs)
    out = terms(found, field, None if metric else size, None if metric else order).withColumnRenamed("key", field)
    for name, request in subs.items():
        counted = undup(found, field, request.parent_paths, schema.parents, schema.keys, buckets=out.select(field), compensate_non_existing=request.compensate_non_existing, resilient=request.resilient, alias=name)
        out = out.join(counted, field, "left")
    if metric or subs:
        out = out.orderBy(*(_bucket_order(by.get("order"), subs, field)[0] or [F.desc("count")]), field)
    return out.limit(size) if metric else out


def _bucket_order(wanted: dict | list | None, subs: dict, key: str = "key") -> tuple[list[Column], bool]:
    """Columns to order buckets by, and whether a count of parents is among them."""
    found, metric = [], False
    for one in wanted if isinstance(wanted, list) else [wanted] if wanted else []:
        if not isinstance(one, dict) or len(one) != 1:
            raise ValueError("[order] takes one name with asc or desc, or a list of such")
        name, way = next(iter(one.items()))
        if way not in ("asc", "desc"):
            raise ValueError(f"[order] must be asc or desc, not {way!r}")
        name = name.removesuffix(".value").removesuffix(".doc_count")
        if name not in ("_count", "_key") and name not in subs:
            raise ValueError(f"[order] knows no {name!r}")
        metric |= name in subs
        column = F.col({"_count": "count", "_key": key}.get(name, name))
        found.append(column.asc() if way == "asc" else column.desc())
    return found, metric
