"""Lists of the terms of fields, with filters, sorting, limits and collisions.

Each field is analysed into ``(index, field, term, count)``: for text the number of documents that hold the term,
for numbers and dates the number of values.  Deleted documents are counted as well.  Filters on terms run before
the aggregation, the range of counts after it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.analysis import blank_tokens, tokens
from foliant.functions.ranges import int_range, value_range
from foliant.functions.replace import replaced
from foliant.functions.typed import SQL_TYPES, mapping_type, show

#: Analyzers by name: from a column to an array of terms.
ANALYZERS = {"standard": tokens, "whitespace": blank_tokens, "keyword": lambda c: F.array_compact(F.array(c)), "terms": lambda c: c}


@dataclass(frozen=True)
class Mapping:
    """How fields are indexed: ``analyzers`` by field (``standard`` for text by default), mapping types by field."""

    analyzers: dict[str, str] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)

    def type_of(self, df: DataFrame, name: str) -> str:
        return self.types.get(name, mapping_type(df.schema[name].dataType))

    def terms(self, df: DataFrame, name: str) -> Column:
        """All terms or values of a field, as an array."""
        kind = df.schema[name].dataType
        if name in self.analyzers:
            return ANALYZERS[self.analyzers[name]](F.col(name))
        if isinstance(kind, T.ArrayType):
            return F.array_compact(F.coalesce(F.col(name), F.array().cast(kind)))
        if isinstance(kind, T.StringType):
            return tokens(F.col(name))
        return F.array_compact(F.array(F.col(name)))

    def class_of(self, df: DataFrame, name: str) -> str:
        """The analyzer of a text, the SQL type of any other field."""
        if self.is_text(df, name):
            return self.analyzers.get(name, "terms" if isinstance(df.schema[name].dataType, T.ArrayType) else "standard")
        return SQL_TYPES.get(self.type_of(df, name), "binary")

    def is_text(self, df: DataFrame, name: str) -> bool:
        return SQL_TYPES.get(self.type_of(df, name)) == "string"


@dataclass(frozen=True)
class Request:
    """Parameters of a term list.  ``sort`` is ``term``, ``-term``, ``count`` or ``-count``.

    ``sort="term"`` and the default list terms *descending*, ``-term`` ascending: the order of the engine
    that this agrees with, visible under a limit.
    """

    field: str | None = None
    term: str | None = None
    range: str | None = None
    filter: str | None = None
    not_filter: str | None = None
    length: str | None = None
    count: str | None = None
    repl_expr: str | None = None
    collisions_only: bool = True
    sort: str = "term"
    result_limit: int = 20000

    def __post_init__(self):
        order_name(self.sort)
        int_range(self.length), int_range(self.count)

    def fields(self, df: DataFrame) -> list[str]:
        """Columns that are asked for; names ignore case, unknown ones are left out."""
        wanted = {f.strip().lower() for f in (self.field or "").split(",")} - {""}
        return [c for c in df.columns if c.lower() in wanted]


#: Column and whether it descends, by the beginning of the name.
_ORDERS = {"-term": [("term", False)], "term": [("term", True)], "-count": [("count", True), ("term", False)], "count": [("count", False), ("term", False)]}


def order_name(name: str) -> str:
    for start in _ORDERS:
        if (name or "term").lower().startswith(start):
            return start
    raise ValueError(f"unknown sort order: {name!r}")


def sort_order(name: str) -> list[Column]:
    return [F.desc(c) if down else F.asc(c) for c, down in _ORDERS[order_name(name)]]


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond U+FFFF count twice."""
    return F.length(text) + F.length(F.regexp_replace(text, "[^\\x{10000}-\\x{10FFFF}]", ""))


def field_terms(df: DataFrame, name: str, mapping: Mapping, request: Request = Request(), index: str = "") -> DataFrame:
    """``index, field, term, count`` of one field, filtered by term."""
    text = mapping.is_text(df, name)
    value = mapping.terms(df, name)
    kind = "string" if text else None
    # terms of one row are made distinct before they are exploded: counting rows is then counting documents
    rows = df.select(F.explode(F.array_distinct(value) if text else value).alias("term"))
    if text:
        if request.filter:
            rows = rows.where(F.col("term").rlike(request.filter))
        if request.not_filter:
            rows = rows.where(~F.col("term").rlike(request.not_filter))
        if request.length:
            rows = rows.where(int_range(request.length).contains(utf16_length(F.col("term"))))
    if request.range:
        sql_type = kind or dict(rows.dtypes)["term"]
        rows = rows.where(value_range(request.range).contains(F.col("term"), sql_type))
    return rows.groupBy("term").agg(F.count("*").alias("count")).select(F.lit(index).alias("index"), F.lit(name).alias("field"), "term", "count")


def term_list(tables: dict[str, DataFrame] | DataFrame, request: Request, mapping: Mapping = Mapping()) -> DataFrame:
    """``term, count``, counts of all listed fields and tables added up; filtered, but neither sorted nor limited.

    Fields of one list must have the same type.
    """
    named = tables if isinstance(tables, dict) else {"": tables}
    parts = [field_terms(df, f, mapping, request, index) for index, df in named.items() for f in request.fields(df)]
    if not parts:
        raise ValueError(f"no such field: {request.field!r}")
    kinds = {dict(p.dtypes)["term"] for p in parts}
    if len(kinds) > 1:
        raise ValueError(f"fields of different types can't be listed together: {sorted(kinds)}")
    both = reduce(DataFrame.unionByName, parts).groupBy("term").agg(F.sum("count").alias("count"))
    return both.where(int_range(request.count).contains(F.col("count"))) if request.count else both


def limited(listed: DataFrame, request: Request) -> DataFrame:
    """The list in its order, cut at the limit (none if it isn't positive)."""
    ordered = listed.orderBy(*sort_order(request.sort))
    return ordered.limit(request.result_limit) if request.result_limit > 0 else ordered


def ranked(listed: DataFrame, request: Request) -> DataFrame:
    """``limited`` with the ``rank`` of each row; the limit comes first, so only its rows are numbered in one place."""
    return limited(listed, request).withColumn("rank", F.row_number().over(Window.orderBy(*sort_order(request.sort))))


def limits(all_terms: DataFrame, request: Request) -> DataFrame:
    """One row: ``item_count, filtered_item_count, max_occ_count`` of a list made without its count range."""
    kept = int_range(request.count).contains(F.col("count"))
    return all_terms.agg(F.count("*").alias("item_count"), F.count_if(kept).alias("filtered_item_count"), F.coalesce(F.max("count"), F.lit(0)).alias("max_occ_count"))


def collisions(listed: DataFrame, request: Request) -> DataFrame:
    """``term, count, collision, collision_count``: terms that after ``repl_expr`` equal a term of the same list.

    A term that the replacement leaves alone takes no part; with ``collisions_only`` off, changed terms that
    meet none come with the count 0.
    """
    # each term goes to its own key and to that of its replacement, so the list is made only once
    own = F.struct(F.col("term").alias("key"), F.lit(None).cast("string").alias("changed"))
    other = F.struct(replaced(F.col("term"), request.repl_expr).alias("key"), F.col("term").alias("changed"))
    both = listed.select("count", F.explode(F.array(own, other)).alias("k")).select("count", "k.*").where("key is not null")
    met = both.withColumn("met", F.max(F.when(F.col("changed").isNull(), F.col("count"))).over(Window.partitionBy("key"))).where("changed is not null")
    if request.collisions_only:
        met = met.where("met is not null")
    return met.select(F.col("changed").alias("term"), "count", F.col("key").alias("collision"), F.coalesce("met", F.lit(0)).alias("collision_count"))


def limited_collisions(found: DataFrame, request: Request) -> DataFrame:
    """Collisions cut at the limit, by term: ascending for ``-term``, else descending, also where counts are the list's order."""
    ordered = found.orderBy(F.asc("term") if order_name(request.sort) == "-term" else F.desc("term"))
    return ordered.limit(request.result_limit) if request.result_limit > 0 else ordered


def term_fields(tables: dict[str, DataFrame], term: str, mapping: Mapping = Mapping()) -> DataFrame:
    """``index, field, count``: documents that hold a term, by field; fields that begin with ``_`` are left out.

    Each table is read once, with one counter per field.
    """
    parts = []
    for index, df in tables.items():
        names = [c for c in df.columns if not c.startswith("_") and mapping.is_text(df, c)]
        if names:
            counts = df.agg(*[F.count_if(F.array_contains(mapping.terms(df, c), term)).alias(c) for c in names])
            pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").alias("count")) for c in names])
            parts.append(counts.select(F.lit(index).alias("index"), F.explode(pairs).alias("p")).select("index", "p.*"))
    return reduce(DataFrame.unionByName, parts).where("count > 0")


#: Columns that carry the ends of a field's values in their own order, by the SQL type that holds them.
_ENDS = {"n": "bigint", "d": "double", "t": "timestamp_ntz", "s": "string"}


def _end_column(kind: T.DataType) -> str:
    if isinstance(kind, T.IntegralType):
        return "n"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "d"
    return "t" if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else "s"


def field_catalog(tables: dict[str, DataFrame], mapping: Mapping = Mapping(), wanted: list[str] | None = None) -> DataFrame:
    """``index, field, type, doc_count, term_count, lo, hi`` of each field, by index, then name without case.

    Each table is read once: a row becomes its fields' different values, each as text, and per field one entry that
    counts the document and carries its least and greatest value.  Entries are aggregated per value, then per field.
    Rows of one index and field (of several parts of a table) combine as sum, largest, least and greatest.
    """
    parts = []
    for index, df in tables.items():
        names = [c for c in df.columns if wanted is None or c.lower() in {w.lower() for w in wanted}]
        if not names:
            continue
        kinds = [mapping.type_of(df, c) for c in names]
        values = df.select(*[F.array_distinct(mapping.terms(df, c)).alias(f"v{i}") for i, c in enumerate(names)])
        element = [values.schema[f"v{i}"].dataType.elementType for i in range(len(names))]
        entries = []
        for i, kind in enumerate(element):
            v, own = F.col(f"v{i}"), _end_column(kind)
            text = F.col(f"v{i}") if isinstance(kind, T.StringType) else F.transform(v, lambda x: x.cast("string"))

            def end(of, v=v, own=own):
                return [(of(v) if c == own else F.lit(None)).cast(t).alias(f"{of.__name__}_{c}") for c, t in _ENDS.items()]

            none = [F.lit(None).cast(t).alias(f"{e}_{c}") for e in ("array_min", "array_max") for c, t in _ENDS.items()]
            entries.append(F.when(F.size(v) > 0, F.array(F.struct(F.lit(i).alias("f"), F.lit(None).cast("string").alias("v"), *end(F.array_min), *end(F.array_max)))))
            entries.append(_entries(text, i, none))
        rows = values.select(F.explode(F.flatten(F.array_compact(F.array(*entries)))).alias("e")).select("e.*")
        lows, highs = [f"array_min_{c}" for c in _ENDS], [f"array_max_{c}" for c in _ENDS]
        ends = [F.min(c).alias(c) for c in lows] + [F.max(c).alias(c) for c in highs]
        per = rows.groupBy("f", "v").agg(F.count("*").alias("docs"), *ends).groupBy("f").agg(F.coalesce(F.max(F.when(F.col("v").isNull(), F.col("docs"))), F.lit(0)).alias("doc_count"), F.count("v").alias("term_count"), *ends)
        # a field without any value has a row as well
        every = df.sparkSession.createDataFrame([(i, c, k) for i, (c, k) in enumerate(zip(names, kinds))], "f int, field string, type string")
        per = F.broadcast(every).join(per, "f", "left")
        lo, hi = F.lit(None).cast("string"), F.lit(None).cast("string")
        for i, (kind, name) in enumerate(zip(element, kinds)):
            own = _end_column(kind)
            lo = F.when(F.col("f") == i, show(F.col(f"array_min_{own}").cast(kind), name)).otherwise(lo)
            hi = F.when(F.col("f") == i, show(F.col(f"array_max_{own}").cast(kind), name)).otherwise(hi)
        parts.append(per.select(F.lit(index).alias("index"), "field", "type", F.coalesce("doc_count", F.lit(0)).alias("doc_count"), F.coalesce("term_count", F.lit(0)).alias("term_count"), lo.alias("lo"), hi.alias("hi")))
    return reduce(DataFrame.unionByName, parts).orderBy("index", F.lower("field"))


def _entries(values: Column, number: int, rest: list[Column]) -> Column:
    return F.transform(values, lambda x: F.struct(F.lit(number).alias("f"), x.alias("v"), *rest))


def field_options(df: DataFrame, name: str, mapping: Mapping = Mapping()) -> dict[str, str]:
    """How a field is indexed and whether it has a column: as the catalog says it."""
    kind = mapping.type_of(df, name)
    if mapping.is_text(df, name):
        analysed = kind != "keyword" and mapping.analyzers.get(name) != "keyword"
        return {"indexOptions": "DOCS_AND_FREQS_AND_POSITIONS" if analysed else "DOCS", "docValuesOptions": "FIELDDATA" if analysed else "SORTED_SET"}
    width = {"bigint": 8, "int": 4, "smallint": 4, "tinyint": 4, "float": 4, "double": 8, "timestamp_ntz": 8}.get(SQL_TYPES.get(kind, ""), 0)
    points = "POINTS(2::4)" if kind == "geo_point" else f"POINTS(1::{width})" if width else "DOCS" if kind in ("bool", "boolean") else "NONE"
    return {"indexOptions": points, "docValuesOptions": "BINARY" if kind == "binary" else "SORTED_NUMERIC"}


def combined_stats(parts: DataFrame) -> DataFrame:
    """Field statistics of several parts of a table as one: documents add up, of terms the largest number counts."""
    return parts.groupBy("index", "field", "type").agg(F.sum("doc_count").alias("doc_count"), F.max("term_count").alias("term_count"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def text_rows(listed: DataFrame) -> DataFrame:
    """A line of text per term, the count right-aligned in front."""
    return listed.select(F.format_string("%6d;%s\r\n", F.col("count"), F.col("term").cast("string")).alias("line"))
