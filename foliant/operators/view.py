"""A detailed view of one document: stored values, indexed terms with their places, and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.formats import grouped_hex
from foliant.functions.selector import Selector
from foliant.functions.typed import show
from foliant.operators.termlist import Mapping

SECTIONS = ("stored", "indexed", "docvalues")


def lookup(df: DataFrame, key: str, value, offset: int = 0, segment: Column | None = None, order: Column | None = None) -> DataFrame:
    """The document with a key, or the one ``offset`` rows after it in its segment; no row if there is none.

    Segments are files and the order in them by default; an explicit ``segment`` and ``order`` serve tables that
    aren't read from files.
    """
    if not offset:
        return df.where(F.col(key) == F.lit(value)).limit(1)
    segment = F.col("_metadata.file_path") if segment is None else segment
    order = F.col("_metadata.row_index") if order is None else order
    placed = df.withColumn("_segment", segment).withColumn("_order", order)
    at = placed.where(F.col(key) == F.lit(value)).orderBy("_segment", "_order").limit(1).select("_segment", F.col("_order").alias("_at"))
    # only the segment of the document is numbered, not the table
    rows = placed.join(F.broadcast(at), "_segment")
    numbered = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("_segment").orderBy("_order")))
    own = numbered.where(F.col("_order") == F.col("_at")).select("_segment", F.col("_rn").alias("_own"))
    return numbered.join(F.broadcast(own), "_segment").where(F.col("_rn") == F.col("_own") + offset).select(*df.columns).limit(1)


def field_order(names: list[str]) -> list[str]:
    """Names without a leading underscore first, each group by name."""
    return sorted(names, key=lambda n: (n.startswith("_"), n))


def _long(doc: DataFrame, parts: list[Column]) -> DataFrame:
    return doc.select(F.explode(F.array(*parts)).alias("p")).select("p.*")


def stored(doc: DataFrame, selector: Selector = Selector(), mapping: Mapping = Mapping(), level: int = 0) -> DataFrame:
    """``field, value, value_num`` of each stored value; from ``level`` 1 on also its bytes, as they are and as text, and its type."""
    names = field_order(selector.of(doc.columns))
    numeric = {n for n, t in doc.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double")}
    parts = []
    for n in names:
        value = show(F.col(n), mapping.type_of(doc, n))
        own = [F.lit(n).alias("field"), value.alias("value"), (F.col(n).cast("double") if n in numeric else F.lit(None).cast("double")).alias("value_num")]
        if level > 0:
            data = value.cast("binary")
            own += [grouped_hex(data).alias("value_bin"), value.alias("value_binstr"), F.lit(mapping.type_of(doc, n)).alias("type"), F.lit(type(doc.schema[n].dataType).__name__).alias("class")]
        parts.append(F.struct(*own))
    return _long(doc, parts).where("value is not null")


def _positions(text: Column, terms: Column) -> Column:
    """``array<struct<term, pos, start, end>>``: each term is looked for after the end of the one before."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<term: string, pos: int, start: int, end: int>>").alias("out"))

    def step(s: Column, t: Column) -> Column:
        start = F.call_function("locate", t, F.lower(text), s["at"] + 1) - 1
        end = start + F.length(t)
        return F.struct(end.alias("at"), F.array_append(s["out"], F.struct(t.alias("term"), F.size(s["out"]).alias("pos"), start.alias("start"), end.alias("end"))).alias("out"))

    return F.aggregate(terms, begin, step, lambda s: s["out"])


def indexed(doc: DataFrame, name: str, mapping: Mapping = Mapping()) -> DataFrame:
    """``field, term, ord`` of a field's distinct terms.

    Text terms are ordered by first place, then by length in bytes, then by bytes.
    """
    if not mapping.is_text(doc, name):
        return doc.select(F.explode(mapping.terms(doc, name)).alias("v")).select(F.lit(name).alias("field"), show(F.col("v"), mapping.type_of(doc, name)).alias("term"))
    terms = doc.select(F.posexplode(mapping.terms(doc, name)).alias("pos", "term")).groupBy("term").agg(F.min("pos").alias("first_pos"))
    order = Window.orderBy("first_pos", F.octet_length("term"), "term")  # one document's terms
    return terms.select(F.lit(name).alias("field"), "term", "first_pos", F.row_number().over(order).alias("ord"))


def postings(doc: DataFrame, name: str, mapping: Mapping = Mapping(), dense: bool = False) -> DataFrame:
    """``field, term, count, postings``: places of each term, by position, then the larger end first.

    ``dense`` renders a place as ``"pos=p, offset=s..e"``.
    """
    places = doc.select(F.explode(_positions(F.col(name), mapping.terms(doc, name))).alias("p")).select("p.*")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", (-F.col("end")).alias("neg_end"), "start", "end"))), lambda p: F.struct(p["pos"].alias("pos"), p["start"].alias("start"), p["end"].alias("end")))
    out = places.groupBy("term").agg(F.count("*").alias("count"), ordered.alias("postings"))
    if dense:
        out = out.withColumn("postings", F.transform("postings", lambda p: F.concat(F.lit("pos="), p["pos"], F.lit(", offset="), p["start"], F.lit(".."), p["end"])))
    return out.select(F.lit(name).alias("field"), "term", "count", "postings")


def docvalues(doc: DataFrame, selector: Selector = Selector(), mapping: Mapping = Mapping(), level: int = 0) -> DataFrame:
    """``field, count, values`` of each column; array columns have several values.

    From ``level`` 1 on each value is followed by its bytes, as ``BIN: [hexadecimal]``.
    """
    parts = []
    for n in field_order(selector.of(doc.columns)):
        kind = mapping.type_of(doc, n)
        values = F.col(n) if dict(doc.dtypes)[n].startswith("array") else F.array_compact(F.array(n))
        parts.append(F.struct(F.lit(n).alias("field"), F.coalesce(F.size(values), F.lit(0)).alias("count"), (F.flatten(F.transform(values, _both(kind))) if level > 0 else F.transform(values, _shower(kind))).alias("values")))
    return _long(doc, parts)


def _shower(kind: str):
    return lambda v: show(v, kind)


def _both(kind: str):
    return lambda v: F.array(show(v, kind), F.concat(F.lit("BIN: "), grouped_hex(show(v, kind).cast("binary"))))


def view(doc: DataFrame, output: str | None = None, fields: str | None = None, field_expr: str | None = None, mapping: Mapping = Mapping()) -> DataFrame:
    """``section, field, item`` of a document: the wanted sections in one list."""
    wanted, selector = Selector(output), Selector(fields, field_expr)
    parts = []
    if wanted.selects("stored"):
        parts.append(stored(doc, selector, mapping).select(F.lit("stored").alias("section"), "field", F.col("value").alias("item")))
    if wanted.selects("indexed"):
        for n in selector.of(doc.columns):
            parts.append(indexed(doc, n, mapping).select(F.lit("indexed").alias("section"), "field", F.col("term").alias("item")))
    if wanted.selects("docvalues"):
        parts.append(docvalues(doc, selector, mapping).select(F.lit("docvalues").alias("section"), "field", F.array_join("values", ", ").alias("item")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
