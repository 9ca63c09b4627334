"""Mapping types: how values are named, shown and parsed.

``show`` renders a typed column as text and ``parse`` reads request text; a value that doesn't decode is shown
as grouped hexadecimal, never an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.formats import grouped_hex

_TEXT = "text keyword string text_with_docvalues analyzed_keyword _all parent _parent join _routing _type _uid _field_names _source _id".split()
#: SQL types of the mapping types.
SQL_TYPES = dict.fromkeys(_TEXT, "string") | {
    "bool": "boolean", "boolean": "boolean", "long": "bigint", "_seq_no": "bigint", "_version": "bigint", "_primary_term": "bigint",
    "integer": "int", "short": "smallint", "byte": "tinyint", "float": "float", "double": "double", "date": "timestamp_ntz", "geo_point": "struct<lat: double, lon: double>",
}


def mapping_type(kind: T.DataType) -> str:
    """The mapping type that a column of a Spark type has by default."""
    if isinstance(kind, T.ArrayType):
        return mapping_type(kind.elementType)
    if isinstance(kind, T.StructType):
        return "geo_point" if [f.name for f in kind] == ["lat", "lon"] else "nested"
    named = {T.StringType: "text", T.BooleanType: "boolean", T.LongType: "long", T.IntegerType: "integer", T.ShortType: "short", T.ByteType: "byte", T.FloatType: "float", T.DoubleType: "double", T.TimestampType: "date", T.TimestampNTZType: "date", T.DateType: "date"}
    return named.get(type(kind), "binary")


def show(value: Column, mapping: str) -> Column:
    """Text of a value of a mapping type; types without a rule are hexadecimal."""
    if mapping == "date":
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if mapping == "geo_point":
        return F.format_string("%f; %f", value["lat"], value["lon"])
    if mapping in ("bool", "boolean"):
        return F.when(value, "true").when(~value, "false")
    if mapping in SQL_TYPES:
        return value.cast("string")
    return grouped_hex(value.cast("binary"))


def parse(text: str, mapping: str) -> Column:
    """A literal from request text; dates are ``yyyy-MM-dd HH:mm:ss`` or ``yyyy-MM-dd``."""
    if mapping == "geo_point":
        raise ValueError("geo points can't be written in requests")
    if mapping not in SQL_TYPES:
        raise ValueError(f"values of type {mapping!r} can't be written in requests")
    if mapping in ("bool", "boolean"):
        if text not in ("T", "F", "true", "false"):
            raise ValueError(f"not a boolean: {text!r}")
        return F.lit(text in ("T", "true"))
    return F.lit(text).cast(SQL_TYPES[mapping])


def sortable_long(value: Column) -> Column:
    """8 bytes, big-endian with the sign flipped: they sort as the numbers do."""
    return F.unhex(F.lpad(F.hex(value.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))


def from_sortable_long(value: Column) -> Column:
    """The number of 8 sortable bytes; null for other lengths."""
    unsigned = F.conv(F.hex(value), 16, 10).cast("decimal(20,0)")
    return F.when(F.octet_length(value) == 8, (unsigned - F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("long"))


def sortable(value: Column, mapping: str) -> Column:
    """The bytes under which a value of a type is indexed; null for null.

    Text is UTF-8, a boolean ``T`` or ``F``.  Numbers are big-endian with the sign flipped, 4 bytes for integers of up to
    32 bits and floats, 8 for others and for dates in milliseconds; of negative floats the other bits are flipped too.
    """
    kind = SQL_TYPES.get(mapping)
    if kind == "string":
        return value.cast("string").cast("binary")
    if kind == "boolean":
        return F.when(value, F.lit("T")).when(~value, F.lit("F")).cast("binary")
    if kind in ("int", "smallint", "tinyint"):
        return F.unhex(F.lpad(F.hex(value.cast("long") + F.lit(1 << 31)), 8, "0"))
    if kind == "bigint":
        return sortable_long(value)
    if mapping == "date":
        days, left = F.datediff(value, F.lit("1970-01-01").cast("date")).cast("long"), value.cast("timestamp_ntz")
        seconds = F.hour(left) * 3600 + F.minute(left) * 60
        return sortable_long(days * 86400000 + seconds.cast("long") * 1000 + F.floor(F.date_part(F.lit("SECOND"), left) * 1000).cast("long"))
    if kind in ("float", "double"):
        return _floating_bytes(np.float32, np.int32)(value.cast("float")) if kind == "float" else _floating_bytes(np.float64, np.int64)(value.cast("double"))
    raise ValueError(f"values of type {mapping!r} have no sortable form")


def _floating_bytes(kind: type, bits: type):
    @F.arrow_udf(T.BinaryType())
    def run(numbers: pa.Array) -> pa.Array:
        x = numbers.fill_null(0).to_numpy(zero_copy_only=False).astype(kind).view(bits)
        x = x ^ (x >> (8 * x.itemsize - 1)) & np.iinfo(bits).max ^ np.iinfo(bits).min
        width = x.itemsize
        data = x.astype(f">i{width}").tobytes()
        ok = numbers.is_valid().to_pylist()
        return pa.array([data[i * width : (i + 1) * width] if ok[i] else None for i in range(len(ok))], pa.binary())

    return run


def _numbers(value: Column, width: int) -> Column:
    """The numbers of sortable bytes, ``width`` bytes each; null where the length doesn't fit."""
    n = (F.octet_length(value) / width).cast("int")
    flipped = F.lit(str(1 << 8 * width - 1)).cast("decimal(20,0)")
    one = lambda i: (F.conv(F.hex(value.substr(i * width + 1, F.lit(width))), 16, 10).cast("decimal(20,0)") - flipped).cast("long")
    return F.when((n > 0) & (F.octet_length(value) == n * width), F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), one))


def _floating(kind: type, bits: type, out: T.DataType):
    @F.arrow_udf(T.ArrayType(out))
    def run(numbers: pa.Array) -> pa.Array:
        x = numbers.flatten().to_numpy(zero_copy_only=False).astype(bits)
        x = x ^ (x >> (8 * x.itemsize - 1)) & np.iinfo(bits).max
        ends = np.concatenate([[0], np.cumsum(numbers.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(x.view(kind)), mask=numbers.is_null())

    return run


def _date(ms: Column) -> Column:
    """A date of years 0 to 9999 in UTC; null beyond."""
    fine = F.when(ms.between(-62167219200000, 253402300799999), ms)
    days, left = F.floor(fine / 86400000.0).cast("int"), F.pmod(fine, F.lit(86400000))
    at = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(days, F.lit(0), F.lit(0), (left / 1000).cast("decimal(18,6)"))
    return show(at, "date")


def decoded(value: Column, mapping: str) -> Column:
    """Text of indexed bytes, several values with commas between; other types, or what doesn't decode, are hexadecimal."""
    kind = SQL_TYPES.get(mapping)
    if kind == "string":
        return F.coalesce(F.try_validate_utf8(value.cast("string")), grouped_hex(value))
    if mapping in ("bool", "boolean"):
        letters = F.regexp_replace(F.regexp_replace(value.cast("string"), "T", "true,"), "F", "false,")
        return F.when(value.cast("string").rlike("^[TF]+$"), F.rtrim(letters, F.lit(","))).otherwise(grouped_hex(value))
    if kind in ("bigint", "int", "smallint", "tinyint"):
        texts = F.transform(_numbers(value, 8 if kind == "bigint" else 4), lambda x: x.cast("string"))
    elif kind == "float":
        texts = _floating(np.float32, np.int32, T.FloatType())(_numbers(value, 4)).cast("array<string>")
    elif kind == "double":
        texts = _floating(np.float64, np.int64, T.DoubleType())(_numbers(value, 8)).cast("array<string>")
    elif mapping == "date":
        texts = F.transform(_numbers(value, 8), _date)
        texts = F.when(F.forall(texts, lambda x: x.isNotNull()), texts)
    elif mapping == "geo_point":
        halves = F.when(F.octet_length(value) % 8 == 0, _numbers(value, 4))
        pair = lambda i: F.format_string("%f; %f", F.get(halves, 2 * i) * (180.0 / (1 << 32)), F.get(halves, 2 * i + 1) * (360.0 / (1 << 32)))
        texts = F.when(halves.isNotNull(), F.transform(F.sequence(F.lit(0), (F.greatest(F.size(halves), F.lit(2)) / 2).cast("int") - 1), pair))
    else:
        return grouped_hex(value)
    return F.coalesce(F.array_join(texts, ","), grouped_hex(value))
