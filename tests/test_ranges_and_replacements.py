import pytest
from pyspark.sql import functions as F

from foliant.functions import formats, replace
from foliant.functions.ranges import compare_bytes, compare_bytes_descending, int_range, value_range
from foliant.functions.selector import Selector
from foliant.functions.typed import decoded, from_sortable_long, parse, show, sortable_long

PAIRS = [(b"a", b"a", 0), (b"a", b"b", -1), (b"b", b"a", 1), (b"b", b"bb", -1), (b"bb", b"b", 1), (b"c", b"bb", 1), (b"bb", b"c", -1)]


@pytest.mark.parametrize("a, b, sign", PAIRS)
def test_bytes_compare_unsigned(a, b, sign):
    assert compare_bytes(a, b) == sign
    assert compare_bytes_descending(a, b) == -sign


@pytest.mark.parametrize("text, values", [
    ("b..c", {"a": False, "b": True, "c": False, "d": False}),
    ("b", {"a": False, "b": True, "c": False, "d": False}),
    ("a..b", {"b": False, "abc": True, "bb": False, "d": False}),
    ("d..e", {"b": False, "de": True, "bb": False, "f": False}),
    ("c..c", {"b": False, "c": True, "cc": False}),
])
def test_value_ranges(spark, text, values):
    r = value_range(text)
    assert {v: r.holds(v.encode()) for v in values} == values
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    assert {x.v for x in rows.where(r.contains(F.col("v"), "string")).collect()} == {v for v, yes in values.items() if yes}


@pytest.mark.parametrize("text, inside", [("5", {5}), (" 5 ", {5}), ("2..5", {2, 3, 4}), ("..5", {0, 1, 2, 3, 4}), ("2..", set(range(2, 10))), ("5..5", set()), (None, set(range(10)))])
def test_integer_ranges(spark, text, inside):
    r = int_range(text)
    assert {v for v in range(10) if r.holds(v)} == inside
    assert {x.id for x in spark.range(10).where(r.contains(F.col("id"), "long")).collect()} == inside


def test_integer_range_rejects_text():
    with pytest.raises(ValueError):
        int_range("a..5")


@pytest.mark.parametrize("template, parts", [
    (None, []), ("", []), ("abc", ["abc"]), ("ab$$c", ["ab$", "c"]), ("a$$", ["a$"]), ("ab$$$1", ["ab$", 1]), ("ab$$$a", ["ab$", "$a"]),
    ("ab$$$1x", ["ab$", 1, "x"]), ("ab$$$1$0x", ["ab$", 1, 0, "x"]), ("x$1", [1]),
])
def test_templates(template, parts):
    assert replace.parse_template(template) == parts


@pytest.mark.parametrize("text, parts", [("a/b", ("a", "b")), ("a/", ("a", "")), ("a///", ("a/", "")), ("a///b//", ("a/", "b/"))])
def test_replacement_parts(text, parts):
    assert replace.parse_replacement(text) == parts


@pytest.mark.parametrize("text", ["a", "/b", "a/b/c", ""])
def test_bad_replacements(text):
    with pytest.raises(ValueError):
        replace.parse_replacement(text)


def test_replacement_chain_and_extraction(spark):
    rows = spark.createDataFrame([("walking",), ("undo",), ("unwalking",), ("plain",), (None,)], "t string")
    got = rows.select("t", replace.replaced(F.col("t"), "ing$/||^un/x").alias("r"), replace.extracted_by(F.col("t"), "(w)(a)/$2$1!").alias("e"), replace.extracted(F.col("t"), "a", "").alias("n"), replace.remainder(F.col("t"), "^(un)/$1").alias("rest")).collect()
    assert [(x.r, x.e, x.n, x.rest) for x in got] == [("walk", "aw!", "", "walking"), ("xdo", None, None, "do"), ("xwalk", "aw!", "", "walking"), (None, None, "", "plain"), (None, None, None, None)]


def test_sizes_and_hex(spark):
    sizes = [(999, "999 bytes"), (1000, "1.00 KB"), (12345, "12.3 KB"), (123456, "123 KB"), (1000000, "1000 KB"), (1500000, "1.50 MB"), (0, "0 bytes"), (2500000000, "2.50 GB")]
    rows = spark.createDataFrame([(n,) for n, _ in sizes], "n long").select(formats.size_text(F.col("n")).alias("t"))
    assert [r.t for r in rows.collect()] == [t for _, t in sizes]
    b = spark.createDataFrame([(bytes([1, 2, 3, 4, 5]),), (b"",), (None,)], "b binary").select(formats.grouped_hex(F.col("b")).alias("g"), formats.plain_hex(F.col("b")).alias("p"))
    assert [tuple(r) for r in b.collect()] == [("[01020304 05]", "1 2 3 4 5"), ("[]", ""), (None, None)]
    k = spark.createDataFrame([("a\x00\x01 béc",)], "k string").select(formats.printable(F.col("k")).alias("k"), formats.bitset_bytes(F.lit(64)).alias("n"), formats.bitset_bytes(F.lit(None).cast("int")).alias("none"))
    assert tuple(k.head()) == ("a b c", 16, -1)


def test_selectors():
    names = ["Name", "_id", "size", "sized"]
    assert Selector("name;SIZE").of(names) == ["Name", "size"]
    assert Selector("!name|size").of(names) == ["_id", "sized"]
    assert Selector("!").of(names) == []
    assert Selector(None, "^s").of(names) == ["size", "sized"]
    assert Selector("!size", "-^_").of(names) == ["Name", "sized"]
    assert Selector().of(names) == names


def test_typed_values(spark):
    rows = spark.sql("SELECT -5L AS l, timestamp_ntz'2020-01-02 03:04:05' AS d, true AS b, named_struct('lat', 1.5D, 'lon', 2D) AS g, X'FF01' AS x")
    got = rows.select(show(F.col("l"), "long"), show(F.col("d"), "date"), show(F.col("b"), "boolean"), show(F.col("g"), "geo_point"), show(F.col("x"), "binary"), from_sortable_long(sortable_long(F.col("l"))), decoded(F.col("x"), "text"), decoded(sortable_long(F.col("l")), "long"), decoded(F.lit(b"TF").cast("binary"), "boolean"), parse("2020-01-02", "date") < F.col("d")).head()
    assert tuple(got) == ("-5", "2020-01-02T03:04:05.000Z", "true", "1.500000; 2.000000", "[FF01]", -5, "[FF01]", "-5", "true,false", True)
    with pytest.raises(ValueError):
        parse("1", "geo_point")
    order = spark.createDataFrame([(v,) for v in (3, -1, 0, -(1 << 63), (1 << 63) - 1)], "v long").orderBy(sortable_long(F.col("v")))
    assert [r.v for r in order.collect()] == [-(1 << 63), -1, 0, 3, (1 << 63) - 1]


def test_indexed_bytes_of_every_type(spark):
    cases = [("integer", "7FFFFFFF", "-1"), ("short", "80000005", "5"), ("byte", "8000000580000006", "5,6"), ("long", "8000000000000007", "7"), ("float", "BFC00000", "1.5"), ("float", "403FFFFF", "-1.5"),
             ("double", "BFF8000000000000", "1.5"), ("date", "80000000000003E9", "1970-01-01T00:00:01.001Z"), ("date", "7FFFFFFFFFFFFFFF", "1969-12-31T23:59:59.999Z"), ("geo_point", "C0000000C0000000", "45.000000; 90.000000")]
    for mapping, code, wanted in cases:
        df = spark.createDataFrame([(bytes.fromhex(code),), (bytes.fromhex(code[:6]),), (None,)], "x binary")
        got = [r[0] for r in df.select(decoded(F.col("x"), mapping)).collect()]
        assert got[0] == wanted and got[1].replace(" ", "").upper() == f"[{code[:6]}]" and got[2] is None, (mapping, got)


def test_sortable_bytes_sort_as_values_do(spark):
    from foliant.functions.typed import decoded, sortable

    for kind, ddl, values in (("long", "long", [-(1 << 63), -5, 0, 7, (1 << 63) - 1]), ("integer", "int", [-(1 << 31), -1, 0, 3, (1 << 31) - 1]), ("double", "double", [float("-inf"), -2.5, -0.25, 0.0, 1e-3, 8.0, float("inf")]), ("float", "float", [-8.0, -0.5, 0.0, 0.5, 3.0])):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(99, None)], f"i int, v {ddl}").select("i", "v", sortable(F.col("v"), kind).alias("b"))
        got = rows.select("i", "v", "b", decoded(F.col("b"), kind).alias("back")).where("i < 99").orderBy("b").collect()
        assert [r.i for r in got] == list(range(len(values))) and [float(r.back) for r in got] == [float(v) for v in values]
        assert rows.where("i = 99").head().b is None
    with pytest.raises(ValueError):
        sortable(F.lit(1), "geo_point")
