import random

import pytest
from pyspark.sql import functions as F

from foliant.functions import analysis
from foliant.functions.token_streams import Token, WordDelimiter, parse_type_table, shingle, shingled, split_words, word_delimited

CASES = [
    ("a b c", {}, ["a", "a b", "b", "b c", "c"]),
    ("a b c", dict(max_size=3, unigrams=False), ["a b", "a b c", "b c"]),
    ("a b-c d", dict(max_size=3), ["a", "b-c", "b-c d", "d"]),
    ("a b c-d", {}, ["a", "a b", "b", "c-d"]),
    ("a b", dict(min_size=3, max_size=3, unigrams=False, unigrams_if_none=True), ["a", "b"]),
    ("a b-c", dict(unigrams=False, unigrams_if_none=True), ["b-c"]),
    ("", {}, []),
]


@pytest.mark.parametrize("text, options, wanted", CASES)
def test_shingles(spark, text, options, wanted):
    terms = text.split()
    rows = spark.createDataFrame([(terms,)], "t array<string>")
    assert rows.select(analysis.shingles(F.col("t"), **options).alias("s")).head().s == wanted
    assert [t.term for t in shingle([Token(t) for t in terms], **options)] == wanted


def test_both_forms_of_shingles_agree(spark):
    rng = random.Random(5)
    lists = [(i, [rng.choice(["a", "b1", "c-d", "é", "#", "x"]) for _ in range(rng.randrange(7))]) for i in range(200)]
    rows = spark.createDataFrame(lists, "i int, t array<string>").repartition(1)
    for options in (dict(), dict(min_size=2, max_size=4), dict(min_size=3, max_size=4, unigrams=False), dict(unigrams=False, unigrams_if_none=True), dict(min_size=3, max_size=3, unigrams=False, unigrams_if_none=True, separator="+")):
        got = {r.i: r.s for r in rows.select("i", analysis.shingles(F.col("t"), **options).alias("s")).collect()}
        for i, terms in lists:
            assert got[i] == [t.term for t in shingle([Token(t) for t in terms], **options)], (terms, options)


def test_shingle_attributes_and_holes(spark):
    stream = [Token("a", 0, 1), Token("b", 4, 5, pos_inc=2)]
    out = shingle(stream, max_size=2)
    assert [(t.term, t.pos_inc, t.pos_len, t.type, t.keyword, t.start, t.end) for t in out] == [
        ("a", 1, 1, "word", False, 0, 1), ("a _", 0, 2, "shingle", True, 0, 4), ("_ b", 1, 2, "shingle", True, 4, 5), ("b", 1, 1, "word", False, 4, 5)]
    rows = spark.createDataFrame([(["a", "b"],)], "t array<string>").select(shingled(analysis.full(F.col("t"))).alias("s"))
    assert [(t.term, t.start, t.end, t.keyword) for t in rows.head().s] == [("a", 0, 1, False), ("a b", 0, 3, True), ("b", 2, 3, False)]


def test_shingle_sizes_are_checked():
    for bad in ((1, 2), (3, 2), (2, 1)):
        with pytest.raises(ValueError):
            analysis.shingles(F.col("t"), *bad)


def test_unique_skip_and_count(spark):
    rows = spark.createDataFrame([([["a", "b"], ["B", "a"]], ["a", "b", "c", "d"], ["a", "len_7", "b", "len_x", "len_9"])], "e array<array<string>>, t array<string>, f array<string>")
    r = rows.select(
        analysis.global_unique(F.col("e")).alias("u"), *[analysis.skip(F.col("t"), n).alias(f"s{n}".replace("-", "m")) for n in (-2, 2, 0, -9)],
        analysis.field_count(F.col("f"), "len_").alias("c"), analysis.field_count(F.col("t"), "len_").alias("n"), analysis.field_count(F.col("t")).alias("p")).head()
    assert (r.u, r.sm2, r.s2, r.s0, r.sm9) == (["a", "b", "B"], ["c", "d"], ["b", "c", "d"], ["a", "b", "c", "d"], [])
    assert (r.c.terms, r.c.length, r.n.length, r.p.length) == (["a", "b", "len_x"], 9, -1, 4)


def _stream(spark, tokens):
    return spark.createDataFrame([([(t, 0, 0, inc, 1, "word", False) for t, inc in tokens],)], f"s array<{analysis.TOKEN}>")


def test_positions_in_streams(spark):
    rows = _stream(spark, [("a", 1), ("b", 1), ("b2", 0), ("b", 0), ("c", 1), ("b", 0)])
    r = rows.select(analysis.unique_on_position(F.col("s")).alias("u"), analysis.skip_tokens(F.col("s"), -2).alias("m"), analysis.skip_tokens(F.col("s"), 2).alias("p")).head()
    assert [t.term for t in r.u] == ["a", "b", "b2", "c", "b"]
    assert [t.term for t in r.m] == ["c", "b"]
    assert [t.term for t in r.p] == ["b", "b2", "b", "c", "b"]


def _delimited(term, **options):
    return [t.term for t in WordDelimiter(**options)([Token(term, 0, len(term))])]


def test_word_delimiter_examples():
    off = dict(generate_word_parts=False, generate_number_parts=False)
    assert _delimited("PowerShot") == ["Power", "Shot"]
    assert _delimited("500-42") == ["500", "42"]
    assert _delimited("wi-fi", catenate_words=True, **off) == ["wifi"]
    assert _delimited("500-42", catenate_numbers=True, **off) == ["50042"]
    assert _delimited("wi-fi-4000", catenate_all=True, **off) == ["wifi4000"]
    assert _delimited("500-42", preserve_original=True) == ["500-42", "500", "42"]
    assert _delimited("j2se") == ["j", "2", "se"]
    assert _delimited("O'Neil's") == ["O", "Neil"]
    assert _delimited("j2se", split_on_numerics=False) == ["j2se"]
    assert _delimited("PowerShot", split_on_case_change=False) == ["PowerShot"]
    assert _delimited("--") == []


def test_word_delimiter_graph_positions():
    out = WordDelimiter(catenate_all=True, preserve_original=True)([Token("wi-fi-4000", 10, 20), Token("x", 21, 22)])
    assert [(t.term, t.pos_inc, t.pos_len, t.start, t.end) for t in out] == [
        ("wi-fi-4000", 1, 3, 10, 20), ("wifi4000", 0, 3, 10, 20), ("wi", 0, 1, 10, 12), ("fi", 1, 1, 13, 15), ("4000", 1, 1, 16, 20), ("x", 1, 1, 21, 22)]


def test_word_delimiter_keeps_keywords_and_protected_words(spark):
    d = WordDelimiter(protected_words=frozenset({"wi-fi"}))
    assert [t.term for t in d([Token("wi-fi"), Token("a b-c", keyword=True), Token("d-e")])] == ["wi-fi", "a b-c", "d", "e"]
    assert [t.term for t in WordDelimiter(ignore_keywords=False)([Token("a b", keyword=True)])] == ["a", "b"]
    rows = spark.createDataFrame([(["Wi-Fi4"],)], "t array<string>").select(word_delimited(analysis.full(F.col("t"))).alias("s"), split_words(F.col("t")).alias("j"))
    assert [t.term for t in rows.head().s] == rows.head().j == ["Wi", "Fi", "4"]


def test_splits_in_the_jvm_agree(spark):
    rng = random.Random(3)
    terms = ["".join(rng.choice("aB1-'sé.") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    rows = spark.createDataFrame([(i, [t]) for i, t in enumerate(terms)], "i int, t array<string>")
    got = {r.i: r.j for r in rows.select("i", split_words(F.col("t"), possessive=False).alias("j")).collect()}
    for i, t in enumerate(terms):
        assert got[i] == _delimited(t, stem_english_possessive=False), t


def test_type_table():
    table = parse_type_table(["$ => DIGIT", "\\u002C => DIGIT", "- => ALPHA"])
    assert _delimited("$5,0-x", type_table=table) == ["$5,0", "-x"]
    for bad in ("ab => DIGIT", "a = DIGIT", "a => NONE"):
        with pytest.raises(ValueError):
            parse_type_table([bad])
