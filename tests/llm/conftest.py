import pytest

LONG = "word " * 40000 + "x" * 20000

#: Nulls in any column, empty, blank and very long texts, repeated rows and ids; columns named like results.
ODD = [
    (None, "no id here but words", "en", "s", 20, "a"), (None, None, None, None, None, None), (1, None, "en", "s", 0, "b"), (2, "", "en", None, 0, "c"),
    (3, " \n\t", "en", "s", 3, "d"), (4, LONG, "en", "s", len(LONG), "e"), (5, "same row\ntwice", "en", "s", 14, "f"), (5, "same row\ntwice", "en", "s", 14, "f"),
    (6, "one id", "en", "s", 6, "g"), (6, "two texts entirely", "en", "s", 18, "h"), (7, "ünïcödé \U0001f600 日本語 '' 's", None, "s", 20, None), (8, "tie", "en", "s", 3, "i"), (9, "tie", "en", "s", 3, "i"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string"
#: Extra columns that clash with names of results and of inner columns.
EXTRA = ["1 as token_ids", "2 as N_TOKENS", "3 as keep", "4 as `__keep`", "5 as text_hash", "6 as fp", "7 as score", "8 as item_id", "9 as duplicate_of", "10 as host", "11 as h1", "12 as `with.dot`"]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).selectExpr("*", *EXTRA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("1 = 0")
