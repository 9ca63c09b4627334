from pyspark.sql import functions as F

from foliant.llm import url_filter as uf


def _judged(spark, rows, **options):
    df = spark.createDataFrame(rows, "page_id long, url string, bad int, host string, template string, n long")
    return {r.page_id: r for r in uf.judge(df.repartition(3), "bad", **options).collect()}


def _row(i, url, bad=None):
    return (i, url, bad, "clash", "clash", 1)


def test_wildcards_merging_and_rejection(spark):
    rows = []
    for i in range(40):  # a variable segment: many children, each rare
        rows.append(_row(i, f"http://A.example/shop/item-{'abcdefghij'[i % 10]}{chr(97 + i // 10)}x/view?q=1", i % 2))
    for i in range(40, 70):  # a branch that differs from its siblings
        rows.append(_row(i, f"https://user@a.example:80/spam/{i}", 1))
    for i in range(70, 100):
        rows.append(_row(i, f"http://a.example/{'de' if i % 2 else 'en'}/{i}/#x", 0))
    got = _judged(spark, rows)
    assert len(got) == 100 and {r.host for r in got.values()} == {"a.example"}
    assert {got[i].template for i in range(40)} == {"/*/*/view"} or {got[i].template for i in range(40)} == {"/shop/*/view"}
    assert {got[i].template for i in range(40, 70)} == {"/spam/{n}"} and all(got[i].rejected for i in range(40, 70))
    assert len({got[i].template for i in range(70, 100)}) <= 2 and not any(got[i].rejected for i in range(70, 100))


def test_similar_branches_become_one(spark):
    rows = [_row(i, f"http://h.example/{'en' if i % 3 else 'fr'}/{i}", int(i % 4 == 0)) for i in range(60)]
    got = _judged(spark, rows)
    assert {r.template for r in got.values()} == {"/*/{n}"} and {r.n_urls for r in got.values()} == {60} and {r.n_bad for r in got.values()} == {15}


def test_a_hot_child_among_many_rare_ones_is_judged_alone(spark):
    for casino_bad in (1, 0):
        rows = [_row(i, f"http://h.example/{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i // 100]}/{i}", 1 - casino_bad if i < 300 else None) for i in range(1000)]
        rows += [_row(i, f"http://h.example/casino/{i}", casino_bad if i < 1200 else None) for i in range(1000, 2500)]
        got = _judged(spark, rows)
        assert {got[i].template for i in range(1000)} == {"/*/{n}"} and {got[i].template for i in range(1000, 2500)} == {"/casino/{n}"}
        assert {got[i].rejected for i in range(1000)} == {not casino_bad} and {got[i].rejected for i in range(1000, 2500)} == {bool(casino_bad)}


def test_branches_below_many_levels(spark):
    def slug(i):
        return "abcdefghij"[i % 10] + "klmnopqrst"[i // 10]

    rows = [_row(2 * i + k, f"http://h.example/y/m/d/cat/sub/{slug(i)}/{('story', 'comments')[k]}", k) for i in range(40) for k in (0, 1)]
    rows += [_row(100 + i, f"http://trap.example/{'a/' * (i + 1)}{slug(i)}/{'bc'[i % 2]}", None) for i in range(4)]
    rows += [_row(200 + i, "http://chain.example/" + "a/" * i, 0) for i in range(300)]
    got = _judged(spark, rows)
    assert {got[2 * i].template for i in range(40)} == {"/y/m/d/cat/sub/*/story"} and not any(got[2 * i].rejected for i in range(40))
    assert {got[2 * i + 1].template for i in range(40)} == {"/y/m/d/cat/sub/*/comments"} and all(got[2 * i + 1].rejected for i in range(40))
    assert got[103].template == "/a/*/*/*/*/c" and got[100].template == "/a/*/*"
    assert all(got[200 + i].template == "/" + "/".join("a" * i) for i in range(300))


def test_segments(spark):
    urls = [("http://h/a//b/", ["a", "b", "", "", "", ""]), ("http://h/1/2/3/4/5/6/7?x", ["{n}"] * 5 + ["{n}/{n}"]), ("http://h", [""] * 6), ("http://h/x12-0123456789abcdef01.html#y", ["x{n}{x}.html"] + [""] * 5), (None, [""] * 6), ("", [""] * 6)]
    df = spark.createDataFrame([(u,) for u, _ in urls], "u string").select(*uf.segments_of(F.col("u")))
    assert [list(r) for r in df.collect()][:3] == [s for _, s in urls][:3]
    assert [list(r) for r in df.collect()][4:] == [s for _, s in urls][4:]


def test_odd_rows(spark, odd, empty):
    rows = [_row(1, None, 1), _row(2, "", 1), _row(3, "not a url", 1), _row(4, "http://h.example", None), _row(5, "http://h.example/" + "a/" * 20000, 0), _row(5, "http://h.example/" + "a/" * 20000, 0), (None, "http://h.example/x", None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad int, host string, template string, n long")
    got = uf.judge(df, "bad").collect()
    assert len(got) == 7 and not any(r.rejected for r in got if r.page_id in (1, 2, 3)) and sum(r.page_id == 5 for r in got) == 2
    assert uf.judge(df.where("1 = 0"), "bad").count() == 0
    unlabelled = uf.judge(df.withColumn("bad", F.lit(None).cast("int")), "bad").collect()
    assert len(unlabelled) == 7 and not any(r.rejected for r in unlabelled)
    assert uf.judge(odd.withColumn("bad", F.lit(1)), "bad", url="text", keep=("doc_id", "host")).count() == odd.count()


def test_kept_columns_named_like_results(spark):
    df = spark.createDataFrame([(1, "http://h.example/a", 1, "x", "y")], "page_id long, url string, bad int, host string, N_URLS string")
    out = uf.judge(df, "bad", keep=("page_id", "host", "N_URLS"))
    assert out.columns == ["page_id", "host_", "N_URLS_", "host", "template", "n_urls", "n_labelled", "n_bad", "bad_share", "rejected"]
    assert out.select("host_", "N_URLS_", "host", "n_urls").collect() == [("x", "y", "h.example", 1)]
