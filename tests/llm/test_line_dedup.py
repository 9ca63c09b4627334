import random

from foliant.llm import line_dedup


def brute(rows):
    """Keep flags of distinct (doc_id, text) rows by doc_id; documents that share an id aren't compared here."""
    seen, out = set(), {}
    for i, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        flags = []
        for line in [] if text is None else text.split("\n"):
            bare = line.strip(" \t\r")
            flags.append(bare == "" or bare not in seen)
            seen.add(bare)
        out[i] = flags
    return out


def unpacked(rle):
    flags, keep = [], True
    for n in rle.split(",") if rle else []:
        flags += [keep] * int(n)
        keep = not keep
    return flags


def test_random_documents(spark):
    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choice(["a", "b ", "  b", "", "c\r", "d", f"own {i}"]) for _ in range(rng.randrange(8)))) for i in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    wanted = brute(rows)
    got = line_dedup.keep_bitmaps(df).collect()
    assert len(got) == 300
    for r in got:
        assert unpacked(r.keep_rle) == wanted[r.doc_id] and (r.n_lines, r.n_kept) == (len(wanted[r.doc_id]), sum(wanted[r.doc_id]))
    texts = dict(rows)
    kept = {r.doc_id: r.text for r in line_dedup.deduplicated(df).collect()}
    for i, flags in wanted.items():
        lines = texts[i].split("\n")
        left = [x for x, f in zip(lines, flags) if f]
        if all(flags) or any(x.strip(" \t\r") for x in left):
            assert kept[i] == "\n".join(left)
        else:
            assert i not in kept


def test_a_line_with_very_many_copies(spark):
    df = spark.range(30000).selectExpr("30000 - id AS doc_id", "concat('hot\nown ', id) AS text").repartition(4)
    got = line_dedup.keep_bitmaps(df).groupBy("keep_rle").count().collect()
    assert {r.keep_rle: r["count"] for r in got} == {"2": 1, "0,1,1": 29999}


def test_odd_rows(odd, empty):
    got = {(r.doc_id, r.n_lines, r.n_kept, r.keep_rle) for r in line_dedup.keep_bitmaps(odd).collect()}
    assert {(1, 0, 0, ""), (2, 1, 1, "1"), (3, 2, 2, "2"), (5, 2, 2, "2"), (8, 1, 1, "1"), (9, 1, 0, "0,1"), (None, 0, 0, ""), (None, 1, 1, "1")} <= got
    assert line_dedup.keep_bitmaps(odd).where("doc_id = 5").count() == 1 and line_dedup.keep_bitmaps(odd).where("doc_id = 6").count() == 2
    out = line_dedup.deduplicated(odd)
    assert out.schema == odd.schema
    ids = sorted((r.doc_id if r.doc_id is not None else -1) for r in out.collect())
    assert ids == [-1, -1, 1, 2, 3, 4, 5, 6, 6, 7, 8]
    assert line_dedup.deduplicated(empty).count() == 0 and line_dedup.keep_bitmaps(empty).count() == 0


def test_lengths_follow(spark):
    df = spark.createDataFrame([(1, "x\ny", 3), (2, "x\nzz", 4)], "doc_id long, text string, n_chars long")
    assert {tuple(r) for r in line_dedup.deduplicated(df).collect()} == {(1, "x\ny", 3), (2, "zz", 2)}


def test_ids_of_other_types(spark):
    rows = [("b", "one\ntwo"), ("a", "two\nthree"), (None, "three\nfour"), ("c", None), ("a", "two\nthree")]
    df = spark.createDataFrame(rows, "doc_id string, text string").coalesce(1)
    got = {r.doc_id: (r.n_lines, r.keep_rle) for r in line_dedup.keep_bitmaps(df).collect()}
    assert got == {None: (2, "2"), "a": (2, "1,1"), "b": (2, "1,1"), "c": (0, "")}
    assert {r.doc_id: r.text for r in line_dedup.deduplicated(df).collect()} == {None: "three\nfour", "a": "two", "b": "one", "c": None}
