import os

import pytest

import corpus_pipeline as cp
from foliant.llm import catalog, session

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


def test_every_stage_takes_odd_rows(spark, odd):
    docs = odd
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, FOLDER)
        assert out.count() > 0
        if k < len(cp.STAGES) - 1:
            assert out.schema == docs.schema, name
            docs = out
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in out.collect()) == [-1, -1, 1, 2, 3, 4, 5, 6, 6, 7, 8]


def test_every_stage_takes_an_empty_table(spark, empty):
    for _, stage in cp.STAGES:
        assert stage(spark, empty, FOLDER).count() == 0


def test_stages_are_named_once_and_decide(spark):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "simhash", "decontamination", "bpe"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = docs.count()
    out = cp.run(spark, FOLDER)
    assert set(out.columns) == {"doc_id", "lang", "source", "token_ids", "n_tokens", "round_trip"}
    assert before / 2 < out.count() < before and out.where("not round_trip").count() == 0


def test_planted_cases(spark):
    """A benchmark passage, an exact and a near copy and a repeated line go; clean documents stay."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").head().text
    clean = [" ".join(f"clean{d}word{k}" for k in range(80)) for d in range(3)]
    near = clean[1].split()
    near[5], near[40] = "changed", "altered"
    passage = " ".join(f"passage{k}" for k in range(55))
    planted = [(900001, clean[0]), (900002, clean[1]), (900003, clean[0]), (900004, " ".join(near)), (900005, f"before it {item} after it"), (900006, f"{clean[2]}\n{passage}"), (900007, " ".join(f"other{k}" for k in range(60)) + f"\n{passage}")]
    mine = spark.createDataFrame([(i, t, "en", "own", len(t)) for i, t in planted], docs.schema)
    both = docs.unionByName(mine)
    rows = both
    for _, stage in cp.STAGES[:-1]:
        rows = stage(spark, rows, FOLDER)
    left = {r.doc_id: r.text for r in rows.where("source = 'own'").collect()}
    assert set(left) == {900001, 900002, 900006, 900007}
    assert passage in left[900006] and passage not in left[900007]


def test_queries_are_registered():
    names = list(catalog.queries())
    assert names[0] == "pipeline" and [n.split("_")[0] for n in names[1:]] == [f"op{k}" for k in range(1, 11)]
    assert set(catalog.oracle_sql()) <= set(names)


def test_sql(spark):
    import glob

    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    for name, sql in catalog.oracle_sql().items():
        df = catalog.queries()[name](spark, FOLDER)
        columns = sorted(df.columns)
        wanted = con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
        assert sorted(map(str, wanted)) == sorted(str(tuple(r)) for r in df.select(*columns).collect()), name


def test_no_operator_makes_a_local_checkpoint():
    import pathlib

    root = pathlib.Path(cp.__file__).parent
    for p in [*root.glob("foliant/llm/*.py"), root / "corpus_pipeline.py"]:
        assert "localCheckpoint" not in p.read_text()


def test_near_copies_go_though_their_lines_went(spark, tmp_path):
    """A copy that shares most lines with an earlier document goes as a whole; one that shares few stays."""
    rows = [(i, "\n".join(" ".join(f"d{i}l{k}w{j}" for j in range(12)) for k in range(9)), "en", "own", 0) for i in range(6)]
    lines = rows[0][1].split("\n")
    rows += [(10, "\n".join([*lines[:8], "the end of it was changed"]), "en", "own", 0), (11, "\n".join([*lines[:3], *(f"a line {k} of its own with other words {k * 7}" for k in range(9))]), "en", "own", 0)]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for t in ("labels", "benchmark"):
        os.symlink(f"{FOLDER}/{t}.parquet", tmp_path / f"{t}.parquet")
    spark.createDataFrame(rows, docs.schema).union(docs.where("doc_id > 20")).write.parquet(str(tmp_path / "documents.parquet"))
    before = len(session._CUTS)
    left = {r.doc_id for r in cp.run(spark, str(tmp_path)).where("source = 'own'").collect()}
    assert left == {0, 1, 2, 3, 4, 5, 11}
    assert len(session._CUTS) == before


def test_a_stage_leaves_nothing_behind(spark, odd):
    with session.scratch(spark):
        assert session.cut(odd).count() == odd.count()
        made = session._CUTS[-1].removeprefix("file:")
        assert os.path.isdir(made)
    assert not os.path.isdir(made)
