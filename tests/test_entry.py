"""Registered queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from foliant.plans import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted(tuple(repr(round(r[i], 9)) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    if name in registry.ORACLES:
        r = con.execute(registry.ORACLES[name])
        assert _sorted(df.columns, rows) == _sorted([d[0] for d in r.description], r.fetchall())
    else:
        assert rows


@pytest.mark.parametrize("name,table,scans", [("undup_multi2", "lineitem", 1), ("undup_multi4", "lineitem", 1), ("undup_compensate_on", "lineitem", 1), ("undup_live_hops", "lineitem", 1), ("undup_nested", "conversations", 1), ("undup_nested_then_parent", "lineitem", 1), ("termlist_fields", "part", 1), ("termlist_fields", "orders", 1), ("termlist_collisions", "documents", 1)])
def test_tables_are_read_once(spark, name, table, scans):
    """Hits, and tables whose fields are listed, have one scan in the plan."""
    plan = registry.QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    column = {"lineitem": "l_returnflag", "conversations": "role", "part": "p_size", "orders": "o_orderdate", "documents": "text"}[table]
    assert sum("Relation [" in line and column in line for line in plan.splitlines()) == scans


def test_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_filters_reach_the_scan(spark):
    plan = registry.QUERIES["termlist_range_numeric"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<p_size:int>" in plan


@pytest.mark.parametrize("missing", ["foliant.llm", "corpus_pipeline", "regex", "tiktoken.no_such"])
def test_entry_without_the_training_data_package(monkeypatch, missing):
    """Neither a missing subpackage nor a library that only it needs takes the other queries away."""
    import sys

    import __spark_entry__ as e

    for name in [m for m in sys.modules if m.split(".")[0] in ("corpus_pipeline",) or m.startswith("foliant.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)
    own = set(registry.QUERIES)
    assert set(e.queries()) == own if missing != "tiktoken.no_such" else own <= set(e.queries())
    assert set(registry.ORACLES) <= set(e.oracle_sql())
