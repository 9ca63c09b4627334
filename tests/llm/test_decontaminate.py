import itertools
import random
import time

import pyarrow as pa
import pytest

from foliant.llm import decontaminate as dc
from foliant.llm.text import words


def brute(docs, items):
    """Best overlap of each document and item over all diagonals and windows."""
    out = set()
    for (d, a), (i, b) in itertools.product(docs, items):
        a, b = (a or "").lower().split(), (b or "").lower().split()
        if len(b) < dc.LEAST_WORDS:
            continue
        w = min(dc.WINDOW, len(b))
        least = dc.WINDOW - dc.SUBSTITUTED if len(b) >= dc.WINDOW else w
        best = None
        for begin in range(-len(b), len(a)):
            equal = [0 <= begin + k < len(a) and a[begin + k] == b[k] for k in range(len(b))]
            for s in range(len(b) - w + 1):
                m = sum(equal[s : s + w])
                if m >= least:
                    key = (-m, s, begin + s)
                    best = key if best is None else min(best, key)
        if best:
            out.add((d, i, best[2], best[1], -best[0], w))
    return out


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(40)] + ["the", "of"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([5, 7, 10, 12, 13, 14, 20, 35, 60])] + [(90, ""), (91, None)]
    docs = []
    for k in range(80):
        body = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 80))]
        text = rng.choice(items[:9])[1].split()
        for _ in range(rng.randrange(4)):
            text[rng.randrange(len(text))] = "SUB"
        lo = rng.randrange(len(text))
        part = text if rng.random() < 0.6 else text[lo : lo + 15]
        at = rng.randrange(len(body) + 1)
        docs.append((k, " ".join(body[:at] + part + body[at:])))
    return docs, items


@pytest.mark.parametrize("local_bytes", [dc.LOCAL_BYTES, 0])
def test_overlaps_against_brute_force(spark, planted, local_bytes):
    docs, items = planted
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    wanted = brute(docs, items)
    assert len(wanted) > 25
    assert {tuple(r) for r in dc.overlaps(d, b, local_bytes=local_bytes).collect()} == wanted
    left = {r.doc_id for r in dc.clean(d, b, local_bytes=local_bytes).collect()}
    assert left == {i for i, _ in docs} - {w[0] for w in wanted}


def test_any_two_substitutions_leave_a_seed():
    for gone in itertools.combinations(range(dc.WINDOW), dc.SUBSTITUTED):
        assert any(not any(place - start in mask for place in gone) for mask in dc.MASKS for start in range(dc.WINDOW - mask[-1]))


@pytest.mark.parametrize("local_bytes", [dc.LOCAL_BYTES, 0])
def test_odd_rows(spark, odd, empty, local_bytes):
    item = "one two three four five six seven eight"
    bench = spark.createDataFrame([(1, item), (1, item), (None, item.upper()), (2, None), (3, ""), (4, "tie")], "item_id long, text string")
    extra = odd.unionByName(odd.limit(1).selectExpr("*").drop("doc_id", "text").selectExpr("cast(null as long) as doc_id", f"'x {item} y' as text", "*")).unionByName(odd.limit(2).drop("text").selectExpr(f"'{item}' as text", "*"))
    got = dc.overlaps(extra, bench, local_bytes=local_bytes).collect()
    assert (None, None, 1, 0, 8, 8) in {tuple(r) for r in got} and (None, 1, 1, 0, 8, 8) in {tuple(r) for r in got}
    assert len(got) == len(set(got)) and all(r.item_id in (None, 1) for r in got)
    left = dc.clean(extra, bench, local_bytes=local_bytes)
    assert left.schema == extra.schema and left.count() == odd.count()
    assert dc.overlaps(empty, bench, local_bytes=local_bytes).count() == 0 and dc.clean(empty, bench, local_bytes=local_bytes).count() == 0
    assert dc.overlaps(odd, bench.where("1 = 0"), local_bytes=local_bytes).count() == 0 and dc.clean(odd, bench.where("1 = 0"), local_bytes=local_bytes).count() == odd.count()


def _repetitive(seed):
    rng = random.Random(seed)
    words_ = ["a", "b", "c"]
    text = lambda n: " ".join(sum(([rng.choice(words_)] * rng.randrange(1, 9) if rng.random() < 0.5 else rng.choice([["a", "b"], ["a", "b", "c"], ["b"]]) * rng.randrange(1, 7) for _ in range(n)), []))
    return [(k, text(rng.randrange(1, 9))) for k in range(12)], [(k, text(rng.randrange(1, 6))) for k in range(8)]


@pytest.mark.parametrize("seed", range(6))
def test_repetitive_texts_against_brute_force(seed):
    docs, items = _repetitive(seed)
    index = dc.Index.of(pa.array([t for _, t in items]))
    got = index.overlaps(*words(pa.array([t for _, t in docs])))
    assert {tuple(int(v) for v in row) for row in zip(*got)} == brute(docs, items)


@pytest.mark.parametrize("at_once", [1, 50, 1 << 20])
def test_parts_of_any_size(monkeypatch, planted, at_once):
    docs, items = planted
    monkeypatch.setattr(dc, "AT_ONCE", max(at_once, 16))
    index = dc.Index.of(pa.array([t for _, t in items]))
    got = index.overlaps(*words(pa.array([t for _, t in docs])))
    assert {(docs[r[0]][0], items[r[1]][0], *(int(v) for v in r[2:])) for r in zip(*got)} == brute(docs, items)


def test_time_is_linear_in_repetitive_texts():
    index = dc.Index.of(pa.array(["a " * 60, "x y " * 30, *("b " * n for n in range(7, 60))]))
    took = []
    for n in (100_000, 400_000):
        tokens, at = words(pa.array(["a " * n + "x y " * n + "b " * n]))
        began = time.process_time()
        index.overlaps(tokens, at)
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.3 and took[1] < 20


@pytest.mark.parametrize("local_bytes", [dc.LOCAL_BYTES, 0])
def test_ids_of_any_type(spark, local_bytes):
    item = "one two three four five six seven eight"
    bench = spark.createDataFrame([("q1", item), (None, item), ("q2", "too short")], "item_id string, text string")
    docs = spark.createDataFrame([("abc", f"x {item}"), ("d", "clean"), (None, item), ("loop", "a " * 50_000)], "doc_id string, text string")
    got = {(r.doc_id, r.item_id, r.doc_pos) for r in dc.overlaps(docs, bench, local_bytes=local_bytes).collect()}
    assert got == {("abc", "q1", 1), ("abc", None, 1), (None, "q1", 0), (None, None, 0)}
    assert {r.doc_id for r in dc.clean(docs, bench, local_bytes=local_bytes).collect()} == {"d", "loop"}
    assert [tuple(r) for r in dc.too_short(bench).collect()] == [("q2", 2)]


def test_many_items(spark):
    rows = [(f"i{k}", " ".join(f"w{k}x{j}" for j in range(9))) for k in range(1200)]
    docs = spark.createDataFrame([(1, "pre " + rows[1100][1]), (2, "nothing")], "doc_id int, text string")
    assert [(r.doc_id, r.item_id) for r in dc.overlaps(docs, spark.createDataFrame(rows, "item_id string, text string")).collect()] == [(1, "i1100")]
