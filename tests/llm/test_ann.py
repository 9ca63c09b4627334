import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import ann

FOLDER = "/root/testdata/sf0.01"


def brute(x, ids, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    return {i: d[r][np.argsort(d[r], kind="stable")[:k]] for r, i in enumerate(ids)}


def recall(rows, x, ids, k):
    wanted, found = brute(x, ids, k), {}
    for r in rows:
        found.setdefault(r.vec_id, []).append(r)
    hits = 0
    for i in ids:
        assert [r.rank for r in sorted(found[i], key=lambda r: r.rank)] == list(range(1, len(wanted[i]) + 1))
        assert len({r.neighbour_id for r in found[i]}) == len(found[i]) and i not in {r.neighbour_id for r in found[i]}
        hits += sum(r.distance <= wanted[i][-1] + 1e-9 for r in found[i])
    return hits / sum(map(len, wanted.values()))


@pytest.mark.parametrize("hashes", [None, 5])
@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
def test_recall_over_all_vectors(spark, hashes):
    df = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = df.collect()
    x, ids = np.array([r.embedding for r in rows], float), [r.vec_id for r in rows]
    assert recall(ann.neighbours(df, hashes=hashes).collect(), x, ids, 10) >= 0.9


def test_clusters_of_other_scales(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([c * 50 + rng.normal(size=(60, 8)) * s for c, s in zip(rng.normal(size=(8, 8)), [0.01, 0.1, 1, 5] * 2)])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    x32 = x.astype(np.float32).astype(float)
    assert recall(ann.neighbours(df, 5).collect(), x32, list(range(len(x))), 5) >= 0.9


def test_perturbations_come_by_chance_and_add_up():
    rng = np.random.default_rng(1)
    f, scale = rng.random((6, 3)), rng.uniform(0.05, 0.6, 6)
    q, moved, enough = ann.perturbations(f, scale, 0.8)
    assert enough.all()
    phi = lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2)))
    for i in range(6):
        chance = [math.prod(phi((m + 1 - a) / scale[i]) - phi((m - a) / scale[i]) for m, a in zip(row, f[i])) for row in moved[q == i]]
        assert chance == sorted(chance, reverse=True) or np.all(np.diff(chance) < 1e-6)
        assert sum(chance) >= 0.8 - 1e-4 and sum(chance[:-1]) < 0.8 + 1e-4


def test_copies_come_by_id(spark):
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(3, 16)) * 9, 40, axis=0)
    ids = rng.permutation(len(x)) * 7
    of = {int(i): r // 40 for r, i in enumerate(ids)}
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in ann.neighbours(df, 10).collect():
        assert r.distance == 0
        got.setdefault(r.vec_id, []).append((r.rank, r.neighbour_id))
    for i, group in of.items():
        assert sorted(got[i]) == list(enumerate(sorted(j for j, g in of.items() if g == group and j != i)[:10], 1))


def test_ties_across_blocks():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20000, 4)) * 3 + 20
    x[rng.choice(20000, 300, replace=False)] = x[0] + [1, 0, 0, 0]
    ids, q = rng.permutation(20000), np.concatenate([x[:1], x[5:300]])
    q_id, bound = np.concatenate([ids[:1], ids[5:300]]), np.where(np.arange(296) % 2, np.inf, 1.5)
    got = [[] for _ in q]
    for r, i, d in zip(*ann.nearest(q, q_id, bound, x, ids, 10)):
        got[r].append((d, i))
    for r in range(len(q)):
        d = np.sqrt(((q[r] - x) ** 2).sum(1))
        assert got[r] == [(d[c], ids[c]) for c in np.lexsort((ids, d)) if ids[c] != q_id[r] and d[c] <= bound[r]][:10]


def test_odd_rows(spark):
    rows = [(1, [0.0, 0.0], "a"), (2, [0.0, 1.0], "b"), (3, [0.0, 1.0], "b"), (3, [0.0, 1.0], "b"), (4, [0.0, 3.0], None), (None, [0.0, 0.0], "n"), (5, None, "n"), (6, [], "n"), (7, [float("nan"), 1.0], "n"), (8, [1.0, 2.0, 3.0], "n"), (9, [None, 1.0], "n"), (10, [float("inf"), 1.0], "n")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, key string").selectExpr("*", "1 as found", "2 as home", "3 as distance")
    got = {}
    for r in ann.neighbours(df, 3).collect():
        got.setdefault(r.vec_id, []).append((r.rank, r.neighbour_id, round(r.distance, 6)))
    assert {k: sorted(v) for k, v in got.items()} == {
        1: [(1, 2, 1.0), (2, 3, 1.0), (3, 4, 3.0)], 2: [(1, 3, 0.0), (2, 1, 1.0), (3, 4, 2.0)], 3: [(1, 2, 0.0), (2, 1, 1.0), (3, 4, 2.0)], 4: [(1, 2, 2.0), (2, 3, 2.0), (3, 1, 3.0)]}
    assert ann.neighbours(df.where("1 = 0")).count() == 0 and ann.neighbours(df.where("vec_id = 1")).count() == 0


def _exact(ids, x, k, asked=None):
    """``(query, rank, neighbour, distance)`` by comparing all, ties by id."""
    out = {}
    for r, i in enumerate(ids):
        if asked is None or asked(i):
            d = np.sqrt(((x[r] - x) ** 2).sum(1))
            order = [c for c in sorted(range(len(ids)), key=lambda c: (d[c], ids[c])) if ids[c] != i][:k]
            out[i] = [(n + 1, ids[c], d[c]) for n, c in enumerate(order)]
    return out


def _got(rows):
    out = {}
    for r in rows:
        out.setdefault(r.vec_id, []).append((r.rank, r.neighbour_id, r.distance))
    return {i: sorted(v) for i, v in out.items()}


def _same(got, wanted):
    assert got.keys() == wanted.keys()
    for i in wanted:
        assert [g[:2] for g in got[i]] == [w[:2] for w in wanted[i]], i
        assert np.allclose([g[2] for g in got[i]], [w[2] for w in wanted[i]], rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("k", [1, 2, 3, 5, 10])
def test_few_neighbours_and_many_ties(spark, k):
    # a grid of 48 different vectors, several ids each; so many hashes that every query is compared exactly
    ids = [int(i) for i in np.random.default_rng(k).permutation(400)]
    x = np.array([[i % 4, i // 4 % 4, i // 16 % 3] for i in range(400)], float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>").repartition(3)
    asked = lambda i: i % 5 == 0
    for options in ({"hashes": 40}, {"hashes": 40, "tile": 7}, {"hashes": 1, "tile": 16}):
        _same(_got(ann.neighbours(df, k, queries=F.expr("vec_id % 5 = 0"), **options).collect()), _exact(ids, x, k, asked))


def test_distances_far_from_the_origin(spark):
    rng = np.random.default_rng(8)
    x = 1e4 + rng.normal(size=(300, 8)) * 1e-3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    wanted = {(i, j): d for i, rows in _exact(list(range(300)), x, 300).items() for _, j, d in rows}
    for r in ann.neighbours(df, 3).collect():
        assert abs(r.distance - wanted[r.vec_id, r.neighbour_id]) <= 1e-9


def test_tiles_lose_nothing(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(500, 6)) * 0.05, rng.normal(size=(100, 6)) * 5]).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    assert _got(ann.neighbours(df, 4, hashes=4, tile=20).collect()) == _got(ann.neighbours(df, 4, hashes=4).collect())


def test_ids_of_other_types(spark):
    rng = np.random.default_rng(10)
    x = rng.integers(0, 3, size=(60, 3)).astype(float)
    ids = [f"v{i:02d}" for i in rng.permutation(60)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)] + [(None, [0.0, 0.0, 0.0])], "vec_id string, embedding array<double>")
    _same(_got(ann.neighbours(df, 3, hashes=40, queries=F.col("vec_id") > "v30").collect()), _exact(ids, x, 3, lambda i: i > "v30"))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
def test_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in rows], float), [r.vec_id for r in rows]
    wanted, got = _exact(ids, x, ann.NEIGHBOURS, lambda i: i % 50 == 0), _got(ann.query(spark, FOLDER).collect())
    assert got.keys() == wanted.keys()
    assert sum(g[2] <= wanted[i][-1][2] + 1e-9 for i in got for g in got[i]) >= 0.9 * sum(map(len, wanted.values()))
