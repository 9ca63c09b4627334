import random

import numpy as np
import pyarrow as pa
import pytest

from foliant.llm import simhash
from foliant.llm.text import words


def groups(pairs, ids):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids if root(i) != i}


def brute(texts):
    """doc_id to smallest of its group, over all pairs within the radius."""
    ids = list(texts)
    hashes, at = words(pa.array(list(texts.values()), pa.string()))
    fp = simhash.fingerprints(hashes, at)
    some = np.diff(at) > 0
    bits = np.unpackbits(fp.view(np.uint8), axis=1).astype(int)
    distance = (bits[:, None] != bits[None]).sum(-1)
    close = (distance <= simhash.RADIUS) & some[:, None] & some[None]
    pairs = [(ids[i], ids[j]) for i, j in zip(*np.nonzero(np.triu(close, 1)))]
    return pairs, groups(pairs, ids)


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(3000)]
    common = vocabulary[:20]
    texts = {}
    for k in range(n):
        base = [rng.choice(common if rng.random() < 0.3 else vocabulary) for _ in range(rng.randrange(40, 300))]
        texts[len(texts)] = " ".join(base)
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = [w if rng.random() > 0.04 else rng.choice(vocabulary) for w in base]
            texts[len(texts)] = " ".join(copy)
    return texts


def test_words():
    hashes, at = words(pa.array(["Ab c-d", None, "", "AB", "é é2", "x" * 3000]))
    assert np.diff(at).tolist() == [3, 0, 0, 1, 2, 1]
    assert hashes[0] == hashes[3] and len(set(hashes.tolist())) == 6


def test_bit_slices_equal_popcounts():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, (30, 4), dtype=np.uint64)
    fp = np.concatenate([base, base ^ np.uint64(0b1011), base ^ (rng.integers(0, 2**63, (30, 4), dtype=np.uint64) & rng.integers(0, 2**63, (30, 4), dtype=np.uint64) & rng.integers(0, 2**63, (30, 4), dtype=np.uint64))])
    bits = np.unpackbits(fp.view(np.uint8), axis=1).astype(int)
    distance = (bits[:, None] != bits[None]).sum(-1)
    plane = simhash.planes(fp)
    q, w = (x.ravel() for x in np.meshgrid(np.arange(len(fp)), np.arange(plane.shape[1]), indexing="ij"))
    for radius in (0, 5, 20, 31, 48, 64, 255):
        t, found = simhash.within(plane, q, w, np.full(len(q), ~np.uint64(0)), radius)
        got = np.zeros((len(fp), plane.shape[1] * 64), bool)
        for k, f in zip(t, found):
            got[q[k], 64 * w[k] : 64 * w[k] + 64] = [(int(f) >> i) & 1 for i in range(64)]
        assert (got[:, : len(fp)] == (distance <= radius)).all(), radius


@pytest.mark.parametrize("options", [{}, dict(tile=8), dict(one_task=0), dict(tile=3, one_task=0)])
def test_near_duplicates_against_all_pairs(spark, options):
    texts = corpus()
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").repartition(3)
    pairs, wanted = brute(texts)
    got = {r.doc_id: r.duplicate_of for r in simhash.near_duplicates(df, **options).collect()}
    joined = sum(got.get(a, a) == got.get(b, b) for a, b in pairs)
    assert len(pairs) > 30 and joined >= 0.9 * len(pairs)
    assert set(got) <= set(wanted) and all(wanted[i] == wanted.get(g, g) or wanted[i] == g for i, g in got.items())


def test_recall_is_the_same_at_hot_keys(spark):
    shared = " ".join(f"passage{i}" for i in range(60))
    texts = {i: shared + " " + " ".join(f"own{i}x{k}" for k in range(100)) for i in range(200)}
    texts |= {200 + i: texts[i] + " more" for i in range(20)}
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    _, wanted = brute(texts)
    for tile in (simhash.TILE, 50):
        assert {r.doc_id: r.duplicate_of for r in simhash.near_duplicates(df, tile=tile).collect()} == wanted


@pytest.mark.parametrize("sided", [False, True])
def test_a_large_cluster_is_not_compared_pair_by_pair(monkeypatch, sided):
    """Rows that are joined already aren't compared again: 6000 near copies in one block, and 200 rows of their own."""
    rng = np.random.default_rng(4)
    fp = np.repeat(rng.integers(0, 2**63, (1, 4), dtype=np.uint64), 6000, 0)
    for _ in range(4):
        fp[np.arange(6000), rng.integers(0, 4, 6000)] ^= np.uint64(1) << rng.integers(0, 63, 6000).astype(np.uint64)
    fp = np.concatenate([fp, rng.integers(0, 2**63, (200, 4), dtype=np.uint64)])
    compared, within = [], simhash.within
    monkeypatch.setattr(simhash, "within", lambda plane, query, *rest: compared.append(len(query)) or within(plane, query, *rest))
    row, first = simhash.forest(np.zeros(6200, int), fp, np.arange(6200) % 2 if sided else None)
    assert row.tolist() == list(range(1, 6000)) and not first.any()
    assert sum(compared) < 6200 * 97 / 2 / 4


def test_stars_equal_union_find(spark):
    rng = random.Random(9)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 430)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    wanted = groups(pairs, {i for p in pairs for i in p})
    for limit in (10**6, 0):
        assert {r.doc_id: r.duplicate_of for r in simhash.components(edges, limit).collect()} == wanted


def test_odd_rows(odd, empty):
    assert [tuple(r) for r in simhash.near_duplicates(odd).collect()] == [(9, 8)]
    out = simhash.deduplicated(odd)
    assert out.schema == odd.schema
    ids = sorted((r.doc_id if r.doc_id is not None else -1) for r in out.collect())
    assert ids == [-1, -1, 1, 2, 3, 4, 5, 6, 6, 7, 8]  # one id with two texts is two documents
    assert simhash.near_duplicates(empty).count() == 0 and simhash.deduplicated(empty).count() == 0


def test_ids_of_other_types(spark):
    texts = corpus(4, 20)
    df = spark.createDataFrame([(f"d{i:03d}", t) for i, t in texts.items()] + [(None, texts[0])], "doc_id string, text string")
    numbers = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    wanted = {(f"d{r.doc_id:03d}", f"d{r.duplicate_of:03d}") for r in simhash.near_duplicates(numbers).collect()}
    assert wanted and {tuple(r) for r in simhash.near_duplicates(df).collect()} == wanted
    left = [r.doc_id for r in simhash.deduplicated(df).collect()]
    assert sorted(left, key=str) == sorted([None, *({f"d{i:03d}" for i in texts} - {a for a, _ in wanted})], key=str)


def test_one_id_with_several_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a, "z"), (1, b, "z"), (2, b + " more", "z"), (3, c, "q"), (3, c, "p"), (3, c, "p"), (None, a, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id string")
    for _ in range(2):
        got = sorted((str(r.doc_id), r.text, r["__id"]) for r in simhash.deduplicated(df.repartition(3)).collect())
        assert got == sorted([("1", a, "z"), ("1", b, "z"), ("3", c, "p"), ("None", a, "n")])


def test_near_copies_by_their_originals(spark):
    """What line dedup leaves of a copy doesn't resemble its group, the original does."""
    lines = [" ".join(f"w{d}x{k}" for k in range(12)) for d in range(8)]
    base = "\n".join(lines)
    near = "\n".join([*lines[:7], "another last line altogether here"])
    other = "\n".join(" ".join(f"o{d}x{k}" for k in range(12)) for d in range(8))
    originals = spark.createDataFrame([(1, base), (2, near), (3, other), (4, base), (4, other), (7, near)], "doc_id long, text string")
    docs = spark.createDataFrame([(1, base), (2, "another last line altogether here"), (3, other), (4, "left of four"), (5, "nothing before"), (7, "not a line of seven")], "doc_id long, text string")
    left = lambda **o: sorted(r.doc_id for r in simhash.deduplicated(docs, **o).collect())
    assert left() == [1, 2, 3, 4, 5, 7] and left(originals=originals) == [1, 3, 4, 5, 7]
    again = docs.union(docs.where("doc_id = 2"))
    assert sorted(r.doc_id for r in simhash.deduplicated(again, originals=originals).collect()) == [1, 2, 3, 4, 5, 7]


def test_texts_are_not_carried_beside_their_sketches(spark):
    """A row of 62 MB that an Arrow UDF kept beside its result ended executors of 1800 MB heap; lines are found as before."""
    df = spark.createDataFrame([(1, "a b\n  \nc d\na b"), (2, " \n"), (3, "c d"), (None, "e")], "doc_id long, text string")
    sketches = simhash._sketched(df, "doc_id", "text")
    plan = sketches._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
    lines = {r.id: r.lines for r in sketches.collect()}
    assert set(lines) == {1, 3} and len(lines[1]) == 3 and lines[1][0] == lines[1][2] and lines[1][1:2] == lines[3]
    assert {r.id: r.lines for r in simhash._sketched(df, "doc_id", "text", 1).collect()} == {1: lines[1][:1], 3: lines[3]}
    assert {r.id: r.lines for r in simhash._sketched(df, "doc_id", "text", 0).collect()} == {1: [], 3: []}
