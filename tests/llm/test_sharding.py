import hashlib

import numpy as np
import pytest

from foliant.llm import sharding


def slow(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jumps_equal_the_plain_loop():
    keys = np.random.default_rng(0).integers(0, 2**64, 3000, dtype=np.uint64)
    for n in (1, 2, 7, 1000, 100000):
        assert sharding.jump(keys, n).tolist() == [slow(int(k), n) for k in keys]


def test_appending_moves_only_to_new_shards():
    keys = np.random.default_rng(1).integers(0, 2**64, 20000, dtype=np.uint64)
    a, b = sharding.jump(keys, 90), sharding.jump(keys, 100)
    moved = a != b
    assert (b[moved] >= 90).all() and abs(moved.mean() - 0.1) < 0.01
    assert np.bincount(a, minlength=90).min() > 150


def test_rows(odd, empty):
    rows = sharding.assign(odd, 16, 4).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r.doc_id is None:
            assert (r.shard, r.shard_after, r.moved) == (None, None, None)
        else:
            key = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:16], 16)
            assert (r.shard, r.shard_after) == (slow(key, 16), slow(key, 20)) and r.moved == (r.shard != r.shard_after)
    assert sharding.assign(empty, 16).count() == 0
    assert sharding.assign(odd, 3, key="text").where("text = 'tie'").select("shard").distinct().count() == 1
    with pytest.raises(ValueError):
        sharding.assign(odd, 0)
