import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.llm import bpe, token_counts
from foliant.llm.vocabulary import Cuts, default_path, ranks

ALPHABET = ["a", "b", "'s", "'", "''", "don't", "%'s", " ", "  ", "\n", "\t", "\x1c", " ", " ", "　", "\u0085", "é", "à", "ß", "1", "22", ",", ".", "日本", "\U0001f600", "x" * 50, "́", "%%", "the", "ing", "\r\n", "​", "_", "٠", "ª", "<|endoftext|>"]


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(default_path())


def _whole(codec, text):
    return codec.core.encode_ordinary(text)


def _check(codec, texts):
    array = pa.array(texts, pa.string())
    ids, at = codec.encode(array)
    counts = token_counts.counter(default_path()).count(array)
    for i, text in enumerate(texts):
        wanted = _whole(codec, text or "")
        assert ids[at[i] : at[i + 1]].tolist() == wanted, text
        assert counts[i] == len(wanted), text
    data, _ = codec.decode(ids, at)
    assert data.tobytes() == "".join(t or "" for t in texts).encode()


def test_fragments_give_the_encoding_of_whole_texts(codec):
    rng = random.Random(1)
    _check(codec, [None, "", "a"] + ["".join(rng.choices(ALPHABET, k=rng.randrange(1, 30))) for _ in range(4000)])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_any_text(texts):
    _check(bpe.codec(default_path()), texts)


def test_without_a_pattern(codec):
    bare = bpe.codec(default_path(), False)
    for text in ["a b  c, d's\n", "xqzxqz " * 30, "", "日本 \U0001f600"]:
        ids, _ = bare.encode(pa.array([text]))
        assert ids.tolist() == (bare.core._encode_single_piece(text.encode()) if text else [])


def test_cuts_never_lie_inside_a_token():
    table = ranks(default_path())
    never = Cuts(table, pattern=False).table
    for token in table:
        assert not any(never[a * 256 + b] for a, b in zip(token, token[1:]))


def test_merges_equal_the_quadratic_way():
    table = ranks(default_path())

    def slow(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            found = [(table[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in table]
            if not found:
                return len(parts)
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(2)
    for _ in range(2000):
        piece = bytes(rng.choice(b"aabtheing \n\xc3\xa9") for _ in range(rng.randrange(1, 25)))
        assert len(piece) - token_counts.merges(piece, table) == slow(piece)


def test_decoding_rejects_unknown_identifiers(codec):
    with pytest.raises(ValueError):
        codec.decode(np.array([10**6]), np.array([0, 1]))


def test_odd_rows(spark, odd, empty, codec):
    rows = bpe.encode(odd).collect()
    assert len(rows) == odd.count() and all(r.round_trip in (True, None) for r in rows)
    texts = {}
    for r in odd.select("doc_id", "text").collect():
        texts.setdefault(r.doc_id, []).append(None if r.text is None else _whole(codec, r.text))
    for r in rows:
        assert r.token_ids in texts[r.doc_id]
        assert r.n_tokens == (None if r.token_ids is None else len(r.token_ids))
    back = bpe.decode(bpe.encode(odd, keep=("doc_id",))).where("doc_id = 7").head()
    assert back.text == "ünïcödé \U0001f600 日本語 '' 's"
    counted = token_counts.count(odd).collect()
    assert sorted((r.doc_id or -1, -1 if r.n_tokens is None else r.n_tokens) for r in counted) == sorted((r.doc_id or -1, -1 if r.n_tokens is None else r.n_tokens) for r in rows)
    for f in (bpe.encode, token_counts.count):
        assert f(empty).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, token_ids array<int>")).orderBy("doc_id").select("text").collect()[1].text == ""


def test_repeats_are_equal(odd):
    same = bpe.encode(odd).where("doc_id = 5").select(F.to_json(F.struct("*")).alias("j")).distinct()
    assert same.count() == 1


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 300_001 + "x", "a" + "　" * 40_000 + "b", "x" * 100_000 + " " * 100_000 + "'s", "\t \n" * 50_000 + " word", "-" * 70_000 + "1" * 70_000])
def test_long_runs_are_encoded_whole(codec, text):
    ids, _ = codec.encode(pa.array([text]))
    data, _ = codec.decode(ids, np.array([0, len(ids)]))
    assert data.tobytes().decode() == text
    assert token_counts.counter(default_path()).count(pa.array([text])).tolist() == [len(ids)]
    # the library itself copes with a shorter run of the same kind; that is cut and split here as well
    short = text[:3000]
    assert list(codec.core.encode_ordinary(short)) == [i for part in codec.split(short) for i in codec.core._encode_single_piece(part.encode())]


def test_long_blanks_in_a_table(spark):
    df = spark.createDataFrame([(1, " " * 1_000_000), (2, "\n" * 1_000_000), (3, "a b")], "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.encode(df).collect()}
    assert all(r.round_trip for r in got.values()) and got[3].n_tokens == 2
    assert {r.doc_id: r.n_tokens for r in token_counts.count(df).collect()} == {i: r.n_tokens for i, r in got.items()}


def test_many_heaps_at_once_equal_one_heap():
    table = ranks(default_path())
    pairs = token_counts.Pairs(table)
    rng = random.Random(3)
    for leaves in (16, 32):
        pieces = [bytes(rng.choice(b"aabtheing \n\xc3\xa9") for _ in range(rng.randrange(1, leaves + 1))) for _ in range(3000)] + [b"a" * leaves, b"th" * (leaves // 2)]
        assert token_counts.merges_of(pieces, pairs, leaves).tolist() == [token_counts.merges(p, table) for p in pieces]


def test_kept_columns_named_like_results(odd):
    kept = bpe.encode(odd, keep=("doc_id", "token_ids", "N_TOKENS"))
    assert kept.columns == ["doc_id", "token_ids_", "N_TOKENS_", "token_ids", "n_tokens", "round_trip"] and kept.select("token_ids_").distinct().head()[0] == 1
    assert token_counts.count(odd, keep=("N_TOKENS", "with.dot")).columns == ["N_TOKENS_", "with.dot", "n_tokens"]


def test_bytes_that_are_no_text(codec):
    data = pa.array([b"ab \xff\xfe cd\xc3", b"\x80" * 20_000], pa.binary())
    ids, at = codec.encode(data)
    back, ends = codec.decode(ids, at)
    assert [back[p:q].tobytes() for p, q in zip(ends, ends[1:])] == data.to_pylist()
    assert token_counts.counter(default_path()).count(data).tolist() == np.diff(at).tolist()
