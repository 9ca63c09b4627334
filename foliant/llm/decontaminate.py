"""Benchmark decontamination by spaced-seed hashing.

Two fixed masks each hash 6 words of a stretch and ignore those between.  Equal hashes of a document and a
benchmark item put them on a diagonal; there the words around the hit are compared one by one.  An overlap is
``WINDOW`` aligned words of which at most ``SUBSTITUTED`` differ.  The masks are chosen so that whichever 2 of
13 words are substituted, some hash is untouched: every such overlap is found.  Of places with the same words on
both sides, as far as a window around the hash reaches, only a text's first is looked at: the others' overlaps
are the same, later.  So a text of one word or phrase over and over costs what its first repetitions do.

The benchmark's words and hashes go to all executors only while its text is at most ``LOCAL_BYTES`` long; each
document is then finished where it is read, without a shuffle.  A larger benchmark is joined by hash: a bitmap
of fixed size thins out the documents' hashes, the rest meet the benchmark's in a shuffle, and only documents
that share one are read again and compared.  Both ways give the same rows.

Results for odd inputs: words are runs of letters, marks and numbers, case is ignored.  An item of 7 to 12 words
must occur whole and unchanged; one of fewer words, an empty or a null one carries too little evidence and never
matches (``too_short`` lists them).  Null and empty documents never match; very long ones are compared whole.  A null
``doc_id`` or ``item_id`` is reported as null; ids of any type stay as they are.  Repeated
rows give the same result row, which is returned once.  An empty table gives an empty result.  Of overlaps of one
document and item the one with the fewest substitutions, then the first in the item, then in the document, is
reported.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.line_dedup import text_hash
from foliant.llm.session import cut, small_batches, table
from foliant.llm.text import mix, ragged, slices, words

#: Places of a stretch of words that a mask hashes.
MASKS = ((0, 1, 2, 3, 5, 6), (0, 2, 3, 7, 8, 9))
WINDOW, SUBSTITUTED = 13, 2
LEAST_WORDS = MASKS[0][-1] + 1
#: Up to so many bytes of benchmark text are sent to every executor.
LOCAL_BYTES = 4 << 20
#: Bits of the bitmap that thins out hashes where the benchmark is larger.
BITMAP = 1 << 27

U64 = np.uint64
_HIT = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("doc_pos", T.IntegerType()), T.StructField("item_pos", T.IntegerType()), T.StructField("matched", T.IntegerType()), T.StructField("compared", T.IntegerType())])


def seed_hashes(tokens: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Hash at each place where the mask fits into ``tokens``."""
    n = max(0, len(tokens) - mask[-1])
    out = np.full(n, len(mask) * 2 + mask[-1], U64)
    for k, p in enumerate(mask):
        out += tokens[p : p + n] * U64(0x9E3779B97F4A7C15 * (2 * k + 3) % (1 << 64) | 1)
    return mix(out)


#: Places, pairs of places or words that are handled at once.
AT_ONCE = 1 << 20
_AROUND = np.arange(1 - WINDOW, WINDOW)
_WEIGHTS = mix(np.arange(1, len(_AROUND) + 1, dtype=U64)) | U64(1)


def first_of_alike(tokens: np.ndarray, at: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which of ascending ``places`` are their text's first with these words around it; beyond a text there are none."""
    text = np.searchsorted(at, places, "right") - 1
    keys = np.zeros(len(places), U64)
    step = AT_ONCE // 16
    for lo in range(0, len(places), step):
        p, t = places[lo : lo + step, None] + _AROUND, text[lo : lo + step, None]
        inside = (p >= at[t]) & (p < at[t + 1])
        near = np.where(inside, tokens[np.where(inside, p, 0)], U64(0))
        keys[lo : lo + step] = mix((near * _WEIGHTS).sum(1, dtype=U64)) + mix(t[:, 0].astype(U64) + U64(1))
    return np.sort(np.unique(keys, return_index=True)[1])


def seeds(tokens: np.ndarray, at: np.ndarray, wanted=None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts under all masks, and the places in ``tokens`` where they begin; ``wanted`` says which hashes count."""
    end = np.repeat(at[1:], np.diff(at))
    found, places = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for mask in MASKS:
        h = seed_hashes(tokens, mask)
        p = np.arange(len(h)) if wanted is None else np.flatnonzero(wanted(h))
        p = p[p + mask[-1] < end[p]]
        p = p[first_of_alike(tokens, at, p)]
        found.append(h[p])
        places.append(p)
    return np.concatenate(found), np.concatenate(places)


@dataclass
class Index:
    """A benchmark's words and its sorted seed hashes."""

    tokens: np.ndarray
    at: np.ndarray
    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray
    likely: np.ndarray

    @staticmethod
    def of(texts: pa.Array) -> Index:
        tokens, at = words(texts)
        h, p = seeds(tokens, at)
        order = np.argsort(h, kind="stable")
        h, p = h[order], p[order]
        item = np.searchsorted(at, p, "right") - 1
        likely = np.zeros(1 << 20, bool)
        likely[h >> U64(44)] = True
        return Index(tokens, at, h, item, p - at[item], likely)

    def diagonals(self, tokens: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Distinct (text, item, place in ``tokens`` where the item would begin) with equal seeds, in parts."""
        h, p = seeds(tokens, at, lambda h: self.likely[h >> U64(44)])
        lo, hi = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        some = hi > lo
        p, lo, hi = p[some], lo[some], hi[some]
        for a, b in _parts(hi - lo):
            which = ragged(lo[a:b], (hi - lo)[a:b])
            place = np.repeat(p[a:b], (hi - lo)[a:b])
            text, item, begin = np.searchsorted(at, place, "right") - 1, self.item[which], place - self.place[which]
            order = np.lexsort((begin, item, text))
            text, item, begin = text[order], item[order], begin[order]
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(text) != 0) | (np.diff(item) != 0) | (np.diff(begin) != 0)
            yield text[new], item[new], begin[new]

    def overlaps(self, tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Best overlap per (text, item), see ``verify``."""
        found = [tuple(np.zeros((6, 0), np.int64))]
        for text, item, begin in self.diagonals(tokens, at):
            for a, b in _parts(np.diff(self.at)[item]):
                found.append(verify(tokens, at, text[a:b], begin[a:b], self.tokens, self.at, item[a:b]))
        if len(found) == 2:
            return found[1]
        return _best(*(np.concatenate(x) for x in zip(*found)))


def _parts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about ``AT_ONCE`` in total; a larger one alone."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + AT_ONCE, "right")))
        yield lo, hi
        lo = hi


def _best(text: np.ndarray, item: np.ndarray, doc_pos: np.ndarray, item_pos: np.ndarray, matched: np.ndarray, compared: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per (text, item) the overlap with the most matched words, then the first in the item, then in the text."""
    order = np.lexsort((doc_pos, item_pos, -matched, item, text))
    best = np.ones(len(order), bool)
    best[1:] = (np.diff(text[order]) != 0) | (np.diff(item[order]) != 0)
    order = order[best]
    return tuple(x[order] for x in (text, item, doc_pos, item_pos, matched, compared))


def verify(tokens: np.ndarray, at: np.ndarray, text: np.ndarray, begin: np.ndarray, item_tokens: np.ndarray, item_at: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, ...]:
    """Best overlap per (text, item): text, item, place in the text, place in the item, matched and compared words."""
    size = (item_at[1:] - item_at[:-1])[item]
    window = np.minimum(size, WINDOW)
    flat_item = ragged(item_at[item], size)
    within = ragged(np.zeros(len(size), np.int64), size)
    place = np.repeat(begin, size) + within
    inside = (place >= np.repeat(at[text], size)) & (place < np.repeat(at[text + 1], size))
    equal = np.zeros(len(place), bool)
    equal[inside] = tokens[place[inside]] == item_tokens[flat_item[inside]]
    total = np.concatenate([[0], np.cumsum(equal)])
    first = np.cumsum(size) - size
    n_windows = size - window + 1
    w_at = ragged(first, n_windows)
    of = np.repeat(np.arange(len(size)), n_windows)
    matched = total[w_at + window[of]] - total[w_at]
    enough = matched >= np.where(size >= WINDOW, WINDOW - SUBSTITUTED, size)[of]
    of, w_at, matched = of[enough], w_at[enough], matched[enough]
    item_pos = w_at - first[of]
    return _best(text[of], item[of], begin[of] + item_pos - at[text[of]], item_pos, matched, window[of])


def _hits(found: tuple[np.ndarray, ...], n: int) -> pa.Array:
    text, *values = found
    fields = [pa.field(f.name, pa.int32()) for f in _HIT.fields]
    rows = pa.StructArray.from_arrays([pa.array(v.astype(np.int32)) for v in values], fields=fields)
    ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), rows)


def _local(index) -> object:
    """Arrow UDF from a text to its overlaps with the broadcast benchmark."""

    @F.arrow_udf(T.ArrayType(_HIT))
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bench = index.value
        for part in parts:
            out = []
            for lo, hi in slices(part):
                tokens, at = words(part.slice(lo, hi - lo))
                out.append(_hits(bench.overlaps(tokens, at), hi - lo))
            yield pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.struct([(f.name, pa.int32()) for f in _HIT.fields])))

    return run


def _is_local(benchmark: DataFrame, text: str, most: int) -> bool:
    size = benchmark.agg(F.sum(F.octet_length(F.col(text)))).head()[0] or 0
    return size <= most


def _broadcast(benchmark: DataFrame, item_id: str, text: str):
    """Ids of the items, and the broadcast index; items too short in bytes to match stay behind, so both are bounded."""
    small_batches()
    rows = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where(F.octet_length("text") >= 2 * LEAST_WORDS - 1).toArrow().combine_chunks()
    texts = rows["text"].combine_chunks() if rows.num_rows else pa.array([], pa.string())
    return rows["item_id"].to_pylist(), benchmark.sparkSession.sparkContext.broadcast(Index.of(texts))


def too_short(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, n_words`` of the items of too few words to be found."""
    n = F.coalesce(F.size(_words(F.col(text))), F.lit(0))
    return benchmark.select(F.col(item_id).alias("item_id"), n.alias("n_words")).where(F.col("n_words") < LEAST_WORDS)


_COLUMNS = "doc_pos", "item_pos", "matched", "compared"


@F.arrow_udf(T.ArrayType(T.LongType()))
def _words(part: pa.Array) -> pa.Array:
    tokens, at = words(part)
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(tokens.view(np.int64)))


def _seed_rows(names: list[str], keep):
    """For ``mapInArrow``: rows ``key columns, seed, place`` of a table ``key columns, text``."""

    def likely(h: np.ndarray) -> np.ndarray:
        b = h & U64(BITMAP - 1)
        return (keep.value[b >> U64(3)] >> (b & U64(7)).astype(np.uint8)) & 1 > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for lo, hi in slices(texts):
                tokens, at = words(texts.slice(lo, hi - lo))
                h, p = seeds(tokens, at, None if keep is None else likely)
                row = np.searchsorted(at, p, "right") - 1
                keys = [batch.column(i).slice(lo, hi - lo).take(pa.array(row)) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(h.view(np.int64)), pa.array((p - at[row]).astype(np.int32))], names=names)

    return run


def _with_seeds(rows: DataFrame, place: str, keep=None) -> DataFrame:
    """``mapInArrow`` of ``_seed_rows``: the key columns, ``seed`` and the place."""
    *keys, _ = rows.schema.fields
    made = T.StructType([*keys, T.StructField("seed", T.LongType()), T.StructField(place, T.IntegerType())])
    return rows.mapInArrow(_seed_rows(made.names, keep), made)


@F.arrow_udf(T.ArrayType(_HIT))
def _verified(tokens: pa.Array, item_tokens: pa.Array, begins: pa.Array) -> pa.Array:
    out = []
    for t, i, b in zip(tokens, item_tokens, begins):
        t, i, b = (x.values.to_numpy(zero_copy_only=False) for x in (t, i, b))
        zero = np.zeros(len(b), np.int64)
        out.append(_hits(verify(t.view(U64), np.array([0, len(t)]), zero, b.astype(np.int64), i.view(U64), np.array([0, len(i)]), zero), 1))
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.struct([(f.name, pa.int32()) for f in _HIT.fields])))


def _joined(docs: DataFrame, benchmark: DataFrame, doc_id: str, text: str, item_id: str, item_text: str) -> DataFrame:
    """``doc_id, text_hash, item_id`` and the overlap, by a join on seeds."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), text_hash(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    items = benchmark.select(F.col(item_id).alias("item_id"), text_hash(F.col(item_text)).alias("item_hash"), F.col(item_text).alias("text")).distinct()
    item_seeds = cut(_with_seeds(items, "item_place"))
    low = F.col("seed").bitwiseAND(F.lit(BITMAP - 1))
    parts = item_seeds.select(low.alias("b")).groupBy(F.expr("bitmap_bucket_number(b + 1)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(b + 1))").alias("bits"))
    bits = np.zeros(BITMAP // 8, np.uint8)
    for k, part in parts.toLocalIterator():
        bits[(k - 1) * 4096 : k * 4096] = np.frombuffer(part, np.uint8)
    keep = spark.sparkContext.broadcast(bits)
    doc_seeds = _with_seeds(docs, "place", keep)
    met = doc_seeds.join(item_seeds, "seed").select("doc_id", "text_hash", "item_id", "item_hash", (F.col("place") - F.col("item_place")).alias("begin"))
    pairs = cut(met.groupBy("doc_id", "text_hash", "item_id", "item_hash").agg(F.sort_array(F.collect_set("begin")).alias("begins")))

    def same(a: DataFrame, b: DataFrame, id_: str, hash_: str) -> Column:
        return a[id_].eqNullSafe(b[id_]) & (a[hash_] == b[hash_])

    wanted = pairs.select("doc_id", "text_hash").distinct()
    full = docs.join(wanted, same(docs, wanted, "doc_id", "text_hash"), "left_semi").dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", _words("text").alias("tokens"))
    coded = items.select("item_id", "item_hash", _words("text").alias("item_tokens"))
    both = pairs.join(full, same(pairs, full, "doc_id", "text_hash")).select(pairs["*"], "tokens")
    both = both.join(coded, same(both, coded, "item_id", "item_hash")).select(both["*"], "item_tokens")
    hits = both.select("doc_id", "text_hash", "item_id", F.explode(_verified("tokens", "item_tokens", "begins")).alias("h"))
    return hits.select("doc_id", "text_hash", "item_id", *[f"h.{c}" for c in _COLUMNS])


def overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """``doc_id, item_id, doc_pos, item_pos, matched, compared``: the best overlap of each contaminated document and item.

    Places are counted in words from 0; of ``compared`` words from there, ``matched`` are the same.
    """
    if not _is_local(benchmark, item_text, local_bytes):
        return _joined(docs, benchmark, doc_id, text, item_id, item_text).drop("text_hash").distinct()
    ids, index = _broadcast(benchmark, item_id, item_text)
    hits = docs.select(F.col(doc_id).alias("doc_id"), F.explode(_local(index)(F.col(text))).alias("h"))
    kind = benchmark.schema[item_id].dataType
    if len(ids) > 1000:  # too many for one expression
        names = docs.sparkSession.createDataFrame(list(enumerate(ids)), T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", kind)]))
        return hits.select("doc_id", "h.*").join(names, "item").select("doc_id", "item_id", *_COLUMNS).distinct()
    name = F.get(F.array(*[F.lit(i).cast(kind) for i in ids]).cast(T.ArrayType(kind)), F.col("h.item"))
    return hits.select("doc_id", name.alias("item_id"), *[f"h.{c}" for c in _COLUMNS]).distinct()


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """``docs`` without the rows that overlap with any item; all columns stay as they are."""
    if _is_local(benchmark, item_text, local_bytes):
        _, index = _broadcast(benchmark, item_id, item_text)
        return docs.where(F.coalesce(F.size(_local(index)(F.col(text))), F.lit(0)) <= 0)
    gone = cut(_joined(docs, benchmark, doc_id, text, item_id, item_text).select(F.col("doc_id").alias("__gone"), F.col("text_hash").alias("__gone_text")).distinct())
    return docs.join(gone, F.col(doc_id).eqNullSafe(gone["__gone"]) & (text_hash(F.col(text)) == gone["__gone_text"]), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The same overlaps by brute force over all diagonals with equal words.
SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}]+') AS a FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}]+') AS b FROM benchmark),
n AS (SELECT item_id, b, len(b) AS n, least({WINDOW}, len(b)) AS w FROM i WHERE len(b) >= {LEAST_WORDS}),
dt AS (SELECT doc_id, unnest(a) AS word, unnest(range(len(a))) AS p FROM d),
it AS (SELECT item_id, n, w, unnest(b) AS word, unnest(range(n)) AS q FROM n),
c AS (SELECT doc_id, item_id, n, w, p - q AS diagonal, list(q) AS qs FROM dt JOIN it USING (word) GROUP BY ALL HAVING count(*) >= {LEAST_WORDS}),
s AS (SELECT *, unnest(range(n - w + 1)) AS at_item FROM c),
v AS (SELECT doc_id, item_id, n, w, at_item + diagonal AS at_doc, at_item, len(list_filter(qs, lambda q: q >= at_item AND q < at_item + w)) AS matched FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, at_item, at_doc) AS k FROM v
      WHERE matched >= CASE WHEN n >= {WINDOW} THEN {WINDOW - SUBSTITUTED} ELSE n END)
SELECT doc_id, item_id, at_doc::INTEGER AS doc_pos, at_item::INTEGER AS item_pos, matched::INTEGER AS matched, w::INTEGER AS compared FROM r WHERE k = 1
"""
