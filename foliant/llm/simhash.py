"""SimHash near-duplicates by bit-sliced comparison.

Fingerprint.  The distinct words of a document vote with the bits of their hashes for 256 bits.

Candidates.  For each of 8 hash orders, a document's smallest run of 3 words is a blocking key; so is its
whole fingerprint.  Only documents that share a key are compared.  Two documents of which a share ``j`` of
the runs agrees miss each other with probability ``(1 - j) ** 8``.

Comparison.  The fingerprints of a block lie as vertical bit planes: a word of 64 bits holds one bit of 64
documents.  A document is compared to 64 others at once: plane by plane the differing bits go through
carry-save adders into bitwise counters, and a word is abandoned once all its counters exceed the radius.
A key that more documents share than a tile holds is compared tile by tile in separate tasks, none is left
out.  What is within the radius becomes edges of a forest, and connected components are the groups.

Results for odd inputs: documents with no word, null or empty texts and rows with a null ``doc_id`` are in
no group and always stay; ids of any type that has an order stay as they are.  For ``near_duplicates`` rows that
repeat a ``doc_id`` are the same document, in one group; all members of a group are reported with its smallest
``doc_id``.  For ``deduplicated`` a document is an id with a text: one id with two texts is two documents, of rows
that repeat both one stays, that with the smallest JSON of its columns.  Equal ids of a group are ordered by a hash
of their text.  An empty table gives an empty result; only the two named columns are read, texts of any length whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.line_dedup import text_hash
from foliant.llm.session import cut, free_name, has_integers, numbered, table
from foliant.llm.text import mix, raw, slices, words

BITS = 256
#: Of the 256 bits, how many may differ between near-duplicates.
RADIUS = 48
#: Blocking keys per document besides its fingerprint, and words in the runs that they are taken from.
KEYS, RUN = 8, 3
#: Documents that share a key are compared in tiles of at most about so many.
TILE = 1 << 15
#: Up to so many edges, one task joins them into components; beyond, star contraction over all executors.
ONE_TASK_EDGES = 4_000_000

U64 = np.uint64
_SPREAD = np.array([int.from_bytes(bytes((b >> i) & 1 for i in range(8)), "little") for b in range(256)], U64)


def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


def fingerprints(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """256 bits, as 4 integers, of each text: the majority over its distinct words' hashes."""
    n = len(at) - 1
    out = np.zeros((n, BITS // 64), U64)
    if not len(hashes):
        return out
    row = np.repeat(np.arange(n), np.diff(at))
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[new], r[new]
    size = np.bincount(r, minlength=n)
    first = np.cumsum(size) - size
    # sums of single bytes hold up to 255 votes: segments of at most 255 words
    segs = -(-size // 255)
    seg_row = np.repeat(np.arange(n), segs)
    seg_no = np.arange(len(seg_row)) - np.repeat(np.cumsum(segs) - segs, segs)
    seg_at = first[seg_row] + 255 * seg_no
    some = segs > 0
    seg_first = (np.cumsum(segs) - segs)[some]
    for w, seed in enumerate(_seeds(BITS // 64)):
        octets = mix(h ^ seed).view(np.uint8).reshape(-1, 8)
        for k in range(8):
            votes = np.add.reduceat(_SPREAD[octets[:, k]], seg_at).view(np.uint8).reshape(-1, 8).astype(np.int32)
            total = np.add.reduceat(votes, seg_first, axis=0)
            bits = 2 * total > size[some][:, None]
            out[some, w] |= (bits.astype(U64) << np.arange(8 * k, 8 * k + 8, dtype=U64)).sum(1, dtype=U64)
    return out


def blocking_keys(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The smallest run of words of each text in each hash order; texts without a word get zeros.

    A text of fewer words than a run has is one run.
    """
    n = np.diff(at)
    out = np.zeros((len(n), KEYS), U64)
    if not len(hashes):
        return out
    run = hashes.copy()
    for k in range(1, RUN):
        shifted = np.zeros(len(hashes), U64)
        shifted[:-k] = hashes[k:]
        run = mix(run + U64(k)) ^ shifted
        # runs that would reach into the next text stay shorter
        over = np.arange(len(hashes)) + k >= np.repeat(at[1:], n)
        run[over] = mix(hashes[over] + U64(k))
    place = np.arange(len(hashes)) - np.repeat(at[:-1], n)
    whole = place <= np.repeat(np.maximum(n - RUN, 0), n)
    run, n_runs = run[whole], np.maximum(n - RUN + 1, n > 0)
    first, some = np.cumsum(n_runs) - n_runs, n_runs > 0
    for k, seed in enumerate(_seeds(KEYS)):
        out[some, k] = mix(np.minimum.reduceat(mix(run ^ seed), first[some]) ^ seed)
    return out


_LONGS = T.ArrayType(T.LongType())
_SKETCH = T.StructType([T.StructField("text_hash", T.LongType()), T.StructField("fp", _LONGS), T.StructField("keys", _LONGS), T.StructField("lines", _LONGS)])


def line_hashes(texts: pa.Array, rows: np.ndarray, most: int | None) -> pa.ListArray:
    """Hashes of the lines of those ``rows``, without blank ones; of each text the first ``most``, None takes all."""
    data, at = raw(texts)
    found, size = [], []
    for i in rows.tolist() if most != 0 else []:
        before = len(found)
        lines = data[at[i] : at[i + 1]].tobytes().split(b"\n")
        found += [blake2b(x, digest_size=8).digest() for x in islice((x for x in lines if x.strip(b" ")), most)]
        size.append(len(found) - before)
    ends = np.concatenate([[0], np.cumsum(size or np.zeros(len(rows), np.int64))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), np.int64)))


def _sketches(most: int | None):
    """For ``mapInArrow``: rows ``id, text_hash, fp, keys, lines`` of rows ``id, text_hash, text`` that have a word.

    The text ends here: an Arrow UDF would hold it twice more beside the result, which a heap can't when it is very long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            for lo, hi in slices(texts):
                part = texts.slice(lo, hi - lo)
                hashes, at = words(part)
                some = np.flatnonzero(np.diff(at))
                if not len(some):
                    continue
                fp = fingerprints(hashes, at)
                whole = mix(mix(mix(mix(fp[:, 0]) ^ fp[:, 1]) ^ fp[:, 2]) ^ fp[:, 3])
                keys = np.column_stack([blocking_keys(hashes, at), whole])
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x[some].view(np.int64).reshape(-1)), x.shape[1]).cast(pa.list_(pa.int64())) for x in (fp, keys)]
                own = [batch.column(i).slice(lo, hi - lo).take(pa.array(some)) for i in range(2)]
                yield pa.RecordBatch.from_arrays([*own, *lists, line_hashes(part, some, most)], names=["id", *_SKETCH.names])

    return run


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes: ``[bit, word]`` holds that bit of 64 fingerprints, the first in the lowest place."""
    n = len(fps)
    bits = np.zeros((BITS, -(-n // 64) * 64), np.uint8)
    bits[:, :n] = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(n, -1), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view(U64)


def _add(counter: list[np.ndarray], x: np.ndarray, place: int) -> None:
    """Adds bits of weight ``2 ** place`` to bitwise counters, in place; carries ripple upwards."""
    while place < len(counter):
        c = counter[place]
        counter[place], x = c ^ x, c & x
        place += 1
    counter.append(x)


def _save(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: sum and carry bits of three."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def _beyond(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Bits of the counters that exceed ``radius``."""
    more = np.zeros_like(counter[0])
    equal = ~more
    for place in range(len(counter) - 1, -1, -1):
        if radius >> place & 1:
            equal &= counter[place]
        else:
            more |= equal & counter[place]
            equal &= ~counter[place]
    return more if radius >> len(counter) == 0 else np.zeros_like(more)


def within(plane: np.ndarray, query: np.ndarray, word: np.ndarray, wanted: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Compares fingerprint ``query[t]`` with the 64 of ``word[t]`` for all t; ``wanted`` marks those that count.

    Returns the t that have any within the radius, and bits for which ones.
    """
    alive, wanted = np.arange(len(query)), wanted.copy()
    home, shift = query >> 6, (query & 63).astype(U64)
    counter: list[np.ndarray] = []
    for start in range(0, BITS, 8):
        x = []
        for b in range(start, start + 8):
            own = (plane[b, home] >> shift) & U64(1)
            x.append(plane[b, word] ^ (U64(0) - own))
        ones1, twos1 = _save(x[0], x[1], x[2])
        ones2, twos2 = _save(x[3], x[4], x[5])
        ones3, twos3 = _save(ones1, ones2, x[6])
        twos, fours = _save(twos1, twos2, twos3)
        carry = ones3 & x[7]
        _add(counter, ones3 ^ x[7], 0)
        _add(counter, carry, 1)
        _add(counter, twos, 1)
        _add(counter, fours, 2)
        if start + 8 > radius and (start // 8 % 2 or start + 8 == BITS):
            wanted &= ~_beyond(counter, radius)
            on = wanted != 0
            if not on.all():
                alive, wanted, home, shift, word = alive[on], wanted[on], home[on], shift[on], word[on]
                counter = [c[on] for c in counter]
                if not len(alive):
                    break
    return alive, wanted


def _components(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Smallest member of each place's component, from earlier labels and further edges."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


def forest(group: np.ndarray, fps: np.ndarray, side: np.ndarray | None = None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join each group's rows as all pairs within the radius do: ``(row, smallest row joined to it)``.

    Rows of a group are adjacent.  With ``side``, only rows of different sides are compared.
    """
    n = len(group)
    label = np.arange(n)
    begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, np.int64)
    ends = np.append(begins[1:], n)
    last = np.repeat(ends, ends - begins)
    plane = planes(fps)
    # row q is compared with the later rows of its group: the words from its own to the group's last
    rows = np.flatnonzero(last - np.arange(n) > 1)
    n_words = ((last[rows] - 1) >> 6) - (rows >> 6) + 1
    total = np.cumsum(n_words)
    lo = 0
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + 32768, "right")))
        q = np.repeat(rows[lo:hi], n_words[lo:hi])
        w = (q >> 6) + np.arange(len(q)) - np.repeat(np.cumsum(n_words[lo:hi]) - n_words[lo:hi], n_words[lo:hi])
        full = ~U64(0)
        from_ = np.clip(q + 1 - 64 * w, 0, 64)
        to = np.clip(last[q] - 64 * w, 0, 64)
        above = np.where(from_ < 64, full << np.minimum(from_, 63).astype(U64), U64(0))
        below = np.where(to < 64, (U64(1) << np.minimum(to, 63).astype(U64)) - U64(1), full)
        wanted = above & below
        # 64 rows that are joined to the query already add nothing
        own = np.concatenate([label, np.full(-n % 64, label[-1])]).reshape(-1, 64)
        least, most = own.min(1), own.max(1)
        joined = (least[w] == label[q]) & (most[w] == label[q])
        some = np.flatnonzero((wanted != 0) & ~joined)
        t, found = within(plane, q[some], w[some], wanted[some], radius)
        if len(t):
            hits = np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            which, lane = np.nonzero(hits)
            a, b = q[some][t][which], 64 * w[some][t][which] + lane
            if side is not None:
                across = side[a] != side[b]
                a, b = a[across], b[across]
            label = _components(n, a, b, label)
        lo = hi
    joined = np.flatnonzero(label != np.arange(n))
    return joined, label[joined]


def _blocks(radius: int):
    """For ``mapInArrow``: edges of sorted rows ``key, tile, side, doc_id, fp``; a block may lie across batches."""

    def edges(x: np.ndarray) -> pa.RecordBatch:
        group = np.cumsum(np.concatenate([[0], (x[1:, 0] != x[:-1, 0]) | (x[1:, 1] != x[:-1, 1])])) if len(x) else np.zeros(0, np.int64)
        shared = np.bincount(group, minlength=1)[group] > 1 if len(x) else np.zeros(0, bool)
        x, group = x[shared], group[shared]
        out = [np.zeros(0, np.int64)] * 2
        if len(x):
            tiled = x[:, 1] >= 0
            a, b = [], []
            for part, side in ((~tiled, None), (tiled, x[tiled, 2])):
                if part.any():
                    own = x[part]
                    # a tile compared with itself has one side
                    i, j = forest(group[part], own[:, 4:].view(U64), side, radius)
                    a.append(own[i, 3])
                    b.append(own[j, 3])
            out = [np.concatenate(a), np.concatenate(b)]
        differ = out[0] != out[1]
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(*out)[differ]), pa.array(np.minimum(*out)[differ])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []
        for batch in batches:
            fp = batch.column(4).flatten().to_numpy().reshape(-1, BITS // 64)
            x = np.column_stack([*(batch.column(i).to_numpy() for i in range(4)), fp])
            if not len(x):
                continue
            if rest and (rest[-1][-1, :2] == x[-1, :2]).all():
                rest.append(x)  # the same block still
                continue
            cut_at = int(np.flatnonzero((x[:, :2] != x[-1, :2]).any(1))[-1]) + 1 if (x[:, :2] != x[-1, :2]).any() else 0
            yield edges(np.concatenate([*rest, x[:cut_at]]))
            rest = [x[cut_at:]]
        if rest:
            yield edges(np.concatenate(rest))

    return run


def _tiled(rows: DataFrame, tile: int) -> DataFrame:
    """``key, tile, side, doc_id, fp`` of each row and key; rows of a key with many go to all pairs of their tile."""
    each = rows.select(F.explode("keys").alias("key"), "doc_id", "fp")
    hot = each.groupBy("key").count().where(F.col("count") > tile).select("key", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    plain = F.lit(-1).cast("long").alias("tile"), F.lit(0).cast("long").alias("side")
    if rows.isEmpty() or (hot := cut(hot)).isEmpty():
        return each.select("key", *plain, "doc_id", "fp")
    each = each.join(hot, "key", "left")
    few = each.where("tiles is null").select("key", *plain, "doc_id", "fp")
    own = F.pmod(F.xxhash64("doc_id"), F.col("tiles"))
    many = each.where("tiles is not null").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    # (i, j) with i < j holds both tiles and compares across; (i, i), at -2 - i, compares within
    across = many.where("own <> other").select("key", (F.least("own", "other") * F.col("tiles") + F.greatest("own", "other")).alias("tile"), F.col("own").cast("long").alias("side"), "doc_id", "fp")
    inside = many.where("own = other").select("key", (-2 - F.col("own")).alias("tile"), F.lit(0).cast("long").alias("side"), "doc_id", "fp")
    return few.unionByName(across).unionByName(inside)


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
    both = np.concatenate([*a, *b])
    ids, at = np.unique(both, return_inverse=True)
    label = _components(len(ids), at[: len(both) // 2], at[len(both) // 2 :], np.arange(len(ids)))
    lower = np.flatnonzero(label != np.arange(len(ids)))
    for lo in range(0, len(lower), 65536):
        part = lower[lo : lo + 65536]
        yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(ids[label[part]])], names=["doc_id", "duplicate_of"])


def components(edges: DataFrame, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """``doc_id, duplicate_of`` for all but the smallest member of each component of edges ``a, b``."""
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if edges.count() <= one_task:
        return edges.coalesce(1).mapInArrow(_union, "doc_id long, duplicate_of long")
    while True:  # a > b; stars are contracted until each member points to the smallest
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        new = cut(small)
        if new.exceptAll(edges).isEmpty() and edges.exceptAll(new).isEmpty():
            return new.select(F.col("a").alias("doc_id"), F.col("b").alias("duplicate_of"))
        edges = new


def _sketched(df: DataFrame, doc_id: str, text: str, lines: int | None = None) -> DataFrame:
    """``id, text_hash, fp, keys, lines`` of each row with an id and a word; hashes of its first ``lines`` lines other than blank ones."""
    rows = df.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), text_hash(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    return rows.mapInArrow(_sketches(lines), T.StructType([rows.schema["id"], *_SKETCH.fields]))


def _groups(sketches: DataFrame, radius: int, tile: int, one_task: int) -> DataFrame:
    """``doc_id, duplicate_of`` of sketches ``doc_id, fp, keys`` with integer ids."""
    # equal fingerprints with equal keys, all exact copies among them, are one row from here on
    alike = cut(sketches.groupBy("fp", "keys").agg(F.min("doc_id").alias("doc_id")))
    name = [F.xxhash64(F.lit(seed), "fp", "keys").alias(f"k{seed}") for seed in (1, 2)]
    copies = sketches.select(F.col("doc_id").alias("a"), *name).join(alike.select(F.col("doc_id").alias("b"), *name), ["k1", "k2"]).where("a <> b").select("a", "b")
    blocks = _tiled(alike.select("doc_id", "fp", "keys"), tile).repartition("key", "tile").sortWithinPartitions("key", "tile", "doc_id")
    return components(blocks.mapInArrow(_blocks(radius), "a long, b long").union(copies), one_task)


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, tile: int = TILE, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """``doc_id, duplicate_of``: every document of a group but the smallest ``doc_id``, and that one.

    The blocking keys reach a recall of 0.9 up to about ``RADIUS``.
    """
    sketches = cut(_sketched(df, doc_id, text, 0).drop("lines"))
    if has_integers(df, doc_id):
        return _groups(sketches.select(F.col("id").cast("long").alias("doc_id"), "fp", "keys"), radius, tile, one_task)
    names = numbered(sketches.select("id"), "nr")
    found = _groups(sketches.join(names, "id").select(F.col("nr").alias("doc_id"), "fp", "keys"), radius, tile, one_task)
    own, other = names.select(F.col("nr").alias("doc_id"), F.col("id").alias("own")), names.select(F.col("nr").alias("duplicate_of"), F.col("id").alias("other"))
    return found.join(own, "doc_id").join(other, "duplicate_of").select(F.col("own").alias("doc_id"), F.col("other").alias("duplicate_of"))


def deduplicated(df: DataFrame, doc_id: str = "doc_id", text: str = "text", originals: DataFrame | None = None, radius: int = RADIUS, tile: int = TILE, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """``df`` with one document of each group, the one of the smallest ``doc_id``; all columns stay as they are.

    ``originals`` has the same documents as they were before an earlier step took lines away.  Documents of ``df``
    whose originals are near-duplicates are in one group as well.  An original is one only if it has the document's
    first line, and an id that either table has more than once tells nothing about it.
    """
    here, hashed, node = (free_name(df, c) for c in ("__id", "__text_hash", "__node"))
    sketches = cut(_sketched(df, doc_id, text, 1).withColumn("lines", F.get("lines", F.lit(0))).withColumnRenamed("lines", "line"))
    repeated = not df.where(F.col(doc_id).isNotNull()).groupBy(doc_id).count().where("count > 1").isEmpty()
    if repeated or not has_integers(df, doc_id):
        names = numbered(sketches.select("id", "text_hash"), "doc_id")
        names = sketches = sketches.join(names, ["id", "text_hash"])
    else:
        sketches = sketches.withColumn("doc_id", F.col("id").cast("long"))
        names = sketches.select("id", "text_hash", "line", "doc_id")
    found = _groups(sketches.select("doc_id", "fp", "keys"), radius, tile, one_task)
    if originals is not None:
        before = _sketched(originals, doc_id, text).groupBy("id").agg(F.count("*").alias("n"), *[F.any_value(c).alias(c) for c in ("fp", "keys", "lines")]).where("n = 1")
        single = names.groupBy("id").agg(F.count("*").alias("m"), *[F.any_value(c).alias(c) for c in ("line", "doc_id")]).where("m = 1")
        known = cut(before.join(single, "id").where(F.array_contains("lines", F.col("line"))).select("doc_id", "fp", "keys"))
        earlier = _groups(known, radius, tile, one_task)
        found = components(found.union(earlier).select(F.col("doc_id").alias("a"), F.col("duplicate_of").alias("b")), one_task)
    gone = cut(names.join(found.select("doc_id"), "doc_id").select(F.col("id").alias(here), F.col("text_hash").alias(hashed)).distinct())
    if not repeated:
        return df.join(gone, F.col(doc_id) == gone[here], "left_anti")
    same = lambda other: (F.col(doc_id) == other[here]) & (text_hash(F.col(text)) == other[hashed])
    left = df.join(gone, same(gone), "left_anti")
    many = cut(df.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias(here), text_hash(F.col(text)).alias(hashed)).count().where("count > 1").drop("count"))
    first = F.row_number().over(Window.partitionBy(here, hashed).orderBy(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
    one = left.join(many, same(many)).withColumn(node, first).where(F.col(node) == 1).select(*[F.col(f"`{c}`") for c in df.columns])
    return left.join(many, same(many), "left_anti").unionByName(one)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
