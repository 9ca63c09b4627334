"""Approximate nearest neighbours by multiprobe p-stable hashing.

A hash is ``floor((a . x + b) / width)`` with Gaussian ``a``; ``K`` of them name a bucket of a table, and there
are ``TABLES`` tables that hold every vector.  The search has two passes.  First each query meets its own bucket of
every table; the distance of its last candidate bounds that of its true last neighbour.  Then, for a neighbour at that
distance, the chance of lying in each perturbed bucket follows from where the query lies between the borders
of its own; buckets are visited in the order of that chance until those of all tables together hold the
neighbour with probability ``SURE``.  A query among close neighbours thus visits few buckets and a lonely one
many.  Candidates of all buckets are merged and ranked by exact distance.  A query whose first pass finds too
few candidates, or whose chances don't add up, is compared exactly, with all vectors in blocks.

Exact copies are one vector with a list of ids from the start, so no bucket grows by them.  ``K`` grows with the
logarithm of the number of vectors, so that buckets don't grow with it; a bucket of more than a tile's vectors is
compared tile by tile in separate tasks, and a task holds one tile and a block of queries.

Results for odd inputs: rows with a null id, with a null or empty vector, one that holds nulls or values that
aren't finite, or one whose length isn't the most common (of equally common ones the largest) are neither queries nor
neighbours; of rows that repeat an id the one with the smallest vector counts, and it is a query if any of them is; equal
distances are ordered by id; with fewer than k other vectors all are returned; ids of any type that has an order stay as
they are; an empty table gives an empty result; only the named columns, and those that ``queries`` names, are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.session import cut, has_integers, numbered, table

NEIGHBOURS = 10
TABLES = 6
#: Width of a slot, in units of the root mean square of the projections.
WIDTH = 2.5
#: Chance that a neighbour at the bounding distance lies in a visited bucket.
SURE = 0.95
#: Perturbations are looked for among so many per table; a query that needs more is compared exactly.
PERTURBED = 4096
#: Values in the vectors of a tile, and queries that are compared with it at once.
TILE_VALUES, QUERIES = 1 << 21, 1024
_SLOTS = np.arange(-2, 3)


class Tables:
    """The hash functions: projections, offsets, and the names of buckets."""

    def __init__(self, dim: int, k: int, width: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.k, self.width = k, width
        self.a = rng.standard_normal((dim, TABLES * k))
        self.b = rng.uniform(0, width, TABLES * k)
        self.names = rng.integers(1, 1 << 62, (TABLES, k)) | 1
        self.of_table = rng.integers(1, 1 << 62, TABLES)

    def places(self, x: np.ndarray) -> np.ndarray:
        """``[row, table, hash]``: projections in units of slots."""
        return ((x @ self.a + self.b) / self.width).reshape(len(x), TABLES, self.k)

    def bucket(self, slots: np.ndarray, t: int) -> np.ndarray:
        """64-bit names of buckets, given integers ``[..., hash]``."""
        with np.errstate(over="ignore"):
            h = (slots * self.names[t]).sum(-1) + self.of_table[t]
            h ^= h >> 29
            h *= np.int64(-0x40A7B892E31B1A47)
            return h ^ (h >> 32)

    def home(self, x: np.ndarray) -> np.ndarray:
        slots = np.floor(self.places(x)).astype(np.int64)
        return np.column_stack([self.bucket(slots[:, t], t) for t in range(TABLES)])


_GRID = np.linspace(-6, 6, 4801)
_NORMAL = np.array([0.5 * (1 + math.erf(z / math.sqrt(2))) for z in _GRID])


def perturbations(f: np.ndarray, scale: np.ndarray, sure: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Perturbations to visit, of queries at ``f`` (0 to 1) between the borders of their slots in each hash.

    ``scale`` is the bounding distance in slots.  Returns the query and the perturbation of each visit, the
    likeliest first, and which queries' chances reach ``sure``.
    """
    n, k = f.shape
    edges = np.concatenate([_SLOTS, [_SLOTS[-1] + 1]])
    below = np.interp((edges[None, None] - f[..., None]) / np.maximum(scale, 1e-9)[:, None, None], _GRID, _NORMAL)
    chance = np.diff(below, axis=-1)
    total, code = np.ones((n, 1)), np.zeros((n, 1), np.int64)
    for j in range(k):  # the likeliest of all products: those of the likeliest prefixes
        total = (total[:, :, None] * chance[:, j, None]).reshape(n, -1)
        code = (code[:, :, None] * 5 + np.arange(5)).reshape(n, -1)
        if total.shape[1] > PERTURBED:
            top = np.argpartition(-total, PERTURBED - 1, axis=1)[:, :PERTURBED]
            total, code = np.take_along_axis(total, top, 1), np.take_along_axis(code, top, 1)
    order = np.argsort(-total, axis=1, kind="stable")
    total, code = np.take_along_axis(total, order, 1), np.take_along_axis(code, order, 1)
    summed = np.cumsum(total, axis=1)
    wanted = summed - total < sure
    enough = summed[:, -1] >= sure
    wanted &= enough[:, None]
    query, place = np.nonzero(wanted)
    digits = code[query, place][:, None] // 5 ** np.arange(k - 1, -1, -1) % 5
    return query, _SLOTS[digits], enough


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1).astype(np.float64) if len(lists) else np.zeros((0, 1))


#: Pairs whose differences are taken at once.
_PAIRS = 1 << 16


def _distances(p: np.ndarray, y: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Norms of the differences of rows ``r`` and ``c``; copies have equal ones to the last bit."""
    parts = [np.sqrt(((p[r[lo : lo + _PAIRS]] - y[c[lo : lo + _PAIRS]]) ** 2).sum(1)) for lo in range(0, len(r), _PAIRS)]
    return np.concatenate([np.zeros(0), *parts])


def nearest(q: np.ndarray, q_id: np.ndarray | None, bound: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Up to k of ``x`` for each query, not those with its id and not beyond its bound: query, id, distance.

    The products of a block only say which pairs can be among the nearest; all of those, ties too, are ranked by
    their exact distance and id.
    """
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    xx = (x * x).sum(1)
    for lo in range(0, len(q), 256):
        part, limit = q[lo : lo + 256], bound[lo : lo + 256] * (1 + 1e-9) + 1e-9
        pp = (part * part).sum(1)
        best_r, best_i, best_d = out[0]
        for at in range(0, len(x), 8192):
            y, y_id, yy = x[at : at + 8192], x_id[at : at + 8192], xx[at : at + 8192]
            d = pp[:, None] + yy[None] - 2 * part @ y.T
            if q_id is not None:
                d[q_id[lo : lo + 256, None] == y_id[None]] = np.inf
            most = limit * limit
            if d.shape[1] > k:
                most = np.minimum(most, np.partition(d, k - 1, axis=1)[:, k - 1])
            rounding = 8 * (x.shape[1] + 4) * np.finfo(float).eps * (pp + yy.max())
            r, c = np.nonzero((d <= (most + rounding)[:, None]) & (d < np.inf))
            best_r, best_i, best_d = np.concatenate([best_r, r]), np.concatenate([best_i, y_id[c]]), np.concatenate([best_d, _distances(part, y, r, c)])
            order = np.lexsort((best_i, best_d, best_r))
            best_r, best_i, best_d = best_r[order], best_i[order], best_d[order]
            few = np.arange(len(best_r)) - np.searchsorted(best_r, best_r) < k
            best_r, best_i, best_d = best_r[few], best_i[few], best_d[few]
            full = np.flatnonzero(np.bincount(best_r, minlength=len(part)) == k)  # nothing beyond their k-th from here on
            limit[full] = np.minimum(limit[full], best_d[np.searchsorted(best_r, full, "right") - 1])
        near = best_d <= bound[lo + best_r] * (1 + 1e-9) + 1e-9
        out.append((best_r[near] + lo, best_i[near], best_d[near]))
    return tuple(np.concatenate(z) for z in zip(*out))


_FOUND = "rep long, found array<struct<distance: double, id: long>>"


def _searched(k: int):
    """For ``mapInArrow`` over rows ``key, tile, rep, v, bound`` sorted by key, tile and bound.

    Rows with a null bound are what is searched and come first, queries follow; of each kind of rows that share key
    and tile no more are held than a tile has, or ``QUERIES``.
    """

    def search(x: np.ndarray, x_id: np.ndarray, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        ids, q = t["rep"].to_numpy(), _matrix(t["v"].combine_chunks())
        r, i, d = nearest(q, None, t["bound"].to_numpy(), x, x_id, k)
        size = np.bincount(r, minlength=len(q))
        some = size > 0
        structs = pa.StructArray.from_arrays([pa.array(d), pa.array(i)], names=["distance", "id"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size[some])]).astype(np.int32)), structs)
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), lists], names=["rep", "found"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = None
        held: list[pa.RecordBatch] = []
        waiting: list[pa.RecordBatch] = []
        searched: tuple[np.ndarray, np.ndarray] | None = None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal searched
            if waiting and held:
                if searched is None:
                    t = pa.Table.from_batches(held).combine_chunks()
                    searched = _matrix(t["v"].combine_chunks()), t["rep"].to_numpy()
                yield search(*searched, waiting)
            waiting.clear()

        for batch in batches:
            keys, tiles = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            query = batch.column(4).is_valid().to_numpy(zero_copy_only=False)
            turns = (np.flatnonzero((np.diff(keys) != 0) | (np.diff(tiles) != 0) | (np.diff(query.astype(np.int8)) != 0)) + 1).tolist() if len(keys) else []
            for lo, hi in zip([0, *turns], [*turns, len(keys)]):
                if lo == hi:
                    continue
                if group != (keys[lo], tiles[lo]):
                    yield from flush()
                    group, searched = (keys[lo], tiles[lo]), None
                    held.clear()
                if not query[lo]:
                    held.append(batch.slice(lo, hi - lo))
                    continue
                for at in range(lo, hi, QUERIES):
                    waiting.append(batch.slice(at, min(QUERIES, hi - at)))
                    if sum(w.num_rows for w in waiting) >= QUERIES:
                        yield from flush()
        yield from flush()

    return run


def _tiles(index: DataFrame, probes: DataFrame, tile: int, hot: DataFrame | None) -> DataFrame:
    """``key, tile, rep, v, bound`` of both; of a hot key (``key, tiles``) each tile meets each block of queries."""
    columns = "rep", "v", "bound"
    both = index.select("key", F.lit(0).cast("long").alias("tile"), *columns).union(probes.select("key", F.lit(0).cast("long").alias("tile"), *columns))
    if hot is None:
        return both
    asked = probes.join(hot, "key", "left_semi").groupBy("key").agg(F.ceil(F.count("*") / tile).cast("long").alias("blocks"))
    grid = cut(hot.join(asked, "key"))

    def spread(rows: DataFrame, own: str, every: str, number: Column) -> DataFrame:
        met = rows.join(grid, "key", "left")
        few = met.where("tiles is null").select("key", F.lit(0).cast("long").alias("tile"), *columns)
        many = met.where("tiles is not null").withColumn("own", F.pmod(F.xxhash64("rep"), F.col(own))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(every) - 1)))
        return few.union(many.select("key", number.alias("tile"), *columns))

    return spread(index, "tiles", "blocks", F.col("own") * F.col("blocks") + F.col("other")).union(spread(probes, "blocks", "tiles", F.col("other") * F.col("blocks") + F.col("own")))


def _blocks(rows: DataFrame, k: int) -> DataFrame:
    return rows.select("key", "tile", "rep", "v", "bound").repartition("key", "tile").sortWithinPartitions("key", "tile", "bound").mapInArrow(_searched(k), _FOUND)


def _vectors(df: DataFrame, vec_id: str, embedding: str, queries: Column | None) -> DataFrame:
    """``vec_id, v, asked`` of each id with a usable vector."""
    kind = df.schema[embedding].dataType.elementType
    v = F.col(embedding).cast("array<float>" if isinstance(kind, T.FloatType) else "array<double>")
    asked = F.coalesce(queries, F.lit(False)) if queries is not None else F.lit(True)
    rows = df.select(F.col(vec_id).alias("vec_id"), v.alias("v"), asked.alias("asked")).where(F.col("vec_id").isNotNull() & (F.size("v") > 0))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(fine).groupBy("vec_id").agg(F.min("v").alias("v"), F.bool_or("asked").alias("asked"))


def _without_copies(rows: DataFrame, most: int) -> DataFrame:
    """``rep, ids, v, asked, h1, h2``: a row per different vector, with its ``most`` smallest ids."""
    named = rows.select("*", *[F.xxhash64(F.lit(seed), "v").alias(f"h{seed}") for seed in (1, 2)])
    # the limit holds within each partition before anything moves, so many copies of one vector don't meet in a task
    nth = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    ids = named.withColumn("nth", nth).where(F.col("nth") <= most).groupBy("h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.any_value("v").alias("v"))
    asked = named.groupBy("h1", "h2").agg(F.bool_or("asked").alias("asked"))
    return ids.join(asked, ["h1", "h2"]).select(F.get("ids", F.lit(0)).alias("rep"), "ids", "v", "asked", "h1", "h2")


def neighbours(df: DataFrame, k: int = NEIGHBOURS, vec_id: str = "vec_id", embedding: str = "embedding", hashes: int | None = None, queries: Column | None = None, tile: int | None = None) -> DataFrame:
    """``vec_id, rank, neighbour_id, distance``: up to k nearest others of every vector, or of those where ``queries`` holds."""
    spark = df.sparkSession
    if not has_integers(df, vec_id):
        return _renamed(df, k, vec_id, embedding, hashes, queries, tile)
    rows = cut(_vectors(df, vec_id, embedding, queries).withColumn("vec_id", F.col("vec_id").cast("long")))
    lengths = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.sum(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)).alias("squares")).orderBy(F.desc("n"), F.desc("dim")).head()
    if lengths is None:
        return spark.createDataFrame([], "vec_id long, rank int, neighbour_id long, distance double")
    dim, n, squares = lengths
    rows = rows.where(F.size("v") == dim)
    if hashes is None:
        hashes = max(3, math.ceil(math.log(max(n, 2) / 3000) / math.log(2.2)))
    tile = tile or max(1024, TILE_VALUES // dim)
    scale = math.sqrt(squares / n) or 1.0
    tables = Tables(dim, hashes, WIDTH * scale)

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def home(part: pa.Array) -> pa.Array:
        return pa.array(list(tables.home(_matrix(part))), pa.list_(pa.int64())) if len(part) else pa.array([], pa.list_(pa.int64()))

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def visits(v: pa.Array, bound: pa.Array) -> pa.Array:
        out: list[list[int] | None] = []
        for lo in range(0, len(v), 512):
            x, r = _matrix(v.slice(lo, 512)), bound.slice(lo, 512).to_numpy(zero_copy_only=False)
            places = tables.places(x)
            slots = np.floor(places).astype(np.int64)
            lists: list[list[int]] = [[] for _ in x]
            fine = np.isfinite(r)
            for t in range(TABLES):
                q, moved, enough = perturbations((places - slots)[:, t], np.where(np.isfinite(r), r, 1) / tables.width, 1 - (1 - SURE) ** (1 / TABLES))
                fine &= enough
                away = moved.any(1)
                for i, b in zip(q[away].tolist(), tables.bucket(slots[q[away], t] + moved[away], t).tolist()):
                    lists[i].append(b)
            out += [one if ok else None for one, ok in zip(lists, fine)]
        return pa.array(out, pa.list_(pa.int64()))

    most = k + 1  # a query is among its own candidates
    vectors = cut(_without_copies(rows, most).withColumn("home", home("v")))
    none = F.lit(None).cast("double").alias("bound")
    index = vectors.select(F.explode("home").alias("key"), "rep", "v", none)
    counts = vectors.select(F.explode("home").alias("key")).groupBy("key").count()
    hot = cut(counts.where(F.col("count") > tile).select("key", F.ceil(F.col("count") / tile).cast("long").alias("tiles")))
    hot = None if hot.isEmpty() else hot
    asked = vectors.where("asked").select("rep", "v", "home")
    own = asked.select(F.explode("home").alias("key"), "rep", "v", F.lit(float("inf")).alias("bound"))
    first = cut(_blocks(_tiles(index, own, tile, hot), most))

    def merged(found: DataFrame) -> DataFrame:
        every = F.array_sort(F.array_distinct(F.flatten(F.collect_list("found"))))
        one_each = found.groupBy("rep").agg(every.alias("found"))
        return one_each.select("rep", F.slice(_unique("found"), 1, most).alias("found"))

    best = cut(merged(first))
    far = F.coalesce(F.when(F.size("found") >= most, F.element_at("found", most)["distance"]), F.lit(float("inf")))
    open_ = asked.join(best, "rep", "left").select("rep", "v", far.alias("bound"))
    open_ = cut(open_.withColumn("keys", visits("v", "bound")))
    probes = open_.where("keys is not null").select(F.explode("keys").alias("key"), "rep", "v", "bound")
    found = best.union(_blocks(_tiles(index, probes, tile, hot), most))
    exact = open_.where("keys is null").select("rep", "v", "bound")
    if not exact.isEmpty():
        blocks = -(-n // tile)
        whole = vectors.select(F.pmod(F.xxhash64("rep"), F.lit(blocks)).alias("key"), "rep", "v", none)
        spread = exact.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("key"), "rep", "v", "bound")
        found = found.union(_blocks(_tiles(whole, spread, tile, None), most))
    # copies again: each vector found stands for its ids, and a query isn't its own neighbour
    copies = vectors.where(F.size("ids") > 1).select(F.col("rep").alias("id"), "ids")
    each = merged(found).select("rep", F.explode("found").alias("f")).select("rep", "f.id", "f.distance").join(copies, "id", "left")
    pairs = F.transform(F.coalesce("ids", F.array("id")), lambda i: F.struct(F.col("distance"), i.alias("id")))
    lists = each.groupBy("rep").agg(F.slice(F.array_sort(F.flatten(F.collect_list(pairs))), 1, most).alias("found"))
    names = [F.xxhash64(F.lit(seed), "v").alias(f"h{seed}") for seed in (1, 2)]
    wanted = rows.where("asked").select("vec_id", *names).join(vectors.where("asked").select("h1", "h2", "rep"), ["h1", "h2"]).join(lists, "rep")
    others = F.slice(F.filter("found", lambda f: f["id"] != F.col("vec_id")), 1, k)
    final = wanted.select("vec_id", F.posexplode(others).alias("rank", "f"))
    return final.select("vec_id", (F.col("rank") + 1).alias("rank"), F.col("f.id").alias("neighbour_id"), F.col("f.distance").alias("distance"))


def _renamed(df: DataFrame, k: int, vec_id: str, embedding: str, hashes: int | None, queries: Column | None, tile: int | None) -> DataFrame:
    """``neighbours`` of a table whose ids aren't integers: numbers in their order stand for them meanwhile."""
    asked = F.coalesce(queries, F.lit(False)) if queries is not None else F.lit(True)
    rows = df.select(F.col(vec_id).alias("id"), F.col(embedding).alias("v"), asked.alias("asked")).where("id is not null")
    names = numbered(rows.select("id"), "nr")
    found = neighbours(rows.join(names, "id"), k, "nr", "v", hashes, F.col("asked"), tile)
    out = found.join(names.select(F.col("nr").alias("vec_id"), F.col("id").alias("of")), "vec_id").join(names.select(F.col("nr").alias("neighbour_id"), F.col("id").alias("near")), "neighbour_id")
    return out.select(F.col("of").alias("vec_id"), "rank", F.col("near").alias("neighbour_id"), "distance")


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("distance", T.DoubleType()), T.StructField("id", T.LongType())])))
def _unique(found: pa.Array) -> pa.Array:
    """Each list without later entries of an id that it has already; lists are sorted."""
    structs = found.flatten()
    ids, d = structs.field("id").to_numpy(), structs.field("distance").to_numpy()
    row = np.repeat(np.arange(len(found)), found.value_lengths().to_numpy(zero_copy_only=False))
    order = np.lexsort((np.arange(len(ids)), ids, row))
    new = np.ones(len(ids), bool)
    new[order[1:]] = (ids[order[1:]] != ids[order[:-1]]) | (row[order[1:]] != row[order[:-1]])
    kept = pa.StructArray.from_arrays([pa.array(d[new]), pa.array(ids[new])], names=["distance", "id"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(found)))]).astype(np.int32)), kept)


#: Queries are the vectors whose id this divides.
EVERY = 50


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours among all vectors of each one whose id is divisible by ``EVERY``."""
    return neighbours(table(spark, sf_dir, "embeddings"), queries=F.pmod("vec_id", F.lit(EVERY)) == 0)
