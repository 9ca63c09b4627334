"""Line deduplication that returns keep bitmaps instead of text.

The lines of all documents become 128-bit hashes.  They are range-partitioned by hash and sorted
within each partition by hash, document and position; one pass over this order finds the first
occurrence of each line, every other one is dropped.  A line that has an earlier occurrence in the
same batch of input is already dropped there, so a line with any number of copies reaches its partition
at most once a batch.  Per document the kept and dropped lines come back as a run-length-compressed
bitmap.

``keep_rle`` holds the lengths of alternating runs, the first one of kept lines: ``"3,1,2"`` keeps
three lines, drops one, keeps two; ``"0,2"`` drops both lines.

Results for odd inputs: lines are compared without blanks at their ends; a blank line is always kept;
a null text has 0 lines and an empty bitmap, an empty text one blank line; documents are ordered by
``doc_id``, of any type that has an order, nulls first, then by a hash of their text; rows that repeat both count as one
document; a very long text is split whole, its lines are one row of hashes; an empty table gives an empty result; only
the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.session import cut, free_name, has_integers, table

_LINES = "text_hash long, n_lines int, n_blank int, dropped array<int>, pos array<int>, h1 array<long>, h2 array<long>"


def _order(ids: pa.Array) -> np.ndarray:
    """Numbers in the order of ids of any type; what stands for a null doesn't count."""
    if pa.types.is_integer(ids.type):
        return ids.fill_null(0).to_numpy(zero_copy_only=False)
    coded = ids.dictionary_encode()
    place = np.zeros(max(1, len(coded.dictionary)), np.int64)
    place[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(coded.dictionary))
    return place[coded.indices.fill_null(0).to_numpy(zero_copy_only=False)]


def _first_in_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Moves the lines with an earlier occurrence in the batch to ``dropped``."""
    ids, text_hash = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
    has_id = ids.is_valid().to_numpy(zero_copy_only=False)
    ids = _order(ids)
    h1s, h2s = batch.column(2), batch.column(3)
    n = h1s.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    h1, h2 = h1s.flatten(), h2s.flatten()
    solid = h1.is_valid().to_numpy(zero_copy_only=False)
    h1, h2 = (x.fill_null(0).to_numpy(zero_copy_only=False) for x in (h1, h2))
    row = np.repeat(np.arange(len(n)), n)
    pos = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
    at = np.flatnonzero(solid)
    # rows in the order of documents; copies of one row share a rank
    by = np.lexsort((text_hash, ids, has_id))
    new = np.ones(len(by), bool)
    new[1:] = (np.diff(has_id[by]) != 0) | (np.diff(ids[by]) != 0) | (np.diff(text_hash[by]) != 0)
    rank = np.empty(len(by), np.int64)
    rank[by] = np.cumsum(new)
    order = at[np.lexsort((pos[at], rank[row[at]], h2[at], h1[at]))]
    a, b = order[:-1], order[1:]
    same_line = (h1[a] == h1[b]) & (h2[a] == h2[b])
    same_place = same_line & (rank[row[a]] == rank[row[b]]) & (pos[a] == pos[b])
    later = np.zeros(len(order), bool)
    later[1:] = same_line & ~same_place
    # a copy of the row that holds the first occurrence is first as well
    head = np.ones(len(order), bool)
    head[1:] = ~same_place
    later = later[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))] if len(order) else later
    gone = np.zeros(len(row), bool)
    gone[order[later]] = True
    rest = solid & ~gone

    def lists(keep: np.ndarray, values: np.ndarray) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=len(n)))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values[keep]))

    blank = (n - np.bincount(row[solid], minlength=len(n))).astype(np.int32)
    columns = [batch.column(0), batch.column(1), pa.array(n.astype(np.int32)), pa.array(blank), lists(gone, pos), lists(rest, pos), lists(rest, h1), lists(rest, h2)]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n_lines", "n_blank", "dropped", "pos", "h1", "h2"])


_BITMAP = T.StructType([T.StructField("n_kept", T.IntegerType()), T.StructField("keep_rle", T.StringType()), T.StructField("keep", T.ArrayType(T.BooleanType()))])


@F.arrow_udf(_BITMAP)
def _bitmap(n_lines: pa.Array, dropped: pa.Array) -> pa.Array:
    kept, coded, flags = [], [], []
    for n, gone in zip(n_lines.to_pylist(), dropped.to_pylist()):
        keep = np.ones(n, bool)
        keep[gone] = False
        turns = np.flatnonzero(np.diff(keep)) + 1
        runs = np.diff(np.concatenate([[0], turns, [n]])).tolist() if n else []
        coded.append(",".join(map(str, runs if not n or keep[0] else [0, *runs])))
        kept.append(int(keep.sum()))
        flags.append(keep.tolist())
    fields = [pa.field("n_kept", pa.int32()), pa.field("keep_rle", pa.string()), pa.field("keep", pa.list_(pa.bool_()))]
    return pa.StructArray.from_arrays([pa.array(kept, pa.int32()), pa.array(coded, pa.string()), pa.array(flags, pa.list_(pa.bool_()))], fields=fields)


def text_hash(text):
    return F.coalesce(F.xxhash64(text), F.lit(0).cast("long"))


def _id(df: DataFrame, doc_id: str) -> Column:
    """Integers of any width as long; other ids as they are."""
    return F.col(doc_id).cast("long") if has_integers(df, doc_id) else F.col(doc_id)


def _hashes(lines, seed: int):
    return F.transform(lines, lambda x: F.when(x.isNotNull(), F.xxhash64(F.lit(seed), x)))


def decisions(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_hash, copies, n_lines, n_blank, n_kept, keep_rle, keep``, a row per distinct document."""
    line = F.transform(F.split(F.col(text), "\n", -1), lambda x: F.btrim(x, F.lit(" \t\r")))
    some = F.transform(line, lambda x: F.when(x != "", x))
    hashed = df.select(_id(df, doc_id).alias("doc_id"), text_hash(F.col(text)).alias("text_hash"), some.alias("lines"))
    hashed = hashed.select("doc_id", "text_hash", *[_hashes(F.col("lines"), seed).alias(f"h{seed}") for seed in (1, 2)])
    made = T.StructType([hashed.schema["doc_id"], *T.StructType.fromDDL(_LINES)])
    lines = cut(hashed.mapInArrow(lambda batches: map(_first_in_batch, batches), made))

    each = lines.select("doc_id", "text_hash", F.explode(F.arrays_zip("pos", "h1", "h2")).alias("l")).select("doc_id", "text_hash", "l.*")
    in_order = Window.partitionBy("h1", "h2").orderBy("doc_id", "text_hash", "pos")
    later = each.repartitionByRange("h1", "h2").withColumn("nth", F.rank().over(in_order)).where("nth > 1")

    own = lines.select("doc_id", "text_hash", "n_lines", "n_blank", F.lit(1).alias("copies"), "dropped")
    other = later.select("doc_id", "text_hash", F.lit(None).cast("int").alias("n_lines"), F.lit(None).cast("int").alias("n_blank"), F.lit(0).alias("copies"), F.array("pos").alias("dropped"))
    per_doc = own.unionByName(other).groupBy("doc_id", "text_hash").agg(F.max("n_lines").alias("n_lines"), F.max("n_blank").alias("n_blank"), F.sum("copies").alias("copies"), F.flatten(F.collect_list("dropped")).alias("dropped"))
    return per_doc.withColumn("b", _bitmap("n_lines", "dropped")).select("doc_id", "text_hash", "copies", "n_lines", "n_blank", "b.n_kept", "b.keep_rle", "b.keep")


def keep_bitmaps(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_kept, keep_rle``: one row per distinct document."""
    return decisions(df, doc_id, text).select("doc_id", "n_lines", "n_kept", "keep_rle")


def deduplicated(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``df`` without the dropped lines.

    A document whose lines other than blank ones are all dropped goes, and so do further copies of a
    repeated row; everything else stays, other columns as they are, ``n_chars`` (where it exists) is the
    new length.
    """
    found = cut(decisions(df, doc_id, text).where("n_kept < n_lines or copies > 1"))
    key, here, keep, copies, left = (free_name(df, c) for c in ("__text_hash", "__doc_id", "__keep", "__copies", "__left"))
    found = found.select(F.col("doc_id").alias(here), F.col("text_hash").alias(key), F.col("keep").alias(keep), F.col("copies").alias(copies), ((F.col("n_kept") > F.col("n_blank")) | (F.col("n_kept") == F.col("n_lines"))).alias(left))
    same = _id(df, doc_id).eqNullSafe(F.col(here)) & (text_hash(F.col(text)) == F.col(key))
    out = df.join(found, same, "left")
    if not found.where(F.col(copies) > 1).isEmpty():
        many = df.join(found.where(F.col(copies) > 1), same).dropDuplicates([here, key])
        out = out.where(F.coalesce(F.col(copies), F.lit(1)) == 1).unionByName(many)
    out = out.where(F.coalesce(F.col(left), F.lit(True)))
    flags = F.col(keep)
    short = F.array_join(F.filter(F.split(F.col(text), "\n", -1), lambda x, i: F.get(flags, i)), "\n")
    new = F.when(flags.isNull() | F.col(text).isNull(), F.col(text)).otherwise(short)
    columns = []
    for c in df.columns:
        if c == text:
            columns.append(new.alias(c))
        elif c == n_chars:
            columns.append(F.when(flags.isNull(), F.col(c)).otherwise(F.length(new)).cast(df.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(f"`{c}`"))
    return out.select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_bitmaps(table(spark, sf_dir, "documents"))


#: Deduplicated lines in SQL, up to flags per line (``kept``) and per document; also used by the pipeline.
SQL_LINES = """
lined AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM {docs}),
each_line AS (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS line FROM lined),
marked AS (SELECT doc_id, pos, line, trim(line, chr(32) || chr(9) || chr(13)) AS bare FROM each_line),
kept AS (SELECT doc_id, pos, line, bare = '' AS blank,
         bare = '' OR row_number() OVER (PARTITION BY bare ORDER BY doc_id, pos) = 1 AS keep FROM marked)
"""
SQL = f"""
WITH {SQL_LINES.format(docs="documents")},
islands AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, keep ORDER BY pos) AS g FROM kept),
runs AS (SELECT doc_id, keep, min(pos) AS start_at, count(*) AS n FROM islands GROUP BY doc_id, keep, g)
SELECT doc_id, sum(n)::INTEGER AS n_lines, sum(CASE WHEN keep THEN n ELSE 0 END)::INTEGER AS n_kept,
       CASE WHEN bool_or(start_at = 0 AND NOT keep) THEN '0,' ELSE '' END || string_agg(n::VARCHAR, ',' ORDER BY start_at) AS keep_rle
FROM runs GROUP BY doc_id
"""
