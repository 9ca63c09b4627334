"""Diagnostics of hits: where a row comes from, and what it holds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_ext(ext: dict | None) -> bool:
    """Whether a search's ``ext`` asks for diagnostics: ``{"_bm": {"diagnostics": true}}``, true by default."""
    if not ext or "_bm" not in ext:
        return False
    own = ext["_bm"] or {}
    unknown = set(own) - {"diagnostics"}
    if unknown:
        raise ValueError(f"unknown keys in _bm: {sorted(unknown)}")
    return bool(own.get("diagnostics", True))


def with_diagnostics(hits: DataFrame, query: str, index: str = "", from_files: bool = True) -> DataFrame:
    """``hits`` with a struct ``_bm``: partition, file, row, index, query, and the row's values as text.

    ``docid`` numbers rows over all partitions, ``docid_rel`` is the row in its file; ``index_uuid`` is a fixed name for
    the index.  Rows that don't come from files (``from_files`` False) have neither file nor row in one.
    """
    values = F.map_from_arrays(F.array(*[F.lit(c) for c in hits.columns]), F.array(*[F.col(c).cast("string") for c in hits.columns]))
    segment = F.col("_metadata.file_name") if from_files else F.lit(None).cast("string")
    row = F.col("_metadata.row_index") if from_files else F.lit(None).cast("long")
    return hits.withColumn("_bm", F.struct(
        F.spark_partition_id().alias("shard"), segment.alias("segment"), F.monotonically_increasing_id().alias("docid"), row.alias("docid_rel"), F.lit(index).alias("index"),
        F.lit(str(uuid.uuid5(uuid.NAMESPACE_URL, index))).alias("index_uuid"), F.lit(query).alias("query"), values.alias("docvalues")))
