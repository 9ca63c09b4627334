"""Tables of a folder, and the document model built from them.

A document table has a row per root document and per nested part: ``_root`` names the root, ``_path`` the array
that a nested part comes from (null for roots), ``_live`` is false for deleted documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def indexes(tables: dict[str, DataFrame], names: str | None = None) -> DataFrame:
    """Several tables as one, with their name in ``_index``; ``names`` is a comma list, all if omitted."""
    wanted = [n.strip() for n in names.split(",")] if names else list(tables)
    parts = [tables[n].withColumn("_index", F.lit(n)) for n in wanted]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def model(df: DataFrame, root: str, live: Column | None = None) -> DataFrame:
    """Root documents of a table; without ``live`` all are."""
    return df.withColumn("_root", F.col(root)).withColumn("_path", F.lit(None).cast("string")).withColumn("_live", F.coalesce(live, F.lit(False)) if live is not None else F.lit(True))


def with_nested(docs: DataFrame, array: str) -> DataFrame:
    """Roots, and a row for each element of an array of structs; its fields are columns, null for roots.

    One pass over the table: each row is exploded into itself and its parts, nothing is joined or shuffled.
    """
    fields = docs.schema[array].dataType.elementType.fieldNames()
    clash = set(fields) & set(docs.columns)
    if clash:
        raise ValueError(f"fields of nested parts that are columns as well: {sorted(clash)}")
    every = F.concat(F.array(F.lit(None).cast(docs.schema[array].dataType.elementType)), F.coalesce(F.col(array), F.array().cast(docs.schema[array].dataType)))
    rows = docs.select("*", F.posexplode(every).alias("_nr", "_part")).where((F.col("_nr") == 0) | F.col("_part").isNotNull())
    rows = rows.withColumn("_path", F.when(F.col("_nr") > 0, F.lit(array)))
    return rows.select(*[c for c in rows.columns if c not in ("_part", array)], *[F.col(f"_part.{f}").alias(f) for f in fields])
