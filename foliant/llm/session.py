"""Session helpers: tables of a folder, the shared folder that cuts lineage, names and ids of rows."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only in local mode with none set."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named is None and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir isn't set: on a cluster it must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="foliant-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named or sc.getCheckpointDir()


#: Checkpoints that ``cut`` has made, in order.
_CUTS: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and safe from lost executors."""
    shared_dir(df.sparkSession)
    small_batches()
    out = df.checkpoint(eager=True)
    made = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if made.isDefined():
        _CUTS.append(made.get())
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is cut within is removed at the end; results that read it must be written by then."""
    before = len(_CUTS)
    try:
        yield
    finally:
        for path in _CUTS[before:]:
            remove(spark, path)
        del _CUTS[before:]


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of any file system that Spark knows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Most bytes of an Arrow batch to a Python worker; Spark's own bound of 64 MB, held in both processes and for every
#: task of an executor, is too much beside a full heap.
BATCH_BYTES = 4 << 20


def small_batches() -> None:
    """Lowers the session's bound of Arrow batches to ``BATCH_BYTES``, unless it is lower."""
    spark = SparkSession.active()
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    bound = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)))
    if bound > BATCH_BYTES or bound <= 0:
        spark.conf.set(name, str(BATCH_BYTES))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or a variant of it that no column of ``df`` has (column names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def kept(df: DataFrame, keep: tuple[str, ...], made: tuple[str, ...]) -> list[Column]:
    """The columns ``keep``; one named like a column that the operator makes (``made``) gets underscores behind its name."""
    taken = {m.lower() for m in made}
    out = []
    for c in keep:
        name = c
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(F.col(f"`{c}`").alias(name))
    return out


def has_integers(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.IntegralType)


def numbered(keys: DataFrame, number: str) -> DataFrame:
    """Distinct rows of ``keys`` with an integer that grows with them: by range partitions, not in one place."""
    return cut(cut(keys.distinct()).orderBy(*keys.columns).withColumn(number, F.monotonically_increasing_id()))
