"""A corpus pipeline: toxic documents go, then repeated lines, near-duplicates and benchmark passages; the rest is encoded.

``STAGES`` lists the stages.  Each takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and read back as the next one's ``docs``.  All but the last return the columns of ``documents``.

Once repeated lines are gone a near-copy is only what it didn't share, so near-duplicates are looked for in the texts
as they are and in the same documents' texts as ``documents`` has them; one document of each group stays.

Results for odd inputs: documents with a null id or text, an empty or a very long text pass every stage like others (a
null or empty text is never toxic, has no line that can go, is in no group, overlaps with nothing and has null or no
identifiers); documents of which line dedup leaves nothing but blank lines go; of rows that repeat id and text one stays,
an id with two texts is two documents; ties stay with the smaller id; an empty table gives an empty result at every
stage; further columns pass all stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import bpe, decontaminate, line_dedup, simhash, toxicity
from foliant.llm.session import remove, scratch, shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifiers reject go."""
    return toxicity.filtered(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each line, the first occurrence in the corpus stays; documents with nothing left go."""
    return line_dedup.deduplicated(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.deduplicated(docs, originals=table(spark, sf_dir, "documents"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers of each document's text."""
    return bpe.encode(docs, keep=("doc_id", "lang", "source"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("bpe", encode),
]

#: SQL can express neither the classifiers nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies ``STAGES`` to ``documents``; each result is a table in the shared folder.

    Tables and checkpoints of a stage are removed once the next one has read them; the last table stays, as the result.
    """
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
