from pyspark.sql import functions as F

from foliant.functions import analysis
from foliant.operators.queries import MatchAll, Term, search
from foliant.sources.tables import model


def test_predicates_and_analysis_on_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a b"), (2, "c")], "id int, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, text string").parquet(str(tmp_path / "in"))
    found = search(model(stream, "id"), Term("id", 1)).select("id", analysis.shingles(analysis.tokens(F.col("text"))).alias("s"))
    q = found.writeStream.format("memory").queryName("found").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("found").collect()] == [(1, ["a", "a b", "b"])]
    assert MatchAll().predicate() is not None
