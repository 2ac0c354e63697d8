"""Numbers are rounded as the SQL of the queries rounds them."""

from pyspark.sql import functions as F

from annolake.functions import text as T
from annolake.plans import joins, notes


def test_gigabytes_are_rounded_by_their_exact_value(spark):
    sizes = [1.25e9, 1.15e9, 1.75e9, 2.25e9, 0.99e9, 1234.25e9]
    got = spark.createDataFrame([(s,) for s in sizes], "n double").select(T.byte_size(F.col("n")).alias("t")).collect()
    assert [x.t for x in got] == ["1.2 GB", "1.1 GB", "1.8 GB", "2.2 GB", "990 MB", "1234.2 GB"]


def test_components_are_added_as_floats(spark, tmp_path):
    rows = [(1, [-1e-9, 0.1249999925494194, 0.5, 0.5], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert joins._boxes(spark, tmp_path).select("x", "y").first()[:] == (1000, 1125)
    assert notes._boxes(spark, tmp_path).select("x0", "y0").first()[:] == (4000.0, 4500.0)
