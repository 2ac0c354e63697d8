"""All pairs of a group are made by several tasks, each within its block."""

import random

from annolake.operators import nearest, similar
from annolake.plans import notes, texts
from pyspark.sql import functions as F


def test_pairs_equal_a_loop(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["a", "b", None])) for i in range(200)]
    got = {(x.a.i, x.b.i) for x in nearest.all_pairs(spark.createDataFrame(rows, "i long, k string"), ["k"], "i", block=7).collect()}
    assert got == {(i, j) for i, k in rows for j, m in rows if i < j and k is not None and k == m}


def test_one_large_group_is_not_one_task(spark, tmp_path):
    n = 9000
    spark.range(n).selectExpr("id AS vec_id", "array(float(id % 7) / 7, 0f, 0.5f, 0.5f) AS embedding", "1 AS label").write.parquet(str(tmp_path / "embeddings.parquet"))
    made = [x["count"] for x in notes.box_measures(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(made) == n * (n - 1) // 2 and max(made) < sum(made) / 2


def test_pairs_of_parts_are_not_shuffled(spark, tmp_path):
    names = ["green bolt", "green bolts", "old ring", None]
    spark.createDataFrame([(i, names[i % 4], "B", 1) for i in range(40)], "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    pairs = texts.fuzzy_pairs(spark, str(tmp_path))
    rows = pairs.collect()
    assert len(rows) == 780
    for x in rows:
        a, b = names[x.a_key % 4], names[x.b_key % 4]
        assert x.same == (None if a is None or b is None else a == b or {a, b} == {"green bolt", "green bolts"}), x
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 3  # two to deal each side, one to pair


def test_two_texts_are_compared_as_a_join_of_them_would(spark):
    rows = [("abcdef", "abcdef"), ("abcdef", "abcxyz"), ("abcdefghij", "abcdefgxyz"), ("", ""), ("", "a"), ("a", None)]
    got = [x.same for x in spark.createDataFrame(rows, "a string, b string").select(similar.same_line(F.col("a"), F.col("b")).alias("same")).collect()]
    assert got == [True, False, True, True, False, None]
