"""Blocks of a group: rows are copied a few times only, and names are compared once for all rows that have them."""

import random

import numpy as np
from annolake.operators import nearest
from annolake.plans import notes, texts
from pyspark.sql import functions as F


def test_pairs_of_growing_blocks_equal_a_loop(spark, monkeypatch):
    monkeypatch.setattr(nearest, "WIDEST", 9)
    r = random.Random(6)
    rows = [(r.randrange(150), r.choice(["a", "b", None]), r.choice(["x", "y", None])) for _ in range(240)] + [(None, "a", "x"), (7, "c", "x")]
    for block in (2, 50, 1000):
        d = spark.createDataFrame(rows, "i long, k string, t string")
        want = sorted((i, j) for i, k, _ in rows for j, m, _ in rows if None not in (i, j, k) and k == m and i < j)
        assert sorted((x.a.i, x.b.i) for x in nearest.all_pairs(d, ["k"], "i", block=block).collect()) == want
        same = sorted((i, j, str(None if None in (t, u) else t == u)) for i, k, t in rows for j, m, u in rows if None not in (i, j, k) and k == m and i < j)
        assert sorted((x.a, x.b, str(x.same)) for x in nearest.all_pairs_by_text(d, ["k"], "i", "t", lambda a, b: a == b, "same", block=block).collect()) == same


def test_copies_of_a_row_do_not_grow_with_its_group(spark):
    n = 100_000
    dealt = nearest._dealt(spark.range(n).selectExpr("id", "1 AS k"), ["k"], "id", nearest.PAIRED)
    most, lowest = dealt.agg(F.max("_blocks"), F.min("_own")).first()
    assert (most, lowest) == (nearest.CUTS, 0)  # 49 of the least size before
    sizes = [x["count"] for x in dealt.groupBy("_own").count().collect()]
    assert len(sizes) == nearest.CUTS and max(sizes) - min(sizes) <= 1
    copies = nearest._paired(dealt, ["k"], F.struct("id"))._jdf.queryExecution().optimizedPlan().toString()
    assert copies.count("Generate explode") == 2


def test_names_are_compared_once_for_all_rows_that_have_them(spark, tmp_path):
    n = 6000
    spark.range(n).selectExpr("id AS p_partkey", "concat('bolt ', id % 3) AS p_name", "'B' AS p_brand", "1 AS p_size").write.parquet(str(tmp_path / "part.parquet"))
    pairs = texts.fuzzy_pairs(spark, str(tmp_path))
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("levenshtein")  # above it in the plan, so after it
    assert pairs.groupBy("same").count().collect() == [(True, n * (n - 1) // 2)]


def test_measures_are_rounded_as_the_sql_rounds(spark, tmp_path):
    rows = [(1, [0.0, 0.0, 0.0, 0.0], 0), (2, [0.25, 0.3, -0.5, 0.1], 0), (3, [0.011, -0.9, 0.75, 0.9], 0), (4, [0.001, 0.0, -1.0, 0.0], 0), (5, None, 0), (6, [0.1, 0.2, 0.3, 0.4], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    query = notes.box_measures(spark, str(tmp_path))
    got = {(x.a, x.c): (x.gap, x.coverage) for x in query.collect()}
    want = {}
    for x in rows:
        for y in rows:
            if x[0] < y[0] and x[2] == y[2] and x[1] and y[1]:
                (ax, ay, aw, ah), (cx, cy, cw, ch) = ([int(float(np.float32(v) + np.float32(1)) * m) for v, m in zip(p[1], (4000, 4000, 60, 30), strict=True)] for p in (x, y))
                dx, dy = max(0, ax - cx - cw, cx - ax - aw), max(0, ay - cy - ch, cy - ay - ah)
                want[x[0], y[0]] = (round((dx * dx + dy * dy) ** 0.5, 6), round(max(0, min(ax + aw, cx + cw) - max(ax, cx)) / aw, 6) if aw else 0.0)
    assert {k: v for k, v in got.items() if 5 not in k} == want and len(got) == 10
    assert "round(" not in query._jdf.queryExecution().optimizedPlan().toString()
