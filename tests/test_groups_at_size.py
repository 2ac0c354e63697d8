"""Groups of many batches are put together once."""

import pandas as pd
from annolake.operators import lines
from annolake.operators.shared import by_group


def test_a_group_of_many_batches_is_joined_once(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        rows = spark.range(3000).selectExpr("CASE WHEN id < 2900 THEN 'a' ELSE concat('k', id % 30) END AS k", "id")

        def run(frame):
            yield frame.k.iloc[0], len(frame), int(frame.id.sum()), frame.id.is_monotonic_increasing

        got = {x.k: (x.n, x.s, x.o) for x in by_group(rows, "k", ["id"], run, "k string, n long, s long, o boolean").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for i in range(3000):
        want.setdefault("a" if i < 2900 else f"k{i % 30}", []).append(i)
    assert got == {k: (len(v), sum(v), True) for k, v in want.items()}


def test_measures_of_a_page_read_no_texts(spark):
    rows = [("p", i, "x" * (i % 3 + 1), 0.0, -10.0 * i, 1.0, 10.0) for i in range(20)]
    told = lines.page_measures(spark.createDataFrame(rows, "page_id string, ord int, text string, x double, y double, width double, height double"))
    assert [tuple(x) for x in told.collect()] == [("p", 10.0, 10.0)]
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan and "text#" not in plan.split("RepartitionByExpression")[0]
    frame = pd.DataFrame(rows, columns=["page_id", "ord", "text", "x", "y", "width", "height"])
    assert lines.body_size(frame) == 10.0


def test_groups_of_few_bytes_are_dealt_to_many_tasks(spark):
    """Also where a join has dealt the rows by the same key before."""
    from pyspark import TaskContext

    rows = spark.range(400).selectExpr("concat('k', id % 100) AS k", "id")
    joined = rows.hint("merge").join(spark.range(100).selectExpr("concat('k', id) AS k", "id AS n"), "k")

    def run(frame):
        yield frame.k.iloc[0], len(frame), TaskContext.get().partitionId()

    for frame in (rows, joined):
        got = by_group(frame, "k", ["id"], run, "k string, n long, task int").collect()
        assert len(got) == 100 and {x.n for x in got} == {4}
        assert len({x.task for x in got}) >= 8
