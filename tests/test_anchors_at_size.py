"""The nearest line of a note is found without pairs of notes and lines."""

import random

from annolake.operators import nearest as N
from annolake.plans import joins

NOTES, LINES = "i long, k string, x long, y long", "j long, k string, rx long, ry long"


def _rows(r, n, wide):
    at = lambda: r.choice([None, *(r.randrange(-wide, wide + 1) for _ in range(30))])
    return [(i, r.choice(["a", "b", "c", None]), at(), at()) for i in range(n)]


def test_nearest_in_plane_is_that_of_all_pairs(spark):
    for seed, wide, n in ((1, 3, 40), (2, 40, 150), (3, 1000, 60), (4, 0, 3)):
        r = random.Random(seed)
        notes, lines = _rows(r, 150, 2 * wide), [x for x in _rows(r, n, wide) if x[1] != "c"]
        got = {x.i: (x.away, x.value) for x in N.nearest_in_plane(spark.createDataFrame(notes, NOTES), spark.createDataFrame(lines, LINES), ["k"], ["i"], ("x", "y"), ("rx", "ry"), "j").collect()}
        pairs = [(i, abs(x - rx) + abs(y - ry), j) for i, k, x, y in notes for j, m, rx, ry in lines if k is not None and k == m and None not in (x, y, rx, ry)]
        assert got == {i: min((d, j) for o, d, j in pairs if o == i) for i in {p[0] for p in pairs}} and (n < 40 or len(got) > 50)
        near = {x.i: x.out for x in N.nearest_step(spark.createDataFrame(notes, NOTES), spark.createDataFrame(lines, LINES), ["k"], "x", "rx", "j", 3, "out").collect()}
        want = {i: min(((abs(x - rx), j) for j, m, rx, _ in lines if k is not None and k == m and None not in (x, rx) and abs(x - rx) <= 3), default=(0, None))[1] for i, k, x, _ in notes}
        assert near == want


def test_no_lines_at_all(spark):
    notes = spark.createDataFrame([(1, "a", 1, 1)], NOTES)
    assert N.nearest_in_plane(notes, spark.createDataFrame([], LINES), ["k"], ["i"], ("x", "y"), ("rx", "ry"), "j").count() == 0


def test_anchors_of_unknown_places_are_those_of_the_sql(spark, tmp_path):
    rows = [(1, [0.1, 0.1], 0), (2, [0.1, 0.5], 0), (4, [None, 0.2], 0), (3, [None, 0.1], 0), (5, [0.9, -0.9], 1), (6, [None, 0.0], 1), (7, [0.5, 0.5], 2), (9, None, 0)]
    rows += [(10, [0.2, 0.5], None), (11, [0.2, 0.5], None), (13, [0.6, 0.5], 0), (15, [0.12, 0.49], 0), (17, [0.101, None], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {x.vec_id: (x.anchor, x.kind) for x in joins.nearest_anchor(spark, str(tmp_path)).collect()}
    line = (2, "line")
    assert got == {1: (2, "heading"), 3: line, 5: (6, "line"), 7: (None, "page"), 9: line, 11: (None, "page"), 13: line, 15: (2, "highlight"), 17: (2, "heading")}


def test_many_notes_and_lines_of_one_label_make_no_pairs(spark, tmp_path):
    n = 60_000  # 900 million pairs
    spark.range(n).selectExpr("id AS vec_id", "array(float(id % 2 * 0.9), float((id * 37 % 1000) / 1000.0)) AS embedding", "1 AS label").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = joins.nearest_anchor(spark, str(tmp_path))
    assert found.where("kind = 'line'").count() == n // 2
    # all pairs would come of an inner join by the label alone
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [x for x in plan if "Join Inner" in x and "label" in x] and [x for x in plan if "Join LeftOuter" in x and "label" in x]
