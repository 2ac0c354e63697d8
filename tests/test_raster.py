import math
import random

from annolake.operators import raster as R
from pyspark.sql import functions as F

SCHEMA = "page_id int, stroke_id int, ord int, x double, y double, width double, is_marker boolean, brush double"


def bitmap(rows, padding=0):
    """Pixels one by one, as the definition says."""
    pts = []
    for _, s, o, x, y, w, m, b in rows:
        if math.isfinite(x) and math.isfinite(y):
            plain = (b if b and b > 0 else 2) / 2
            r = min(max(w / 8 if not m and w and w > 0 else plain, 0.5), 50)
            pts.append((s, o, min(max(x, -4000), 1404 + 4000), min(max(y, -4000), 1872 + 4000), r))
    pad = max(p[4] for p in pts)
    left, top = min(p[2] for p in pts) - pad - padding, min(p[3] for p in pts) - pad - padding
    width, height = (min(max(math.ceil(max(p[i] for p in pts) - min(p[i] for p in pts) + 2 * pad), 1), 6000) + 2 * padding for i in (2, 3))
    out = set()

    def disc(cx, cy, r):
        for y in range(max(0, math.floor(cy - r)), min(height - 1, math.ceil(cy + r)) + 1):
            for x in range(max(0, math.floor(cx - r)), min(width - 1, math.ceil(cx + r)) + 1):
                if (x - cx) * (x - cx) + (y - cy) * (y - cy) <= r * r:
                    out.add((x, y))

    for s in {p[0] for p in pts}:
        own = [(x - left, y - top, r) for _, _, x, y, r in sorted(p for p in pts if p[0] == s)]
        if len(own) == 1:
            disc(*own[0])
        for (ax, ay, ar), (bx, by, br) in zip(own, own[1:], strict=False):
            r = max(ar, br)
            steps = max(1, math.ceil(math.hypot(bx - ax, by - ay) / r))
            for k in range(steps + 1):
                disc(ax + (bx - ax) * (k / steps), ay + (by - ay) * (k / steps), r)
    return out, width, height


def check(spark, rows, padding=0):
    runs, bounds = R.rasterised(spark.createDataFrame(rows, SCHEMA), padding)
    got, sizes = {}, {b["page_id"]: (b["width"], b["height"]) for b in bounds.collect()}
    for r in runs.collect():
        own = got.setdefault(r["page_id"], set())
        new = {(x, r["y"]) for x in range(r["x0"], r["x1"] + 1)}
        assert not own & new and (r["x0"] - 1, r["y"]) not in own and (r["x1"] + 1, r["y"]) not in own  # runs are whole and apart
        own |= new
    for page in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == page]
        if any(math.isfinite(r[3]) and math.isfinite(r[4]) for r in own):
            pixels, width, height = bitmap(own, padding)
            assert got.get(page, set()) == pixels and sizes[page] == (width, height), page


def test_runs_equal_a_bitmap(spark):
    r = random.Random(9)
    rows = []
    for page in range(12):
        for stroke in range(r.randint(1, 4)):
            x, y = r.uniform(-60, 60), r.uniform(0, 60)
            for o in range(r.choice((1, 2, 5))):
                rows.append((page, stroke, o, x, y, r.choice((None, 0.0, 4.0, 13.0, 30.0, 90.0)), r.random() < 0.2, r.choice((None, 0.0, 1.0, 6.0))))
                x, y = x + r.choice((0.0, r.uniform(-20, 20))), y + r.choice((0.0, r.uniform(-9, 9)))
    rows += [(20, 0, i, float(i), 5.0, 8.0, False, 1.0) for i in range(0, 9, 4)] + [(21, 0, 0, 3.0, 4.0, 40.0, False, 1.0)]  # on whole pixels: the edge counts
    rows += [(22, 0, 0, float("nan"), 1.0, 8.0, False, 1.0), (23, 0, 0, 1e38, 2.0, 1e38, False, 1.0), (23, 0, 1, float("inf"), 2.0, 8.0, False, 1.0)]
    check(spark, rows)
    check(spark, rows, padding=3)


def test_pages_as_one_value(spark):
    rows = [(1, 0, 0, 0.0, 0.0, 16.0, False, 1.0)]
    runs, bounds = R.rasterised(spark.createDataFrame(rows, SCHEMA))
    got = R.run_lengths(runs, bounds).first()
    assert (got["width"], got["height"]) == (4, 4) and [(y, [tuple(x) for x in own]) for y, own in got["rows"]] == [(0, [(2, 2)]), (1, [(1, 3)]), (2, [(0, 3)]), (3, [(1, 3)])]
    empty, none = R.rasterised(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and none.count() == 0 and R.run_lengths(empty, none).select(F.count("*")).first()[0] == 0


def test_more_points_are_dealt_to_more_tasks(spark, monkeypatch):
    points = spark.range(400).selectExpr("cast(id % 40 AS string) AS page_id", "'s' AS stroke_id", "cast(id AS int) AS ord", "double(id % 7) AS x", "double(id % 5) AS y", "8.0D AS width", "false AS is_marker", "2.0D AS brush")
    few = sorted(map(tuple, R.rasterised(points)[0].collect()))
    monkeypatch.setattr(R, "POINTS", 16, raising=False)
    runs, bounds = R.rasterised(points)
    assert runs.rdd.getNumPartitions() == 25 and bounds.rdd.getNumPartitions() == 25
    assert sorted(map(tuple, runs.collect())) == few and few
