"""Sections of pages with very many lines."""

import tracemalloc

import numpy as np

from annolake.operators import marks


def test_nearest_lines_hold_a_block_of_distances():
    r = np.random.default_rng(2)
    lines = np.column_stack([np.arange(8000), r.integers(0, 200, 8000), r.integers(0, 900, 8000), np.full(8000, 100), np.full(8000, 10)]).astype(float)
    points = r.integers(0, 900, (4000, 2)).astype(float)
    tracemalloc.start()
    got = marks.nearest_lines(points, lines)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # all distances have 256 MB
    for i in range(0, 4000, 400):
        d = [(np.hypot(max(0, x - points[i, 0], points[i, 0] - x - w), max(0, y - points[i, 1], points[i, 1] - y - h)), o) for o, x, y, w, h in lines]
        assert min(d)[1] == got[i]
    assert np.isnan(marks.nearest_lines(points[:2], lines[:0])).all()


def test_sections_make_no_pairs_of_entries_and_headings(spark):
    n = 30_000
    lines = spark.range(n).selectExpr("'d' AS doc_id", "0 AS page_index", "cast(id % 50 AS int) AS ord", "0D AS x", "cast(id % 50 * 20 AS double) AS y", "100D AS width", "10D AS height")
    entries = spark.range(n).selectExpr("'d' AS doc_id", "0 AS page_index", "cast(id AS string) AS entry_id", "5D AS x", "cast(id % 50 * 20 + 5 AS double) AS y")
    headings = spark.range(n).selectExpr("'d' AS doc_id", "0 AS page_index", "cast(id AS int) AS ord", "concat('H', id % 50) AS title", "5D AS x", "cast(id % 50 * 20 + 4 AS double) AS y")
    got = marks.sections(entries, headings, lines)
    assert got.count() == n
    # a heading over the entry on its own line stands below nothing that the entry is above: those of the line before govern
    assert got.where("section IS NULL").count() == n // 50 and got.where("section = 'H3'").count() == n // 50
