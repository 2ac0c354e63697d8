"""Pages of very many strokes and highlights."""

import tracemalloc

import numpy as np
import pandas as pd

from annolake.operators import clusters


def boxes(n, seed=0):
    r = np.random.default_rng(seed)
    low = np.floor(r.random((n, 2)) * 40 * np.sqrt(n))
    return np.hstack([low, low + np.floor(r.random((n, 2)) * [120, 140])])


def pairs(found):
    return {(min(i, j), max(i, j)) for a, b in found for i, j in zip(a.tolist(), b.tolist(), strict=True)}


def test_pairs_of_boxes_are_all_pairs_that_hold():
    box, line = boxes(300), 40.0
    gap = lambda a0, a1, b0, b1: max(0, a0 - b1, b0 - a1)
    on, below = set(), set()
    for i in range(300):
        for j in range(i + 1, 300):
            (p0, q0, p1, q1), (r0, s0, r1, s1) = box[i].tolist(), box[j].tolist()
            tall = max(q1 - q0, s1 - s0)
            level = abs((q0 + q1) / 2 - (s0 + s1) / 2) <= 22 or tall <= 100 and min(q1, s1) - max(q0, s0) >= 20
            if level and gap(p0, p1, r0, r1) <= 120:
                on.add((i, j))
            outside = all(x1 > 400 or x0 < 200 for x0, x1 in ((p0, p1), (r0, r1)))
            if outside and tall <= 100 and gap(q0, q1, s0, s1) <= tall * 0.8 and abs(p0 - r0) <= 160 and min(p1, r1) > max(p0, r0):
                below.add((i, j))
    assert on and pairs(clusters.joined(box, line)) == on and below and pairs(clusters.stacked(box, line, 200.0, 400.0)) == below
    assert clusters.components(300, clusters.joined(box, line)) == clusters.linked(300, sorted(on))


def test_memory_grows_with_the_strokes_of_a_page_not_with_their_pairs():
    n = 20_000
    strokes = pd.DataFrame(boxes(n), columns=["min_x", "min_y", "max_x", "max_y"]).assign(id=[str(i) for i in range(n)])
    tracemalloc.start()
    notes = clusters.page_clusters(strokes, 40.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, notes.strokes)) == n and peak < 200e6  # one matrix of pairs has 400 MB


def test_equal_sentences_are_merged_before_they_are_compared(spark):
    n = 30_000  # all pairs of them are no longer made
    rows = [("p", i, str(i), ("some words", "words", "other", "", None)[i % 5], float(i % 7 + (i < 100)), i % 3 == 0) for i in range(n)]
    got = dict(clusters.merged_highlights(spark.createDataFrame(rows, "page_id string, ord int, id string, sentence string, top double, is_ink boolean")).select("id", "survivor_id").collect())
    few = pd.DataFrame(rows[:200], columns=["page_id", "ord", "id", "sentence", "top", "is_ink"])
    small = dict(clusters.merged_highlights(spark.createDataFrame(few.astype(object).values.tolist(), "page_id string, ord int, id string, sentence string, top double, is_ink boolean")).select("id", "survivor_id").collect())
    assert small == dict(clusters.merged_by_text(few).values.tolist())
    best = lambda texts: min((r for r in rows if r[3] in texts and not r[5]), key=lambda r: (r[4], r[1]))[2]
    held, alone = best(("some words", "words")), best(("other",))
    assert len(got) == n and all(got[r[2]] == (r[2] if not r[3] else alone if r[3] == "other" else held) for r in rows)
