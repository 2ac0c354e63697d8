"""What is shown of runs, by one sort of their events."""

import random

from annolake.streaming.progress import progress


def shown(events):
    total, base, steps, pages, over, out = sum(s or 0 for k, s in events if k == "start"), 0, 0, 0, False, []
    last = 0
    for kind, s in events:
        if kind == "start":
            base, steps, pages, over, last = base + last, s or 0, 0, False, 0
        pages, over = pages + (kind == "page"), over or kind == "finish"
        last = steps if over else min(pages, steps)
        if total > 0 and (kind != "page" or pages <= steps):
            out.append((base + last, total, last, steps))
    return out


def test_progress_equals_a_loop_and_sorts_once(spark):
    r = random.Random(8)
    runs = {i: [(r.choice(["start", "page", "page", "step", "finish"]), r.choice([None, 0, 1, 2, 3])) for _ in range(r.randint(1, 30))] for i in range(40)}
    rows = [(i, n, k, s) for i, events in runs.items() for n, (k, s) in enumerate(events)]
    r.shuffle(rows)
    told = progress(spark.createDataFrame(rows, "run long, ord int, kind string, steps int"))
    got = {}
    for x in sorted(told.collect(), key=lambda x: (x.run, x.ord)):
        got.setdefault(x.run, []).append((x.done, x.total, x.unit_done, x.unit_total))
    assert got == {i: s for i, e in runs.items() if (s := shown(e))}
    assert told._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Sort [") == 1
