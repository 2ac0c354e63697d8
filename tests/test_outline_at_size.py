"""Positions in outlines of any shape, and how often the nodes of a bushy one are passed on."""

import random

import pytest
from annolake.operators import outline
from annolake.operators.shared import Rounds


def by_loop(rows):
    below = {}
    for i, up, o in rows:
        below.setdefault(up, []).append((o, i))
    out, stack = {}, [(i, 1) for _, i in sorted(below.get(None, []), reverse=True)]
    while stack:
        i, depth = stack.pop()
        out[i] = (depth, len(out) + 1)
        stack += [(c, depth + 1) for _, c in sorted(below.get(i, []), reverse=True)]
    return out


@pytest.mark.parametrize("shape", ["bushy", "mixed", "chain", "star", "rootless"])
def test_positions_equal_a_walk(spark, shape):
    r = random.Random(shape)
    up = {
        "bushy": lambda i: i // 3 if i > 1 else None, "mixed": lambda i: r.choice([r.randrange(i), max(0, i - 1), i // 2, i // 9]) if i > 2 else None,
        "chain": lambda i: i - 1 if i else None, "star": lambda i: 0 if i else None, "rootless": lambda i: [None, i // 2, i // 4, 5000 + i % 3, i][r.randrange(5)] if i else 0,
    }[shape]
    rows = [(i, up(i), r.randrange(5)) for i in range(40 if shape == "chain" else 400) if shape != "bushy" or i > 0]
    told = outline.preorder(spark.createDataFrame(rows, "id long, up long, ord int"))
    assert told.columns == ["id", "depth", "position"]
    got = {x.id: (x.depth, x.position) for x in told.collect()}
    assert got == by_loop(rows)


def test_a_bushy_outline_is_passed_on_a_few_times_only(spark, monkeypatch):
    written, plain = [], Rounds.write
    monkeypatch.setattr(Rounds, "write", lambda self, df: (t := plain(self, df), written.append(t.count()))[0])
    n = 3**8
    told = outline.preorder(spark.range(1, n).where("id <> 2").selectExpr("id", "IF(id > 1, id DIV 3, NULL) AS up", "id AS ord"))
    assert told.count() == (n - 1) // 2 and sum(written) < 8 * n
