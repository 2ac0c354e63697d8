import random
import re

import numpy as np
from annolake.llm import jaccard_join as J


def brute(rows):
    sets = []
    for _, text in rows:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = {d: d for d, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(rows[i][0]), find(rows[j][0])))
                up[y] = x
    return sorted(((d, len(s), find(d)) for (d, _), s in zip(rows, sets)), key=repr)


def made(seed, n=120):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    prose = lambda k: [r.choice(vocabulary) for _ in range(k)]
    passage = prose(40)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "ONE  two"), (5, "one two three"), (None, "a b c d e f g"), (6, "x\xa0y z a b c d")]
    doc = 10
    for _ in range(n // 6):
        base = prose(r.choice((6, 20, 60, 200)))
        if r.random() < 0.4:
            base[len(base) // 2 : len(base) // 2] = passage
        for _ in range(6):
            copy = list(base)
            for _ in range(r.choice((0, 0, 1, 1, 2, 3, 5))):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append((doc, " ".join(copy) if r.random() < 0.8 else "  ".join(copy).upper()))
            doc += r.randint(1, 3)
    r.shuffle(rows)
    return rows


def test_components_match_brute_force(spark):
    for seed in (1, 2):
        rows = made(seed)
        frame = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, n int, b int")
        got = sorted(((x["doc_id"], x["n_shingles"], x["component_id"]) for x in J.near_duplicates(frame).collect()), key=repr)
        assert got == brute(rows)


def test_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "LARGE", 3)
    monkeypatch.setattr(J, "BLOCK", 4)
    rows = made(5)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((x["doc_id"], x["n_shingles"], x["component_id"]) for x in J.near_duplicates(frame).collect()), key=repr)
    assert got == brute(rows)


def test_links_at_the_very_threshold_and_chains(spark):
    # sets of 90 with 80 in common: 80/100; a chain whose ends are not similar
    words = [f"t{i}" for i in range(200)]
    rows = [(k, " ".join(words[10 * k : 10 * k + 94])) for k in range(6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in J.near_duplicates(frame).collect())
    assert got == brute(rows) == [(k, 90, 0) for k in range(6)]


def test_an_empty_table(spark):
    assert J.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_spanning_links_connect_the_same_nodes():
    def groups(nodes, pairs):
        up = {n: n for n in nodes}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for x, y in pairs:
            up[find(x)] = find(y)
        out = {}
        for n in nodes:
            out.setdefault(find(n), set()).add(n)
        return sorted(map(sorted, out.values()))

    r = np.random.default_rng(1)
    for n, m, share in ((1, 1, 1.0), (5, 8, 0.2), (30, 20, 0.05), (30, 30, 0.5), (12, 12, 0.0)):
        linked = r.random((n, m)) < share
        names = [("x", i) for i in range(n)] + [("y", i) for i in range(m)]
        xs, ys = J.spanning(linked, False)
        assert len(xs) < n + m and all(linked[x, y] for x, y in zip(xs, ys))
        assert groups(names, [(("x", x), ("y", y)) for x, y in zip(xs.tolist(), ys.tolist())]) == groups(names, [(("x", x), ("y", y)) for x, y in np.argwhere(linked).tolist()])
        if n == m:
            both = linked | linked.T
            xs, ys = J.spanning(both, True)
            assert len(xs) < max(n, 2) and groups(range(n), zip(xs.tolist(), ys.tolist())) == groups(range(n), np.argwhere(both).tolist())
