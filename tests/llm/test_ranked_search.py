import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from annolake.llm import bit_slices as B
from annolake.llm import ranked_search as R
from hypothesis import given, settings
from hypothesis import strategies as st

TERM = re.compile(R.TERM)


def brute(docs, items, k=R.TOP):
    def terms(text):
        return Counter(TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")))

    own = [(i, terms(t)) for i, t in docs if i is not None]
    count, total = sum(bool(c) for _, c in own), sum(c.total() for _, c in own)
    df = Counter(t for _, c in own for t in c)
    asked = {}
    for i, t in dict.fromkeys((i, t or "") for i, t in items if i is not None):
        asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scored = []
        for doc, c in own:
            m = 75 + 25 * c.total() * count // total if total else 0
            score = sum(q * math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in wanted.items() if c[t])
            scored += [(-score, doc)] if score > 0 else []
        out += [(item, r, doc, -score) for r, (score, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def found(spark, docs, items, k=R.TOP):
    d = spark.createDataFrame([(i, t, 0, "") for i, t in docs], "doc_id long, text string, rank int, block string")
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, score int")
    return sorted(map(tuple, R.ranked_search(d.repartition(3), q, k).collect()))


@pytest.fixture(scope="module")
def small():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "é", "x́", "中文", "A", "a1", "1"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]

    def text(low, high):
        return "".join(w + r.choice((" ", ", ", "\n", "_", "-")) for w in r.choices(vocabulary, weights, k=r.randint(low, high)))

    docs = [(i, text(0, 60)) for i in range(400)]
    docs += [(1000 + i, "w1 w2 rare") for i in range(60)]  # ties
    docs += [(2000, None), (2001, ""), (2002, "... --"), (None, "w1 w2"), (2003, "rare " * 3000), (3, "w1 w1 w30 twice"), (-7, "w3 rare")]
    items = [(i, text(1, 30)) for i in range(25)] + [(100, "rare rare w1"), (101, None), (102, ""), (103, "unknown"), (None, "w1"), (104, "w1"), (104, "w1"), (104, "RARE"), (105, "w7 " * 500)]
    return docs, items


def test_equals_brute_force(spark, small):
    assert found(spark, *small) == brute(*small)


def test_many_blocks_groups_and_salts(spark, small):
    docs, items = small
    d = spark.createDataFrame([x for x in docs if x[0] is not None], "doc_id long, text string")
    q = spark.createDataFrame(items, "item_id long, text string")
    stats = R.statistics(d)
    scratch = R.Scratch(spark)
    index = scratch.write(R.build_index(d, stats, size=700, most=7), "impacts")
    assert index.where("term IS NULL").count() > 50
    got = sorted(map(tuple, R.search(index, stats[0], R.item_terms(q), 5, items=4, salted=10).collect()))
    scratch.clear()
    assert got == brute([x for x in docs if x[0] is not None], items, 5)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "x")]) == [] and found(spark, [(1, "x y")], []) == [] and found(spark, [(1, None)], [(1, "x")]) == []
    assert found(spark, [(1, "x y"), (2, "y")], [(1, "x")]) == brute([(1, "x y"), (2, "y")], [(1, "x")])


def test_very_long_text_and_item(spark):
    docs = [(1, "".join(f"t{i % 50_000} " for i in range(400_000))), (2, "t1 t2"), (3, "t49999 " * 100_000)]
    items = [(1, " ".join(f"t{i}" for i in range(0, 3000, 3))), (2, "t49999")]
    assert found(spark, docs, items) == brute(docs, items)


numbers = st.lists(st.integers(0, (1 << 20) - 1), min_size=1, max_size=150)


def sliced(values, height):
    wide = -(-len(values) // 64)
    bits = np.zeros((height, wide * 64), np.uint8)
    for p in range(height):
        bits[p, : len(values)] = [v >> p & 1 for v in values]
    return np.packbits(bits, axis=1).view(np.uint64)


@settings(max_examples=60, deadline=None)
@given(numbers, st.integers(1, 30_000), st.integers(1, 30))
def test_slices_add_multiply_and_rank(values, factor, k):
    own = sliced(values, 20)
    many = [B.times(own, factor + i, 40) for i in range(4)]
    out = B.total(many)
    want = [v * (4 * factor + 6) for v in values]
    everywhere = np.arange(len(values))
    assert B.at(out, everywhere).tolist() == want
    best = sorted(range(len(values)), key=lambda i: (-want[i], i))
    assert sorted(B.top(out, k).tolist()) == sorted(i for i in best[:k] if want[i] > 0)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(0, 190), st.integers(0, 1023), min_size=1))
def test_few_numbers_spread_over_many(values):
    places = np.array(sorted(values), np.uint16)
    bits = np.array([[values[int(p)] >> s & 1 for p in places] for s in range(10)], np.uint8)
    out = B.spread(np.packbits(bits, axis=1).tobytes(), places, 10, 3)
    assert B.at(out, np.arange(192)).tolist() == [values.get(i, 0) for i in range(192)]
