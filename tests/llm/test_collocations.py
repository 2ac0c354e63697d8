import random
import re
from collections import Counter, defaultdict

import numpy as np
from annolake.llm import collocations as C
from annolake.llm.suffix_automaton import automaton
from hypothesis import given, settings
from hypothesis import strategies as st


def grams(docs, longest=4):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split("[ \t]", piece) if x]
            n[lang or "und" if lang is None else lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f["und" if lang is None else lang][tuple(w[i : i + k])] += 1
    return f, n


def brute(docs, least, top, covered=80):
    f, n = grams(docs)
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in candidates.items():
            inside = any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items())
            if not inside:
                score, cut = min((2_000_000 * a // (counts[p[:c]] + counts[p[c:]]), c) for c in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), a, counts[p[:cut]], counts[p[cut:]]))
        out += [(lang, rank, p.decode(), a, l, r, n[lang], -s) for rank, (s, _, p, a, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def corpus(seed, size):
    r = random.Random(seed)
    vocabulary = ["of", "the", "The", "New", "york", "é", "中", "x.y", "a-b", "\x00", "it's", " ", "a", "b"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]

    def text():
        return "".join(w + r.choice((" ", " ", " ", "\t ", ", ", "\n", ". ", "")) for w in r.choices(vocabulary, weights, k=r.randint(0, 40)))

    docs = [(r.choice(("en", "en", "de", None, "")), text()) for _ in range(size)]
    return docs + [("en", None), ("en", ""), (None, ", ,"), ("fr", "only once here"), *[("en", "one and the same passage stands here many times")] * 40]


def found(spark, docs, least, top, **more):
    frame = spark.createDataFrame([(a, b, 0, "") for a, b in docs], "lang string, text string, n int, phrase string").repartition(3)
    path = C.Scratch(spark).write(frame, "documents", keep=True)  # a stored table
    return sorted(map(tuple, C.collocations(path, top, least, **more).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def test_equals_brute_force(spark):
    docs = corpus(1, 600)
    want = brute(docs, 5, 50)
    assert len(want) > 100 and found(spark, docs, 5, 50) == want


def test_many_blocks(spark):
    docs = corpus(2, 300)
    assert found(spark, docs, 3, 2000, size=500) == brute(docs, 3, 2000)


def test_colliding_hashes_do_no_harm(spark):
    docs = corpus(3, 200)
    frame = C.Scratch(spark).write(spark.createDataFrame(docs, "lang string, text string"), "documents", keep=True)
    got = {(x["lang"], x["phrase"]): x["f"] for x in C.phrase_counts(frame, 4, size=2000, spare=-8).where("k > 0").collect()}
    want = {(lang, " ".join(p)): n for lang, counts in grams(docs)[0].items() for p, n in counts.items() if n >= 4}
    assert got == want


def test_no_rows_and_no_candidates(spark):
    assert found(spark, [], 2, 5) == [] and found(spark, [("en", "a b c"), (None, None)], 2, 5) == []


def test_very_long_text(spark):
    docs = [("en", "tick tock " * 200_000 + "." + "x" * 1_000_000), ("en", "tick tock " * 40)]
    f, n = grams(docs)
    got = found(spark, docs, 30, 10)
    assert got == [("en", r, p, f["en"][tuple(p.split())], left, right, n["en"], s) for r, (p, left, right, s) in enumerate([(x[2], x[4], x[5], x[7]) for x in got], 1)]
    assert {x[2] for x in got} == {"tick tock tick tock", "tock tick tock tick"}


def test_products_beyond_64_bits(spark):
    big = 3 * 10**15
    rows = [("en", 1, "a", 2 * big), ("en", 1, "b", big), ("en", 2, "a b", big - 1), ("en", 0, "", 9 * big)]
    got = C.scored(spark.createDataFrame(rows, "lang string, k int, phrase string, f long")).collect()
    assert [(x["phrase"], x["l"], x["r"], x["score"]) for x in got] == [("a b", 2 * big, big, 2_000_000 * (big - 1) // (3 * big))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=12), min_size=1, max_size=6), st.integers(1, 5))
def test_automaton_of_many_sequences(sequences, depth):
    numbers = np.array([x for s in sequences for x in s])
    piece = np.repeat(np.arange(len(sequences)), [len(s) for s in sequences])
    levels = [np.array([i for i in range(k, len(numbers)) if piece[i] == piece[i - k]], np.int64) for k in range(depth)]
    own = automaton(numbers, levels)
    places = defaultdict(set)
    for k, level in enumerate(levels):
        for i in level:
            places[tuple(numbers[i - k : i + 1])].add(int(i))
    got = {tuple(numbers[e - k + 1 : e + 1]): int(n) for e, k, n in zip(*own.substrings(), strict=True)}
    assert got == {s: len(p) for s, p in places.items()} and len(got) == sum(own.longest - own.shortest + 1)
    # one state for each set of end places, and links to the longest proper suffix of another set
    assert len(own.end) == len({frozenset(p) for p in places.values()})
    for e, short, link in zip(own.end, own.shortest, own.link, strict=True):
        suffix = tuple(numbers[e - short + 2 : e + 1])
        assert (link == -1) == (not suffix)
        if suffix:
            assert tuple(numbers[own.end[link] - own.longest[link] + 1 : own.end[link] + 1]) == suffix


def test_counts_are_not_broadcast_by_the_size_of_their_files(spark):
    docs = spark.createDataFrame([("en", "one two three four five. " * 40)], "lang string, text string")
    scratch = C.Scratch(spark)
    counts = C.phrase_counts(scratch.write(docs, "few"), scratch=scratch)
    found = C.scored(counts)
    assert found.count() > 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    scratch.clear()
