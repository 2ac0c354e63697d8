"""Edited copies against full alignment: what the seeds find must be all that reaches the least score."""

import random

from annolake.llm import decontaminate
from test_small_operators import full_alignment


def edited(r, words, share):
    """Each word replaced, left out or followed by another one, with the given chance."""
    out = []
    for w in words:
        kind = r.random()
        if kind >= share:
            out.append(w)
        elif kind < share / 3:
            out.append(f"n{r.randrange(10**6)}")
        elif kind < share * 2 / 3:
            out += [w, f"n{r.randrange(10**6)}"]
    return out


def test_no_edited_copy_that_reaches_the_score_is_missed(spark):
    r = random.Random(11)
    distinct = [f"w{i}" for i in range(40)]
    common = ["the", "of", "and", "in"]
    items = [(0, distinct)] + [(i, [r.choice(common) if r.random() < 0.4 else f"v{r.randrange(300)}" for _ in range(r.choice((4, 5, 9, 25, 40, 59)))]) for i in range(1, 13)]
    filler = lambda n: [r.choice(common) if r.random() < 0.4 else f"v{r.randrange(300)}" for _ in range(n)]
    parts = [[f"x{i}" if i % 5 == 4 else w for i, w in enumerate(distinct)], [f"x{i}" if i % 4 == 3 else w for i, w in enumerate(distinct)], [f"x{i}" if i % 3 == 2 else w for i, w in enumerate(distinct)]]
    parts += [[x for w in distinct for x in (w, "between")], distinct]
    parts += [edited(r, words, share) for share in (0.15, 0.2, 0.25, 0.3) for _, words in items for _ in range(6)]
    docs = [(k, " ".join(filler(r.randrange(60)) + part + filler(r.randrange(60)))) for k, part in enumerate(parts)]
    told = [(i, " ".join(w)) for i, w in items]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(told, "item_id long, text string")).collect()
    want = {(d, i): s for d, t in docs for i, q in told if (s := full_alignment(q, t)) >= decontaminate.MIN_SCORE}
    assert {(d, 0) for d in range(5)} <= want.keys()
    assert {(x["doc_id"], x["item_id"]): x["score"] for x in got} == want


def found(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, item_id string, score int")
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    return sorted((tuple(x) for x in decontaminate.contaminated(d, q).collect()), key=repr)


def test_short_items_are_found_by_their_very_words(spark):
    r = random.Random(5)
    vocabulary = ["alpha", "beta", "Gamma", "delta", "of", "the"]
    docs = [(i, "".join(r.choice(vocabulary) + r.choice((" ", ", ", "\n")) for _ in range(r.randint(0, 30)))) for i in range(120)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(n))) for i, n in enumerate((1, 2, 2, 2, 3, 3, 3, 3, 3))] + [(50, "unknown words here"), (51, "zeta"), (52, ""), (53, None), (54, "beta unknown"), (0, None)]
    want = []
    for d, text in docs:
        have = decontaminate.words(text)
        for i, q in dict.fromkeys(items):
            own = decontaminate.words(q or "")
            at = next((k for k in range(len(have) - len(own) + 1) if have[k : k + len(own)] == own), None) if own else None
            if at is not None:
                want.append((d, i, 1.0, at, at + len(own), len(own) - 1))
    assert len(want) > 100 and found(spark, docs, items) == sorted(want, key=repr)


def test_short_and_long_items_together_and_odd_rows(spark):
    words = [f"w{i}" for i in range(12)]
    whole = " ".join(words)
    docs = [(1, whole), (1, whole), (None, whole), (2, None), (3, ""), (4, f"{whole} and again {whole}"), (5, "x " * 300_000 + whole), (6, "w3 w4 w5")]
    items = [(7, whole), (7, whole), (None, whole), (8, "w3 w4"), (9, "  ")]
    got = found(spark, docs, items)
    hit = {(d, i): (s, a, b) for d, i, s, a, b, _ in got}
    assert hit[(1, 7)] == (1.0, 0, 12) and hit[(4, 7)] == (1.0, 0, 12) and hit[(5, 7)] == (1.0, 300_000, 300_012) and hit[(6, 8)] == (1.0, 0, 2) and hit[(4, 8)] == (1.0, 3, 5)
    assert sum(d == 1 and i == 7 for d, i, *_ in got) == 2 and {i for d, i, *_ in got if d is None} == {7, 8, None} and not any(d in (2, 3) for d, *_ in got)
    assert found(spark, [], items) == [] and found(spark, docs, []) == []
