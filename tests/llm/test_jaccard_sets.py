"""Ids that stand for several texts, in one run and in later ones."""

import random

from annolake.llm import jaccard_join as J
from test_jaccard_join import brute, made


def matches(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((x["doc_id"], x["n_shingles"], x["component_id"]) for x in J.near_duplicates(frame).collect()), key=repr)
    assert got == brute(rows)


def test_a_later_run_with_other_texts_under_the_same_ids(spark, monkeypatch):
    monkeypatch.setattr(J, "LARGE", 3)
    monkeypatch.setattr(J, "BLOCK", 4)
    rows = made(7)
    matches(spark, rows)
    texts = [t for _, t in rows]
    random.Random(1).shuffle(texts)
    matches(spark, [(d, t) for (d, _), t in zip(rows, texts, strict=True)])


def test_an_id_with_several_texts_is_one_document(spark, monkeypatch):
    r = random.Random(9)
    prose = lambda: " ".join(f"w{r.randrange(400)}" for _ in range(60))
    a, b, c, d = (prose() for _ in range(4))
    near = lambda t: t + " more"
    # 5 holds the texts of 3 and 4 and is no node itself; 20 is near 21 by one text and near 22 by the other
    rows = [(3, a), (4, b), (5, a), (5, b), (20, c), (20, d), (21, near(c)), (22, near(d)), (30, prose()), (30, prose()), (30, None)]
    assert {x[2] for x in brute([*rows, (5, a)]) if x[0] in (3, 4, 5)} == {3}
    matches(spark, rows)
    monkeypatch.setattr(J, "LARGE", 2)
    matches(spark, rows)
