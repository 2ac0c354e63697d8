"""The chain model against all labellings, and pages in every odd form."""

import itertools
import random

import numpy as np
from annolake.llm import html_extract as H


def score(model, page, labels):
    total = sum(model.weights[model.index[f]][y] for own, y in zip(page, labels, strict=True) for f in own if f in model.index)
    return total + sum(model.turns[a][b] for a, b in itertools.pairwise(labels))


def test_decoding_finds_the_best_of_all_labellings():
    r = random.Random(2)
    names = [f"f{i}" for i in range(8)]
    for _ in range(60):
        model = H.Crf({n: i for i, n in enumerate(names)}, np.array([[r.gauss(0, 1), r.gauss(0, 1)] for _ in names]), np.array([[r.gauss(0, 1), r.gauss(0, 1)] for _ in range(2)]))
        page = [r.sample([*names, "unknown"], r.randint(0, 4)) for _ in range(r.randint(1, 9))]
        best = max(itertools.product((0, 1), repeat=len(page)), key=lambda y: score(model, page, y))
        assert tuple(model.decode(page)) == best
    assert model.decode([]) == []
    # of equal labellings the one with less main text
    flat = H.Crf({}, np.zeros((0, 2)), np.zeros((2, 2)))
    assert flat.decode([["a"], ["b"]]) == [0, 0]


def test_training_raises_the_likelihood_of_its_pages():
    def likelihood(model, pages):
        total = 0.0
        for page, labels in pages:
            every = [score(model, page, y) for y in itertools.product((0, 1), repeat=len(page))]
            total += score(model, page, labels) - np.logaddexp.reduce(every)
        return total / len(pages)

    r = random.Random(5)
    pages = []
    for _ in range(30):
        labels = [int(r.random() < 0.5) for _ in range(r.randint(2, 6))]
        pages.append(([[f"{'p' if y else 'li'}", r.choice(("a", "b"))] for y in labels], labels))
    few, many = (likelihood(H.train(pages, n), pages) for n in (1, 60))
    assert many > few and many > -0.2
    found = H.train(pages, 60)
    assert all(found.decode(page) == labels for page, labels in pages)


def test_odd_pages(spark):
    page = "<html><body><div class=nav><a href=x>Home</a></div><article>" + "<p>A paragraph of prose that goes on for a while, as they do.</p>" * 4000 + "</article></body></html>"
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, "u", page, "clash", 0), (2, "u", "<p>Twice the same page, with words enough.</p>", "", 1), (2, "u", "<p>Twice the same page, with words enough.</p>", "", 1), (None, None, None, None, None)]
    got = [(x["page_id"], x["text"]) for x in H.extract(spark.createDataFrame(rows, schema)).collect()]
    assert len(got) == 4 and dict(got)[1].count("\n\n") == 3999 and got[1] == got[2] and dict(got)[None] == ""
    assert H.extract(spark.createDataFrame([], schema)).count() == 0
