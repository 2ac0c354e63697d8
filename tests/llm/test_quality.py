"""Order, length of context and threshold of the quality model."""

import random

import pytest
from annolake.llm import quality
from pyspark.sql import functions as F

DOCS, LABELS = "doc_id long, text string, lang string", "doc_id long, quality int, toxic int"


def judged(spark, trusted, others):
    docs = [(i, t, "aa") for i, t in enumerate([*trusted, *others])]
    labels = [(i, 1, 0) for i in range(len(trusted))]
    rows = quality.classify(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    return {x["doc_id"]: x for x in rows}


def test_word_order_and_repetition_count(spark):
    r = random.Random(4)
    chain = ["Once", "there", "was", "a", "tall", "green", "house", "by", "our", "river", "where", "we", "met"]
    told = lambda: " ".join(chain[(start + k) % len(chain)] for start in [r.randrange(len(chain))] for k in range(r.randint(30, 90)))
    trusted = [told() for _ in range(200)]
    clean = told()
    salad = clean.split()
    r.shuffle(salad)
    got = judged(spark, trusted, [clean, " ".join(salad), " ".join(["Once"] * 60)])
    clean, salad, stutter = (got[len(trusted) + k] for k in range(3))
    assert clean["keep"] and not salad["keep"] and not stutter["keep"]
    assert salad["perplexity"] > 1.5 * clean["perplexity"]


def test_four_characters_of_context_decide(spark):
    got = judged(spark, ["abcdx", "zbcdy"] * 60, ["abcdx", "abcdy"])
    assert got[121]["perplexity"] > 1.2 * got[120]["perplexity"]


def test_the_threshold_is_the_quantile_of_the_held_out(spark):
    r = random.Random(6)
    trusted = [" ".join(r.choice(("ba", "noti", "resul", "menda")) for _ in range(r.randint(5, 60))) for _ in range(300)]
    got = judged(spark, trusted, [])
    held = spark.range(300).where(F.pmod(F.xxhash64("id", F.lit("held out")), F.lit(quality.HELD_OUT)) == 0).collect()
    own = sorted(got[x["id"]]["perplexity"] for x in held)
    assert 10 < len(own) < 100 and got[0]["threshold"] == pytest.approx(own[-1])


def test_distinct_grams_are_the_grams_in_order():
    r = random.Random(12)
    spell = lambda row: "".join(chr(int(c) - 1) for c in reversed(row) if c)
    for order in (2, 3, 5):
        for letters in ("ab ", "abcdefghij é漢\U0001f600\x00", [chr(c) for c in range(0x4E00, 0x9000)]):
            texts = ["".join(r.choice(letters) for _ in range(r.choice((0, 1, 2, 3, 4, 9, 200)))) for _ in range(30)]
            sums, rows, at, starts = quality.distinct_grams(texts, order)
            found = [spell(row) for row in rows]
            ends = [*starts.tolist()[1:], len(at)]
            assert [[found[k] for k in at[a:b]] for a, b in zip(starts.tolist(), ends, strict=True)] == [quality.grams(t, order) for t in texts]
            assert len(found) == len(set(found)) == len(set(sums.tolist()))
            keys, contexts = quality.suffix_keys(rows)
            assert all(keys[i, k - 1] == quality.gram_key(g[-k:]) and contexts[i, k - 1] == quality.gram_key(g[-k:-1]) for i, g in enumerate(found) for k in range(1, len(g) + 1))


def test_perplexities_thresholds_and_decisions_by_the_book(spark):
    """Whole documents against the model by the book, the threshold against the sorted held-out ones, the decision against both."""
    import math
    from collections import Counter

    from test_small_operators import kneser_ney

    r = random.Random(21)
    prose = lambda: " ".join("".join(r.choice("abé") for _ in range(r.randint(1, 3))) for _ in range(r.randint(1, 8)))
    docs = [(i, prose(), "aa") for i in range(60)] + [(100, "zzz  zz\tz", "aa"), (101, "ab", "bb"), (102, None, "aa"), (103, " ", None)]
    labels = [(i, 1, 0) for i in range(40)]
    schema = DOCS + ", keep int, perplexity string"
    frame = spark.createDataFrame([(*d, 0, "") for d in docs], schema)
    got = {x["doc_id"]: x for x in quality.classify(frame, spark.createDataFrame(labels, LABELS), order=3).collect()}
    held = {x["id"] for x in spark.range(40).where(F.pmod(F.xxhash64("id", F.lit("held out")), F.lit(quality.HELD_OUT)) == 0).collect()}
    told = Counter(" ".join(t.split()) for i, t, _ in docs[:40] if i not in held)
    chance = kneser_ney(told, 3)
    limits = []
    for doc, text, lang in docs:
        plain = " ".join((text or "").split())
        x = got[doc]
        if not plain:
            assert x["perplexity"] is None and x["keep"] and x["n_scored"] == 0
            continue
        nats = [-math.log(chance(g) if lang == "aa" else 1 / 0x110000) for g in quality.grams(plain, 3)]
        mean = sum(nats) / len(nats)
        assert x["perplexity"] == pytest.approx(math.exp(mean), rel=1e-4) and x["n_scored"] == len(plain) + 1
        if doc in held:
            limits.append(mean)
    limit = max(limits)
    for doc, text, lang in docs:
        plain = " ".join((text or "").split())
        if plain and lang == "aa":
            nats = [-math.log(chance(g)) for g in quality.grams(plain, 3)]
            mean = sum(nats) / len(nats)
            error = math.sqrt(max(sum(n * n for n in nats) / len(nats) - mean * mean, 0) / len(nats))
            assert got[doc]["keep"] == (mean - quality.ALLOWANCE * error <= limit + 1e-6) and got[doc]["threshold"] == pytest.approx(math.exp(limit), rel=1e-4)
    assert got[101]["keep"] and got[101]["threshold"] is None
    assert quality.classify(frame.where("false"), spark.createDataFrame(labels, LABELS)).count() == 0
    assert all(x["keep"] for x in quality.classify(frame, spark.createDataFrame([], LABELS)).collect())


def test_block_lists_keep_what_they_hold():
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(3)
    for n in (1, 2, 1000):
        keys = np.unique(r.integers(-(2**63), 2**63 - 1, n))
        assert np.array_equal(quality._unpacked_keys(pa.scalar(quality._packed_keys(keys))), keys)
        letters, counts = r.integers(0, 0x110001, (n, 5)).astype(np.uint32), r.integers(1, 1 << 40, n)
        back = quality._unpacked_counts(pa.scalar(quality._packed_counts(letters, counts)), 5)
        assert sorted(map(tuple, np.column_stack(back).tolist())) == sorted(map(tuple, np.column_stack((letters, counts)).tolist()))
        values = np.where(r.random((2, n)) < 0.4, np.nan, r.random((2, n))).astype("<f4")
        assert np.array_equal(quality._unpacked_values(quality._packed_values(values), n), values, equal_nan=True)
    assert len(quality._unpacked_keys(pa.scalar(quality._packed_keys(np.zeros(0, np.int64))))) == 0
