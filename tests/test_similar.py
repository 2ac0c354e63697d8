import random
import unicodedata

from annolake.operators import similar as S
from hypothesis import given, settings
from hypothesis import strategies as st


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def same(a, b, least):
    n = max(len(a), len(b))
    return not n or 1 - distance(a, b) / n >= least


def test_pairs_equal_all_pairs(spark):
    r = random.Random(2)
    base = ["".join(r.choice("abc ") for _ in range(r.randint(0, 24))) for _ in range(40)]

    def edited(s):
        s = list(s)
        for _ in range(r.randint(0, 6)):
            p = r.randint(0, len(s))
            s[p : p + r.randint(0, 1)] = r.choice(("", "x", "a"))
        return "".join(s)

    rows = [(g, t) for g in (1, 2) for b in base for t in (b, edited(b), edited(b))] + [(1, "é中文字"), (1, "é中文"), (None, "aaaa"), (None, "aaab")]
    frame = spark.createDataFrame(rows, "g int, t string")
    for least in (0.6, 0.85, 1.0, 0.5):
        found = [sorted(map(tuple, S.alike(frame, "g", "t", least, short).collect())) for short in ((32, 0, 12) if least == 0.6 else (32,))]
        assert all(f == found[0] and len(set(f)) == len(f) for f in found)
        got = set(found[0])
        texts = {g: sorted({t for h, t in rows if h == g and t}) for g in (1, 2)}
        want = {(g, a, b) for g, own in texts.items() for i, a in enumerate(own) for b in own[i + 1 :] if same(a, b, least)}
        assert got == want, (least, list(got ^ want)[:5])
    assert S.alike(spark.createDataFrame([], "g int, t string"), "g", "t").count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text("ab", min_size=1, max_size=14), st.text("ab", min_size=1, max_size=14), st.sampled_from([0.5, 0.6, 0.8]))
def test_a_segment_always_meets(a, b, least):
    """The window of places that the join looks at, against all pairs."""
    a, b = sorted((a, b), key=len)
    if not same(a, b, least):
        return
    n, m = len(a), len(b)
    d = int(m * (1 - least) + 1e-6)
    start = lambda i: i * (m // (d + 1)) + max(0, i - (d + 1 - m % (d + 1)))
    assert start(d + 1) == m
    met = any(
        b[start(i) : start(i + 1)] == a[p : p + start(i + 1) - start(i)]
        for i in range(d + 1)
        for p in range(max(0, start(i) - i, start(i) - (m - n) - (d - i)), min(n - (start(i + 1) - start(i)), start(i) + i, start(i) - (m - n) + (d - i)) + 1)
    )
    assert met


def fold(lines):
    def shape(t):
        for c in "‘’ʼ":
            t = t.replace(c, "'")
        return " ".join(unicodedata.normalize("NFC", t).split())

    kept = [(o, t) for o, t, g in sorted(lines) if g]
    for o, t, g in sorted(lines):
        if not g and not any(same(shape(t), shape(k), S.SAME_LINE) for _, k in kept):
            kept.append((o, t))
    return kept


def test_lines_in_order_equal_the_fold(spark):
    r = random.Random(8)
    words = ["tea", "ten", "teen", "tent", "bent", "best", "rest", "", "it’s", "it's", "é", "é", "  "]
    pages = {p: [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 4))), r.random() < 0.2) for i in range(r.randint(0, 25))] for p in range(25)}
    rows = [(p, *x) for p, own in pages.items() for x in own]
    frame = spark.createDataFrame(rows, "page_id int, ord int, text string, given boolean")
    got = S.without_repeats(frame).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, S.without_repeats(frame, short=S.SHORT).collect()))
    want = {(p, o, t) for p, own in pages.items() for o, t in fold(own)}
    assert {(x["page_id"], x["ord"], x["text"]) for x in got} == want and len(got) == len(want)


def test_a_chain_of_alike_lines_takes_turns(spark):
    """Each line is like its neighbours only: every second one stays, in as many rounds as it takes."""
    rows = [(0, i, "".join("x" if j < i else "y" for j in range(12))[:10] + "z" * 0, False) for i in range(0, 11, 4)]
    got = sorted(x["ord"] for x in S.without_repeats(spark.createDataFrame(rows, "page_id int, ord int, text string, given boolean")).collect())
    assert got == [o for o, _ in fold([(o, t, g) for _, o, t, g in rows])]
    assert S.without_repeats(spark.createDataFrame([], "page_id int, ord int, text string, given boolean")).count() == 0
