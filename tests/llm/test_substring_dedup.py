import random

from annolake.llm import substring_dedup as S


def brute(rows, length):
    seen, out = {}, []
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    where = lambda i, s: (rows[i][0] is None, rows[i][0] or 0, s)
    for i in order:
        data = (rows[i][1] or "").encode()
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            seen[w] = min(seen.get(w, where(i, s)), where(i, s))
    for i, (doc, text) in enumerate(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            if seen[data[s : s + length]] < where(i, s):
                gone[s : s + length] = b"\1" * length
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((doc, len(data), sum(gone), spans, kept))
    return out


def rows_of(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé ") for _ in range(r.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    common = [prose(n) for n in (12, 25, 40, 90)]
    rows = [(None, common[2] + prose(5)), (3, None), (4, ""), (5, "a" * 99), (6, "a" * 700), (7, "ab" * 300), (7, "ab" * 300), (8, "xyz" * 60 + common[1])]
    for i in range(60):
        parts = [prose(r.randint(0, 40))]
        for _ in range(r.randint(0, 3)):
            parts += [r.choice(common)[: r.randint(50, 700)], prose(r.randint(0, 8))]
        rows.append((10 + i, "".join(parts)))
    for i in range(12):  # near copies
        text = list(common[3])
        for _ in range(r.randint(0, 3)):
            text[r.randrange(len(text))] = "#"
        rows.append((100 + i, "".join(text)))
    return rows


def check(spark, rows, **kw):
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, b int, m string")
    got = sorted(((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept"])) for x in S.dedup_substrings(frame, **kw).collect()), key=repr)
    assert got == sorted(brute(rows, kw.get("length", 100)), key=repr)


def test_matches_brute_force(spark):
    for seed in (1, 2):
        check(spark, rows_of(seed))


def test_hot_keys_are_dealt_by_window_with_the_same_result(spark):
    check(spark, rows_of(3), hot=3)


def test_other_lengths_and_an_empty_table(spark):
    check(spark, rows_of(4), length=40)
    assert S.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_copies_are_told_by_digests_and_fetched_nowhere(spark):
    r = random.Random(6)
    text, other = ("".join(r.choice("abcdefgh ") for _ in range(3000)) for _ in range(2))
    scratch = S.Scratch(spark)
    made = S.dedup_substrings(spark.createDataFrame([(i, text) for i in range(30)] + [(30, other), (31, None)], "doc_id long, text string"), scratch=scratch)
    assert {x["doc_id"]: x["n_removed"] for x in made.collect()} == {0: 0, 30: 0, 31: 0} | dict.fromkeys(range(1, 30), 3000)
    at = {label: next(p for p in scratch.done if f"/{label}-" in p) for label in ("stretches", "solved")}
    stretches = spark.read.parquet(at["stretches"])
    assert 30 < stretches.count() < 200 and stretches.where("open").count() == 0 and spark.read.parquet(at["solved"]).count() == 0
    scratch.clear()


def test_rows_of_one_id_with_other_texts_are_told_apart(spark):
    r = random.Random(7)
    base = "".join(r.choice("abcdefgh ") for _ in range(400))
    check(spark, [(1, "z" * 120), (2, base[:90] + "!" + base[91:]), (3, base[:200]), (4, base + base[:50]), (5, base[100:])])
