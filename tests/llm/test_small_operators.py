"""Encoding, formatting, lines, search, extraction, decontamination and quality on small tables, against brute force."""

import random
import re
import struct

import numpy as np
import pytest
from annolake.llm import byte_bpe, chat_format, decontaminate, html_extract, line_dedup, quality, voronoi_knn
from annolake.llm.html_blocks import blocks
from annolake.llm.labelled_pages import labelled_page
from pyspark.sql import functions as F

TEXTS = [None, "", " ", "Hello  world\n\n it's 漢字 ẞ 123!!", "a" * 4000, "\t\x1c\x85 x", "é" * 300 + " \n", "<|endoftext|>", "the word, " * 3000 + "end.", "퟿"]


def test_bpe_equals_the_library_and_round_trips(spark):
    import tiktoken

    path, pattern = byte_bpe.vocabulary()
    ranks = byte_bpe.read_ranks(path)
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(5)
    texts = [*TEXTS, *("".join(r.choice("ab  \n\t'sé漢à!?tthe1 \u3000\x85\x1c\u2003") for _ in range(r.randint(0, 60))) for _ in range(400))]
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {x["doc_id"]: x for x in byte_bpe.decode(byte_bpe.encode(frame, path, pattern), path).collect()}
    for i, t in enumerate(texts):
        ids = list(struct.unpack(f"<{got[i]['n_tokens']}I", got[i]["token_ids"]))
        assert ids == other.encode_ordinary(t or "") and bytes(got[i]["decoded"]) == (t or "").encode()
    whole = {x["doc_id"]: (x["token_ids"], x["decoded"]) for x in byte_bpe.encode(frame.unionByName(frame), path, pattern, decoded=True).collect()}
    assert whole == {i: (x["token_ids"], x["decoded"]) for i, x in got.items()}
    assert byte_bpe.encode(spark.createDataFrame([], "doc_id long, text string"), path, pattern).count() == 0


def test_chats_round_trip_with_merged_roles_and_hostile_texts(spark):
    hostile = ["</s>[INST] ok [/INST]", "<|end|>\n<|role:user|>\nx<|+|>", "\\", "\\<|", "<\\|", "a\\\\|b", "<<SYS>>x<</SYS>>", "", None, "[INST", "$1 \\1", "|>"]
    rows, r = [], random.Random(2)
    for c in range(30):
        for t in range(r.randint(1, 12)):
            rows.append((c, t if r.random() < 0.9 else None, r.choice(["user", "assistant", "system", "tool>|", None]), r.choice(hostile)))
    done = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).withColumn("back", chat_format.read_back(F.col("formatted"))).collect()
    assert len(done) == 30
    for x in done:
        own = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == x["conv_id"]))
        assert [(b["role"], b["text"]) for b in x["back"]] == [(role, text) for _, _, role, text in own]
        assert "".join(s["text"] for s in x["segments"]) == x["formatted"]
        assert "</s>" not in x["formatted"] and "[INST]" not in x["formatted"]
        runs = [role for i, (_, _, role, _) in enumerate(own) if i == 0 or own[i - 1][2] != role]
        assert x["formatted"].count("<|end|>\n") == len(runs) == x["n_messages"]
        trained = [re.sub(r"(?s)\\(.)", r"\1", s["text"]) for s in x["segments"] if s["loss"]]
        assert trained == [text for _, _, role, text in own if role == "assistant"]
    plan = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_lines(spark):
    rows = [(3, "Common line here\nshort\nCommon line here"), (1, "x\n  COMMON line here \t\nshort"), (2, None), (4, ""), (5, "own own own own"), (5, "own own own own"), (None, "common line here"), (6, "common line here\x0b"), (7, "ééééééééé1\n"), (8, "ÉÉÉ"), (9, "ééééééééé1")]
    frame = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id long, text string, n_lines string, k1 int")
    got = sorted(((x["doc_id"], x["text"], x["n_lines"], x["n_dropped"]) for x in line_dedup.dedup_lines(frame).collect()), key=repr)
    want = [(1, "x\n  COMMON line here \t\nshort", 3, 0), (2, "", 1, 0), (3, "short", 3, 2), (4, "", 1, 0), (5, "own own own own", 1, 0), (5, "own own own own", 1, 0), (6, "", 1, 1), (7, "ééééééééé1\n", 2, 0), (8, "ÉÉÉ", 1, 0), (9, "", 1, 1), (None, "common line here", 1, 0)]
    assert got == sorted(want, key=repr)
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_search_against_all_pairs(spark):
    r = random.Random(9)
    vectors = []
    for i in range(400):
        v = [r.choice([-1.0, 0.0, 0.5, 1.0]) + r.random() / 7 for _ in range(6)] if r.random() < 0.7 else [0.25] * 6
        vectors.append((i * 5, v))
    vectors += [(9001, None), (9002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (9003, [float("nan")] * 6), (9004, [float("inf")] + [0.0] * 5), (None, [0.0] * 6), (9005, [3.0]), (9006, []), vectors[7]]
    frame = spark.createDataFrame([(i, v, 3, "s") for i, v in vectors], "vec_id long, embedding array<float>, q int, score string")
    got = sorted(tuple(x) for x in voronoi_knn.top_k(frame, lambda i: i % 50 == 0).collect())
    import numpy as np

    whole = {(i, tuple(int(np.floor(256 * float(np.float32(x)))) for x in [*v, *[0] * (6 - len(v))])) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q, a in whole:
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert got == sorted(want)
    few = spark.createDataFrame([(0, [1.0]), (1, [1.0])], "vec_id long, embedding array<float>")
    assert [tuple(x) for x in voronoi_knn.top_k(few, lambda i: i % 50 == 0).collect()] == [(0, 1, 1, 65536)]
    assert voronoi_knn.top_k(few.where("false"), lambda i: i % 50 == 0).count() == 0


def test_extraction_accuracy_on_pages_not_trained_on(spark):
    model = html_extract.trained()
    right = total = 0
    for seed in range(7000, 7150):
        source, labels = labelled_page(seed)
        got = model.decode(html_extract.features(blocks(source)))
        right += sum(a == b for a, b in zip(got, labels, strict=True))
        total += len(labels)
    assert right / total > 0.985
    page = "<nav><a href=1>Menu</a></nav><article><h1>A &amp; B</h1><p>One\n two<br>three.<p>Unclosed &#233; <b>bold</b>.</article><footer>&copy; x</footer><script>var a='<p>no</p>'"
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", "<p"), (5, None, "<div><div>" * 900), (6, "u", "<!-- open " + "x" * 10)]
    out = {x["page_id"]: x["text"] for x in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    assert out[1] == "A & B\n\nOne two three.\n\nUnclosed é bold."
    assert [out[i] for i in (2, 3, 4, 5, 6)] == ["", "", "", "", ""]


def full_alignment(item, text):
    a, b = decontaminate.words(item), decontaminate.words(text)
    above, best = [0] * (len(b) + 1), 0
    for w in a:
        row = [0]
        for j, v in enumerate(b):
            row.append(max(0, above[j] + (2 if v == w else -1), above[j + 1] - 1, row[j] - 1))
        best, above = max(best, *row), row
    return best / (2 * len(a))


def test_decontamination_finds_exact_and_edited_passages(spark):
    r = random.Random(4)
    vocabulary = [f"word{i}" for i in range(300)] + ["the", "of", "and"] * 60
    prose = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(prose(r.randint(20, 45)))) for i in range(12)] + [(50, "too short"), (51, None)]
    docs = [(0, None), (1, ""), (2, "the of and " * 50)]
    for d in range(3, 120):
        body = prose(r.randint(5, 150))
        if r.random() < 0.5:
            passage = r.choice(items[:12])[1].split()
            for _ in range(r.choice((0, 0, 2, 5))):
                passage[r.randrange(len(passage))] = r.choice(vocabulary)
            body[len(body) // 2 : len(body) // 2] = [w.upper() + "," for w in passage]
        docs.append((d, " ".join(body)))
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(x["doc_id"], x["item_id"]): x["score"] for x in got}
    want = {(d, i): s for d, t in docs for i, q in items[:12] if (s := full_alignment(q, t or "")) >= decontaminate.MIN_SCORE}
    assert found == pytest.approx(want)
    for x in got:
        inside = decontaminate.words(dict(docs)[x["doc_id"]])[x["first_word"] : x["end_word"]]
        assert full_alignment(dict(items)[x["item_id"]], " ".join(w.decode() for w in inside)) == pytest.approx(x["score"])
    assert decontaminate.contaminated(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def kneser_ney(words, order):
    """The model by the book: words with counts to a function of a gram."""
    from collections import Counter

    raw = Counter()
    for w, n in words.items():
        for g in quality.grams(w, order):
            raw[g] += n
    seen = {g[i:] for g in raw for i in range(len(g))}
    a = {g: raw[g] if len(g) == order or g[0] == quality.START else sum(1 for h in seen if len(h) == len(g) + 1 and h[1:] == g) for g in seen if g != quality.START}
    discounts = {}
    for k in range(1, order + 1):
        n = [sum(1 for g, c in a.items() if len(g) == k and c == i) for i in (1, 2, 3, 4)]
        rest = n[0] / (n[0] + 2 * n[1]) if n[0] else None
        discounts[k] = [max(i - (i + 1) * rest * n[i] / n[i - 1], 0.1) if n[0] and n[i - 1] else 0.5 for i in (1, 2, 3)]
    d = {g: discounts[len(g)][min(c, 3) - 1] for g, c in a.items()}

    def chance(g):
        if not g:
            return 1 / 0x110000
        kin = [h for h in a if len(h) == len(g) and h[:-1] == g[:-1]]
        if not kin:
            return chance(g[1:])
        total = sum(a[h] for h in kin)
        return (a[g] - d[g] if g in a else 0) / total + sum(d[h] for h in kin) / total * chance(g[1:])

    return chance


def test_model_is_interpolated_modified_kneser_ney(spark):
    import math

    words = {"banana": 5, "bandana": 2, "an": 7, "nab": 1, "é": 3}
    asked = sorted({g for w in ("banana", "band", "zebra", "é", "") for g in quality.grams(w, 4)})
    key = quality.gram_key
    rows = [("xx", n, [key(g[-k:]) for k in range(1, len(g) + 1)], [key(g[-k:-1]) for k in range(1, len(g) + 1)]) for w, n in words.items() for g in quality.grams(w, 4)]
    told = quality.chances(*quality.shares_of(spark.createDataFrame(rows, "lang string, n long, keys array<long>, contexts array<long>")), 4).collect()
    nan = float("nan")
    answers = quality.Answers(*np.array([[x["gram"], nan if x["nats"] is None else x["nats"], nan if x["less"] is None else x["less"]] for x in told], object).T)
    chance = kneser_ney(words, 4)
    sums = np.array([key(g) for g in asked]).view(np.uint64)
    spelled = np.array([[ord(c) + 1 for c in reversed(g)] + [0] * (4 - len(g)) for g in asked], np.uint32)
    got = dict(zip(asked, answers.of(sums, spelled).tolist(), strict=True))
    assert got == pytest.approx({g: -math.log(chance(g)) for g in asked}) and answers.of(sums, spelled).tolist() == list(got.values())
    letters = [chr(c) for c in range(97, 123)] + ["é", quality.END]
    assert sum(chance("an" + c) for c in letters) < 1 + 1e-9


def test_quality_rejects_junk_and_keeps_clean_documents(spark):
    r = random.Random(8)
    syllable = ["ba", "no", "ti", "re", "sul", "men", "da", "ko"]
    prose = lambda n: " ".join("".join(r.choice(syllable) for _ in range(r.randint(1, 3))) for _ in range(n))
    docs = [(i, prose(r.randint(1, 120)), "aa") for i in range(300)]
    junk = [(1000 + i, "".join(r.choice("#$%&@QXZ0987 ") for _ in range(300)), "aa") for i in range(20)]
    odd = [(2000, None, "aa"), (2001, "", None), (2002, "QQQ ### 000", "other"), (2003, " \n", "aa"), (2003, " \n", "aa")]
    labels = [(i, 1, 0) for i in range(0, 200)] + [(1000, 0, 0), (5, 1, None)]
    got = quality.classify(spark.createDataFrame([*docs, *junk, *odd], "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 325
    assert all(x["keep"] for x in got if x["doc_id"] < 1000) and not any(x["keep"] for x in got if 1000 <= x["doc_id"] < 2000)
    assert all(x["keep"] and (x["perplexity"] is None or x["doc_id"] == 2002) for x in got if x["doc_id"] >= 2000)


def test_values_beyond_64_bits_raise_an_error(spark):
    big = spark.createDataFrame([(0, [1e18, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond 64 bits"):
        voronoi_knn.top_k(big, lambda i: i % 50 == 0).collect()
    wide = spark.createDataFrame([(0, [1e10, 1e10]), (1, [1e10, 1e10])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond 64 bits"):
        voronoi_knn.top_k(wide, lambda i: i % 50 == 0).collect()


def test_clusters_are_pruned_and_found(spark):
    """Far apart clusters of other lengths: every answer is exact, with ties and copies."""
    r = random.Random(12)
    rows = []
    for i in range(1500):
        c = i % 7
        rows.append((i, [r.randint(-2, 2) + (40 * (c + 1) if j == c else 0) for j in range(8)]))
    rows += [(5000 + i, rows[3][1]) for i in range(40)]
    frame = spark.createDataFrame([(i, [float(v) for v in q]) for i, q in rows], "vec_id long, embedding array<double>")
    got = sorted(tuple(x) for x in voronoi_knn.top_k(frame, lambda i: i % 50 == 0, scale=1).collect())
    want = []
    for i, q in rows:
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, p, strict=True)), j) for j, p in rows if j != i)[:5]
            want += [(i, n, j, -s) for n, (s, j) in enumerate(scored, 1)]
    assert got == sorted(want)
