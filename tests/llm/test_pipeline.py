import random
import re
import struct

import corpus_pipeline
from annolake.llm import byte_bpe, quality
from test_jaccard_join import brute as near_groups
from test_small_operators import full_alignment


def corpus(seed):
    r = random.Random(seed)
    syllable = ["ba", "no", "ti", "re", "sul", "men", "da", "ko", "el", "fa"]
    words = ["".join(r.choice(syllable) for _ in range(r.randint(1, 4))) for _ in range(500)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, prose(30)) for i in range(4)]
    footer = prose(12)
    docs = []
    for i in range(160):
        text = "\n".join(prose(r.randint(5, 40)) for _ in range(r.randint(1, 4)))
        if i % 6 == 0:
            text += "\n" + footer
        if i % 23 == 0:
            passage = r.choice(items)[1].split()
            passage[7] = "edited"
            text += "\n" + " ".join(passage)
        docs.append(text)
    for i in range(0, 60, 3):  # near copies
        w = docs[i].split(" ")
        w[len(w) // 2] = "changed"
        docs.append(" ".join(w))
    docs += [docs[3], docs[4], "footer", None, ""]
    docs += ["%$# @@@ 12 ### &&& QQQ" * 12 for _ in range(4)]
    order = list(range(len(docs)))
    r.shuffle(order)
    return [(i, docs[k]) for i, k in enumerate(order)], items


def test_stages_against_brute_force(spark, tmp_path):
    docs, items = corpus(11)
    where = str(tmp_path / "sf")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(d, t, "aa", "s", len(t or "")) for d, t in docs], schema).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    labels = [(d, 1, 0) for d, t in docs if t and "###" not in t and d % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")

    frame = spark.read.parquet(f"{where}/documents.parquet")
    outputs = []
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, where)
        frame.write.parquet(f"{where}/{name}")
        frame = spark.read.parquet(f"{where}/{name}")
        outputs.append(frame)
    for f in outputs[:-1]:
        assert f.columns == list(corpus_pipeline.COLUMNS)

    # quality: the classifier's own decisions, and the junk is gone
    judged = quality.classify(spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet"))
    kept = {x["doc_id"] for x in judged.collect() if x["keep"]}
    now = {d: t for d, t in docs if d in kept}
    assert {x["doc_id"]: x["text"] for x in outputs[0].collect()} == now
    assert kept == {d for d, t in docs if not t or "###" not in t}

    # lines
    keys = {}
    for d, t in now.items():
        for line in (t or "").split("\n"):
            k = line.strip(" \t\n\x0b\x0c\r").lower()
            if len(k) >= 10:
                keys.setdefault(k, set()).add(d)
    cut = {}
    for d, t in now.items():
        lines = [x for x in (t or "").split("\n") if not (len(s := keys.get(x.strip().lower(), set())) > 1 and min(s) != d)]
        if lines and "".join(lines).strip(" ") or not (t or "").strip(" "):
            cut[d] = "\n".join(lines)
    got = {x["doc_id"]: (x["text"], x["n_chars"]) for x in outputs[1].collect()}
    assert got == {d: (t, len(t)) for d, t in cut.items()}

    # near copies
    groups = {d: c for d, _, c in near_groups(sorted(cut.items()))}
    single = {d: t for d, t in cut.items() if groups[d] == d}
    assert {x["doc_id"]: x["text"] for x in outputs[2].collect()} == single and len(single) < len(cut)

    # leaks
    clean = {d: t for d, t in single.items() if not any(full_alignment(q, t) >= 0.5 for _, q in items)}
    assert {x["doc_id"]: x["text"] for x in outputs[3].collect()} == clean and len(clean) < len(single)

    # encoding
    tokens = byte_bpe.tokens(byte_bpe.vocabulary()[0]).to_pylist()
    rows = outputs[4].collect()
    assert {x["doc_id"]: b"".join(tokens[i] for i in struct.unpack(f"<{x['n_tokens']}I", x["token_ids"])).decode() for x in rows} == clean
    assert all(x["exact"] for x in rows)

    done = corpus_pipeline.run(spark, where)
    assert sorted((x["doc_id"], x["n_tokens"]) for x in done.collect()) == sorted((x["doc_id"], x["n_tokens"]) for x in rows)


def test_five_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "repeated_lines", "near_copies", "leaks", "token_ids"]
    assert re.match(r"[a-z_]+", corpus_pipeline.STAGES[0][0])
