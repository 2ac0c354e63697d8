"""Very long texts, and odd tables, of operators whose small tests leave them out."""

import base64
import hashlib
import random
from pathlib import Path

import tiktoken
from annolake.llm import byte_bpe, chat_format, jaccard_join, line_dedup, substring_dedup
from pyspark.sql import functions as F


def test_encoding_of_a_text_longer_than_a_batch(spark):
    r = random.Random(1)
    words = ["the", " of", " naïve", "\n\n", " 漢字", " 12345", "!!", " tokenization", "\t"]
    long = "".join(r.choice(words) for _ in range(1_200_000))
    assert len(long.encode()) > 5_000_000
    path, pattern = byte_bpe.vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
    whole = tiktoken.Encoding("whole", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rows = [(1, long), (2, "short"), (3, long[:100])]
    got = {x["doc_id"]: x for x in byte_bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), path, pattern, decoded=True).collect()}
    for i, text in rows:
        ids = whole.encode_ordinary(text)
        assert got[i]["n_tokens"] == len(ids) and bytes(got[i]["token_ids"]) == b"".join(n.to_bytes(4, "little") for n in ids) and bytes(got[i]["decoded"]) == text.encode()


def test_chats_of_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string, segments int, formatted string, n_messages string"
    assert chat_format.format_chats(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, 1, "user", "a"), (None, 0, "assistant", "b"), (1, None, "user", "first"), (1, 5, None, None), (1, 5, None, None)]
    done = chat_format.format_chats(spark.createDataFrame([(*x, 1, "x", "y") for x in rows], schema)).withColumn("back", chat_format.read_back(F.col("formatted"))).collect()
    got = {x["conv_id"]: [(t["role"], t["text"]) for t in x["back"]] for x in done}
    assert got == {None: [("assistant", "b"), ("user", "a")], 1: [("user", "first"), ("", ""), ("", "")]}


def test_a_very_long_conversation(spark):
    r = random.Random(2)
    turns = [(7, i, r.choice(("user", "assistant", "system")), r.choice(("\\", "<|end|>\n", "[INST]", "word ")) * r.randint(0, 60)) for i in range(4000)] + [(7, 9000, "user", "<|+|>\\" * 100_000)]
    done = chat_format.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).withColumn("back", chat_format.read_back(F.col("formatted"))).first()
    assert [(t["role"], t["text"]) for t in done["back"]] == [(role, text) for _, _, role, text in turns]


def test_lines_of_a_very_long_text(spark):
    lines = [f"this is line {i % 70_000} of many" for i in range(140_000)]
    docs = [(2, "\n".join(lines)), (1, "\n".join(lines[:10])), (3, "x" * 2_000_000)]
    got = {x["doc_id"]: x for x in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    kept = [x for x in lines if x not in set(lines[:10])]
    assert (got[1]["n_dropped"], got[3]["n_dropped"], got[2]["n_dropped"]) == (0, 0, 20) and got[2]["text"] == "\n".join(kept) and got[3]["text"] == docs[2][1]


def test_near_copies_of_very_long_texts(spark):
    words = [f"w{i * 7919 % 1_000_003}" for i in range(300_000)]
    near = words[:1000] + ["changed"] + words[1001:]
    far = [w if i % 9 else f"v{i}" for i, w in enumerate(words)]
    docs = [(5, " ".join(words)), (6, " ".join(near)), (7, " ".join(far)), (8, "short text of six words only"), (9, None)]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {5: (299_996, 5), 6: (299_996, 5), 7: (299_996, 7), 8: (2, 8), 9: (0, 9)}


def test_repeats_in_a_very_long_text(spark):
    r = random.Random(3)
    noise = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    a, b, c = noise(600_000), noise(150), noise(400_000)
    docs = [(1, a + b + c + b + "end"), (2, b)]
    got = {x["doc_id"]: x for x in substring_dedup.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert (got[1]["n_removed"], got[1]["n_spans"], got[2]["n_removed"]) == (150, 1, 150)
    assert hashlib.sha256(bytes(got[1]["kept"])).digest() == hashlib.sha256((a + b + c + "end").encode()).digest() and bytes(got[2]["kept"]) == b""
