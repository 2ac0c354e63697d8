import random
import re

from annolake.llm import license_scan as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = WORD.findall(low)
    at, labels = [], set()
    for phrase, label in L.BASE:
        parts = phrase.split()
        here = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
        at += here
        labels |= {label} if here else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


CASES = [
    None, "", "no words matter", "GNU General\n\nPublic-License, version 2 and MIT\tlicense", "cc by cc by-cc_by ccby ucc by", "Mit License mit license", "the apache license é-apache licenseé",
    "Licensed under the Apache License, Version 2.0 (the \"License\")", "SPDX-License-Identifier: MIT", "cc\x00by", "К cc by К", "gnu general public license v3", "(c) only",
]


def test_base_columns_match_brute_force(spark):
    r = random.Random(3)
    pieces = ["gnu", "general", "public", "license", "Apache", "cc", "BY", "mit", "MIT license", "x", "é", "-", "\n", ". ", "licensed under the", "version 2.0"]
    rows = [*CASES, *(" ".join(r.choice(pieces) for _ in range(r.randint(0, 60))) for _ in range(300)), "mit license " * 3000]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {x["doc_id"]: x for x in L.scan_licenses(frame).collect()}
    assert len(got) == len(rows)
    for i, text in enumerate(rows):
        x = got[i]
        assert (x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["base_labels"]) == brute(text), repr(text)
        assert set(filter(None, x["base_labels"].split(","))) <= set(x["labels"].split(","))
        assert 0 <= x["score"] <= 1


def test_contained_detections_are_suppressed(spark):
    texts = ["Licensed under the GNU Lesser General Public License version 2.1.", "SPDX-License-Identifier: Apache-2.0", "Released under the MIT license"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["labels"].split(",") for x in L.scan_licenses(frame).collect()}
    assert "lgpl-2.1" in got[0] and "lgpl" not in got[0]
    assert got[1] == ["apache-2.0"]
    assert got[2] == ["mit"]


def test_rules_are_reachable_and_distinct():
    rules = L.rules()
    assert len(rules) > 200 and len(set(rules)) == len(rules)
    assert all(key == key.lower() for _, _, key, _, _ in rules)


def test_tables_without_rows_and_repeated_rows(spark):
    schema = "doc_id long, text string, labels int, n_words string"
    assert L.scan_licenses(spark.createDataFrame([], schema)).count() == 0
    twice = L.scan_licenses(spark.createDataFrame([(1, "mit license", 0, ""), (1, "mit license", 0, ""), (None, "cc by", 1, "")], schema)).collect()
    assert sorted((str(x["doc_id"]), x["n_base"]) for x in twice) == [("1", 1), ("1", 1), ("None", 1)]


def test_no_python_in_the_plan(spark):
    plan = L.scan_licenses(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_no_repeated_part_needs_a_deep_stack(spark):
    """Each repeatable part 100 000 times: the matcher must not go one level deeper each time."""
    n = 100_000
    texts = [
        "copyright 2000" + ", 2001" * n + " Someone", "copyright 2000" + "-01" * n + " x", "gnu" + " " * n + "general public license", "mit" + "-" * n + "license", "license" + ":" * n + " mit",
        "licensed" + "\n" * n + "under the mit license", "é" * n + " mit license", "mit license " * n, "cc" + "+ " * n + "by", "reserved font name " + "x" * n, "unauthorized copying of this file" + " " * n + "is strictly prohibited",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: (x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["base_labels"]) for x in L.scan_licenses(frame).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_every_repeat_in_the_rules_is_of_a_single_class():
    """Unbounded repeats of a group are what overflows; bounded ones of up to one are fine."""
    assert not [p for _, p, _, _, _ in L.rules() if re.search(r"(?<!\\)\)(?:[*+]|\{\d+,)", p)]


def test_years_of_a_notice(spark):
    texts = ["Copyright 2001 X", "copyright 2001, 2003-05 Someone", "(c) 1999-2004 y", "© 2020", "copyright 1899 x"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["labels"] for x in L.scan_licenses(frame).collect()}
    assert got == {0: "copyright", 1: "copyright", 2: "copyright", 3: "", 4: ""}
