import unicodedata

import pytest
from annolake.functions import text as T
from annolake.functions.python import fitting_alignment, nfc
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)

    def run(column):
        return one.select(column.alias("v")).first()["v"]

    return run


def arr(*xs):
    return F.array(*(F.lit(x) for x in xs)) if xs else F.array().cast("array<string>")


def test_white_space_and_markup(value):
    assert value(T.one_line(F.lit(" a  ﻿b  c\n"))) == "a b c"
    assert value(T.heading_title(F.lit("​◆ ★ 1  Intro\u0007"))) in ("1 Intro", "1 Intro")
    assert value(T.markup_text(F.lit("<style>p{}</style>A&#8217;s &amp; &#x1F600; &unknown; <b>x</b>"))) == "A’s & 😀 &unknown; x"
    assert value(T.decode_references(F.lit("&#xD800;&#0;&lt;"))) == "&#xD800;&#0;<"
    assert value(T.heading_number(F.lit("1.2 Intro"), F.lit("Intro"))) == "1.2"
    assert value(T.heading_number(F.lit("Intro"), F.lit("Intro"))) is None


def test_long_titles_and_numbers_need_no_deep_stack(value):
    assert value(T.heading_title(F.concat(F.repeat(F.lit("◆ "), 100_000), F.lit("Intro")))) == "Intro"
    many = F.concat(F.repeat(F.lit("1."), 100_000), F.lit("1"))
    assert value(T.heading_number(F.concat(many, F.lit(" Intro")), F.lit("Intro"))) == "1." * 100_000 + "1"
    assert [value(T.heading_number(F.lit(f"{n} Intro"), F.lit("Intro"))) for n in ("1.", "1..2", ".1", "A.", "AB", "1.2.")] == ["1.", None, None, "A.", None, "1.2."]


def test_joined_lines(value):
    got = value(T.joined_lines(arr("exam-", "ple one", "", "two-", "3")))
    assert got["text"] == "example one two- 3"
    assert [got["text"][s["start"] : s["end"]] for s in got["spans"]] == ["exam", "ple one", "", "two-", "3"]
    assert value(T.dehyphenated(arr("exam-", " ple one", "", "two-", "3"))) == "example one two- 3"
    assert value(T.joined_lines(arr()))["text"] == ""


def test_sentences_and_words(value):
    text = "See Fig. 2 for it. “Then” more? Yes"
    s = value(T.sentence_around(F.lit(text), F.lit(12), F.lit(14)))
    assert text[s["start"] : s["end"]] == "See Fig. 2 for it."
    s = value(T.sentence_around(F.lit(text), F.lit(20), F.lit(22)))
    assert text[s["start"] : s["end"]] == "“Then” more?"
    w = value(T.whole_words(F.lit("one two three"), F.lit(5), F.lit(8)))
    assert (w["start"], w["end"]) == (4, 7)
    w = value(T.whole_words(F.lit("one   two"), F.lit(4), F.lit(5)))
    assert w["start"] == w["end"]


def test_located_ignores_white_space(value):
    text = "budget_tokens einen 400-Fehler und budget_tokens einen"
    near = value(T.located(F.lit(text), F.lit("budget_tokenseinen"), F.lit(30)))
    assert text[near["start"] : near["end"]] == "budget_tokens einen" and near["start"] == 35
    assert value(T.located(F.lit("a b"), F.lit("zz"), F.lit(0))) is None


def test_hashes_and_names(value):
    assert value(T.fnv1a(F.lit("hello"))) == "4f9f2cab"
    assert value(T.fnv1a(F.lit(""))) == "811c9dc5"
    assert value(T.file_name(F.lit('a/b:c*"?.. '), nfc)) == "a-b-c---"
    assert value(T.file_name(F.lit("é"), nfc)) == unicodedata.normalize("NFC", "é")
    assert [value(T.file_name(F.lit(x))) for x in ("...", "con", "COM1.txt", "x" * 250)] == ["-", "con-", "COM1.txt-", "x" * 200]
    assert value(T.is_in_folder(F.lit("a/b/c.md"), F.lit("a/b//"))) and not value(T.is_in_folder(F.lit("a/b/c.md"), F.lit("a")))
    assert value(T.is_in_folder(F.lit("c.md"), F.lit("")))
    assert [value(T.attachments_folder(F.lit(x))) for x in ("/x/y/", "a/../b", " ")] == ["x/y", "attachments", "attachments"]
    assert value(T.remapped_path(F.lit("folder"), F.lit("Notes/a.md"), F.lit("Notes"), F.lit("Archive"))) == "Archive/a.md"
    assert value(T.remapped_path(F.lit("folder"), F.lit("Notes2/a.md"), F.lit("Notes"), F.lit("Archive"))) is None and value(T.remapped_path(F.lit("folder"), F.lit("a"), F.lit("a"), F.lit("b"))) is None
    assert value(T.remapped_path(F.lit("file"), F.lit("a"), F.lit("a"), F.lit("b"))) == "b" and value(T.remapped_path(F.lit("file"), F.lit("a/x"), F.lit("a"), F.lit("b"))) is None


def test_note_parts(value):
    fence = T.FENCE_END
    note = f"---\na: 1\n---\nblock ![[x/y.pdf]]\n\n## Transcript\nsaid\nmore\n{fence}\nmine"
    assert value(T.managed_block(F.lit(note))).startswith("block") and value(T.managed_block(F.lit(note))).endswith(fence)
    assert value(T.free_area(F.lit(note))) == "\nmine"
    assert value(T.transcript_of(F.lit(note))) == "said\nmore"
    assert value(T.embed_of(F.lit(note))) == "x/y.pdf" and value(T.embed_of(F.lit("none"))) is None
    assert value(T.managed_block(F.lit("no fence"))) is None


def test_marks_and_regions(value):
    s = "the quick brown fox jumps over the lazy dog again"
    assert value(T.marked_sentence(F.lit(s), arr("quick", "brown", "lazy"))) == "the ==quick brown== fox jumps over the ==lazy== dog again"
    assert value(T.marked_sentence(F.lit("all of it"), arr("all of it"))) == "all of it"
    assert value(T.marked_sentence(F.lit(s), arr("missing", ""))) == s
    assert value(T.escaped(F.lit("> a <b> & c"))) == "\\> a \\<b> \\& c"
    assert value(T.anchor_title(F.lit("one two  three four five"))) == "at »one two three four…«"
    r = value(T.region(F.lit("page: 3\nrect: 384 246 140 24")))
    assert (r["page"], r["x"], r["height"]) == (3, 384.0, 24.0)
    assert [value(T.region(F.lit(x))) for x in ("page: 0\nrect: 1 1 1 1", "page: 1\nrect: 1 1 1", "page 1", "page: 1\nrect: 1 1 0 1")] == [None] * 4
    block = T.region_block(F.struct(F.lit(2).alias("page"), F.lit(1.5).alias("x"), F.lit(-2.5).alias("y"), F.lit(3.4).alias("width"), F.lit(4.0).alias("height")))
    assert "rect: 2 -2 3 4" in value(block)


def test_folding_budgets_and_similarity(value):
    assert value(T.folded(F.lit("‘A’ – “B” C"))) == "'a' - \"b\" c"
    assert value(T.folded(F.lit("İ"))) is None
    assert [value(T.error_budget(F.lit(n))) for n in (1, 20, 100)] == [2, 3, 15]
    assert value(T.anchor_words(F.lit("the longest words here longest wordy"))) == ["longest", "words", "wordy"]
    assert value(T.is_same_line(F.lit("hello world"), F.lit("hallo world"))) and not value(T.is_same_line(F.lit("abc"), F.lit("xyz")))
    assert value(T.is_same_line(F.lit(" "), F.lit(""))) and value(T.line_shape(F.lit(" a  \n“b” – ‘c’ "))) == 'a "b" - \'c\''


def test_formatters(value):
    assert [value(T.byte_size(F.lit(n).cast("double"))) for n in (5.5e9, 12_400_000)] == ["5.5 GB", "12 MB"]
    told = {10: "a minute", 89: "a minute", 90: "5 minutes", 1000: "15 minutes", 3300: "60 minutes", 5399: "90 minutes", 5400: "1.5 hours", 7200: "2 hours", 8200: "2.5 hours"}
    assert {s: value(T.duration(F.lit(float(s)))) for s in told} == {s: f"about {t}" for s, t in told.items()}
    given = {
        "Here is the transcript:\n\nline": "line", "here are the transcription\n```md\nline\n```": "line", "Here is the agenda:\nx": "Here is the agenda:\nx", "Sure, the agenda:\nx": "Sure, the agenda:\nx",
        "```python\nx = 1\n```": "```python\nx = 1\n```", "```\na\n\n  b\n  ```": "a\n\n  b", "```markdown\n```": "", "before\n```\nx\n```": "before\n```\nx\n```", "Here is the transcript.": "", "```": "```",
    }
    assert {t: value(T.sanitized_transcript(F.lit(t))) for t in given} == given
    errors = [("TypeError: Failed to fetch", "sync", "offline"), ("HTTP 401", "sync", "rejected"), ("HTTP 401", "connect", "code"), ("EAI_AGAIN", "connect", "offline"), ("code 4011", "sync", "unexpected"), ("Invalid-Token", "sync", "rejected")]
    assert [value(T.error_class(F.lit(m), F.lit(c))) for m, c, _ in errors] == [e for *_, e in errors]
    assert value(T.mapping_fingerprint(F.create_map(F.lit("b"), F.lit("x"), F.lit("a"), F.lit("y")))) == '3:[["a","y"],["b","x"]]'
    lines = lambda text: [tuple(x) for x in value(T.wrapped(F.lit(text), 6.0, {"a": 1.0}, 1.0))]
    assert lines("aa bb cc/dd") == [("aa bb", 6), ("cc/dd", 5)] and lines("") == [("", 0)] and lines("abcdefgh/ijk lm") == [("abcdefgh/", 9), ("ijk lm", 6)]
    assert lines("aaaaaa   bb") == [("aaaaaa", 9), ("bb", 2)] and value(T.break_chunks(F.lit("a  b/c"))) == ["a", " ", " ", "b/", "c"]
    fixed = {"/C cs\nscn": "/C cs\n0 0 0 scn", "q scn": "q 0 0 0 scn", "SCN f": "0 0 0 SCN f", "1 0 0 scn": None, "/P0 scn": None, "xscn scnx": None, "scn 1 scn": "0 0 0 scn 1 scn"}
    assert {c: value(T.paint_operands(F.lit(c))) for c in fixed} == fixed


def test_fitting_alignment_is_a_whole_text_in_a_free_stretch():
    assert fitting_alignment("oPer", "an offer")[0] == 2
    assert fitting_alignment("abc", "xxabcxx")[:3] == (0, 2, 5)
    assert fitting_alignment("", "abc")[:3] == (0, 0, 0)
    assert fitting_alignment("abc", "")[:3] == (3, 0, 0)
