import pandas as pd
import pytest
from annolake.operators import clusters, fuzzy, incremental, lines, nearest, rendering, routing, sequences
from annolake.streaming import sync
from pyspark.sql import functions as F

ITEM = ["text", "x", "y", "width", "height"]


def page(*items):
    return lines.page_lines(pd.DataFrame(items, columns=ITEM))


def test_lines_by_baseline():
    got = page(("world", 90, 700, 30, 10), ("second", 50, 686, 40, 10), ("Hello", 50, 700, 30, 10))
    assert got.text.tolist() == ["Hello world", "second"]
    assert page(("a", 0, 700, 5, 10), ("b", 20, 703, 5, 10)).text.tolist() == ["a b"] or page(("a", 0, 700, 5, 10), ("b", 20, 703, 5, 10)).text.tolist() == ["b a"]
    assert len(page(("a", 0, 700, 5, 10), ("b", 20, 703, 5, 10))) == 1
    assert page(("Introducing", 40, 700, 90, 24), ("Introducing", 39, 700, 90, 24)).text.tolist() == ["Introducing"]
    assert page(("the", 50, 700, 15, 10), ("the", 70, 700, 15, 10)).text.tolist() == ["the the"]
    assert page(("  ", 0, 700, 5, 10)).empty


def test_columns_are_read_one_after_the_other():
    items = [("Title across the page", 0, 800, 300, 10)]
    for k in range(5):
        items += [(f"l{k}", 0, 700 - 12 * k, 130, 10), (f"r{k}", 170, 700 - 12 * k, 130, 10)]
    assert page(*items).text.tolist() == ["Title across the page", *(f"l{k}" for k in range(5)), *(f"r{k}" for k in range(5))]


def test_measures_and_quotes():
    frame = pd.DataFrame({"text": ["Big", "First sentence starts", "and ends here. Next", "one is short."], "x": 0.0, "y": [100.0, 80.0, 70.0, 60.0], "width": 100.0, "height": [20.0, 10.0, 10.0, 10.4]})
    assert lines.body_size(frame) == 10.0
    assert lines.line_spacing(frame) == 10.0
    sentence, marks = lines.quote(frame, [(1, 6, 14)], 10.0)
    assert sentence == "First sentence starts and ends here." and marks == ["sentence"]
    assert lines.greedy_bands([1, 2, 3, 4, 9], lambda a, b: b - a < 3) == [0, 0, 0, 1, 2]


def test_lines_in_spark(spark):
    rows = [("p", "world", 90.0, 700.0, 30.0, 10.0), ("p", "Hello", 50.0, 700.0, 30.0, 10.0), ("q", "x", 0.0, 1.0, 2.0, 3.0)]
    got = lines.text_lines(spark.createDataFrame(rows, "page_id string, text string, x double, y double, width double, height double"))
    assert sorted((r["page_id"], r["text"]) for r in got.collect()) == [("p", "Hello world"), ("q", "x")]
    measured = {r["page_id"]: r["line_spacing"] for r in lines.page_measures(got).collect()}
    assert measured == {"p": None, "q": None}


def strokes(*boxes):
    return pd.DataFrame([(f"0{i}", *b) for i, b in enumerate(boxes)], columns=["id", "min_x", "min_y", "max_x", "max_y"])


def test_clusters():
    assert clusters.page_clusters(strokes(), 40).empty
    got = clusters.page_clusters(strokes((0, 0, 100, 20), (150, 5, 250, 25)), 40)
    assert got[["min_x", "min_y", "max_x", "max_y"]].values.tolist() == [[0, 0, 250, 25]]
    chain = clusters.page_clusters(strokes((0, 0, 50, 20), (150, 0, 200, 20), (300, 0, 350, 20)), 40)
    assert len(chain) == 1 and chain.strokes[0] == ["00", "01", "02"]
    far = clusters.page_clusters(strokes((0, 0, 50, 40), (0, 500, 50, 540)), 40)
    assert len(far) == 2
    dot = clusters.page_clusters(strokes((0, 0, 50, 60), (20, 62, 22, 64)), 40)
    assert len(dot) == 1 and dot.anchor_id[0] == "00"
    margin = strokes((500, 0, 600, 40), (505, 50, 600, 90), (510, 100, 600, 140))
    assert len(clusters.page_clusters(margin, 20)) == 3 and len(clusters.page_clusters(margin, 20, (0, 450))) == 1
    rows = clusters.page_clusters(strokes((300, 0, 340, 30), (0, 4, 40, 34)), 40)
    assert rows.min_x.tolist() == [0, 300] and rows.row_top.tolist() == [0, 0]


def test_merged_highlights():
    rows = pd.DataFrame({"id": ["a", "b", "c", "d"], "sentence": ["x y", "x y z", "q", ""], "top": [3.0, 2.0, 1.0, 0.0], "is_ink": [False, True, False, False]})
    assert dict(clusters.merged_by_text(rows).values.tolist()) == {"a": "a", "b": "a", "c": "c", "d": "d"}


def test_quote_repair(spark):
    body = "It was a long way off. They kept the device switched off during the whole journey home. Nothing else happened."
    quotes = spark.createDataFrame([("q1", "d", "They kept the device switched oP during the whole journey home."), ("q2", "d", "Completely different words entirely unrelated")], "quote_id string, doc_id string, text string")
    got = {r["quote_id"]: r["sentence"] for r in fuzzy.corrected(quotes, spark.createDataFrame([("d", body)], "doc_id string, body string")).collect()}
    assert got == {"q1": "They kept the device switched off during the whole journey home.", "q2": "Completely different words entirely unrelated"}
    assert fuzzy.correct_quote("switched oP during", ["oP"], body) == ("switched off during", ["off"])
    assert fuzzy.correct_quote("switched oP", ["absent"], body) is None


def test_chapter_names(spark):
    headings = spark.createDataFrame([("h1", "d", "CHAPTER I."), ("h2", "d", "nothing like it at all")], "heading_id string, doc_id string, title string")
    chapters = spark.createDataFrame([("d", "Chapter I. The beginning"), ("d", "Epilogue")], "doc_id string, chapter string")
    got = {r["heading_id"]: r["chapter"] for r in fuzzy.chapter_names(headings, chapters).collect()}
    assert got == {"h1": "Chapter I. The beginning", "h2": None}


def test_inherited_tags_stop_at_roots_strangers_and_cycles(spark):
    rows = [("d", "f2", "DocumentType", ["own"]), ("f2", "f1", "CollectionType", ["b", "a"]), ("f1", "", "CollectionType", ["a", "c"]), ("x", "y", "CollectionType", ["1"]), ("y", "x", "CollectionType", ["2"]), ("z", "gone", "DocumentType", None), ("t", "trash", "DocumentType", None)]
    entries = spark.createDataFrame(rows, "id string, parent string, type string, tags array<string>")
    got = {r["id"]: r["tags"] for r in routing.inherited_tags(entries).collect()}
    assert got["d"] == ["b", "a", "c"] and got["x"] == ["2", "1"] and got["z"] == [] and got["t"] == [] and got["f1"] == []


def test_inherited_tags_reach_the_root_of_deep_trees(spark):
    rows = [(str(i), str(i - 1) if i else "", "CollectionType", [f"t{i % 7}"]) for i in range(400)] + [("leaf", "399", "DocumentType", []), ("under", "leaf", "DocumentType", [])]
    got = {r["id"]: r["tags"] for r in routing.inherited_tags(spark.createDataFrame(rows, "id string, parent string, type string, tags array<string>")).collect()}
    assert len(got) == 402 and got["0"] == [] and got["under"] == [] and got["leaf"] == [f"t{i}" for i in (0, 6, 5, 4, 3, 2, 1)] and got["3"] == ["t2", "t1", "t0"]


def one_after_the_other(wanted, taken):
    used, out = set(taken), {}
    for key, folder, base, tag, doc in sorted(wanted):
        stem = f"{folder}/{base}" if folder else base
        names = [f"{stem}.md", f"{stem} ({tag}).md", f"{stem} ({doc[:6]}).md", *(f"{stem} ({n}).md" for n in range(2, 99))]
        out[key] = next(n for n in names if n not in used)
        used.add(out[key])
    return out


def test_free_paths_are_those_of_one_note_after_the_other(spark):
    import random

    r, schema = random.Random(3), "key string, folder string, base string, tag string, doc_id string"
    wanted = [(f"{i:03}", r.choice(("F", "")), r.choice("NM"), r.choice(("t", "u")), r.choice(("abcdef1", "abcdef2", "ghijkl3"))) for i in range(60)]
    taken = ["F/N.md", "M.md", "F/N (2).md", "F/N (3).md", "F/N (6).md", "M (t).md", "N (4).md", "F/M (20).md"]
    got = {x["key"]: x["path"] for x in routing.free_paths(spark.createDataFrame(wanted, schema), spark.createDataFrame([(t,) for t in taken], "path string")).collect()}
    assert got == one_after_the_other(wanted, taken)


def test_free_paths_never_collide(spark):
    schema = "key string, folder string, base string, tag string, doc_id string"
    wanted = [("1", "F", "a", "t", "d1"), ("2", "F", "a", "2", "d2"), ("3", "F", "a", "2", "d2"), ("4", "F", "a (2)", "t", "d4"), ("5", "F", "a (t)", "t", "d5"), ("6", "F", "a", "t", "d1"), ("7", "F", "a", "t", "d1")]
    taken = ["F/a (3).md"]
    got = [x["path"] for x in routing.free_paths(spark.createDataFrame(wanted, schema), spark.createDataFrame([(t,) for t in taken], "path string")).collect()]
    assert len(got) == len(set(got)) == 7 and not set(got) & set(taken)
    assert routing.free_paths(spark.createDataFrame([], schema), spark.createDataFrame([], "path string")).count() == 0


def test_free_paths(spark):
    wanted = spark.createDataFrame([("1", "F", "N", "t", "abcdefgh"), ("2", "F", "N", "t", "ijklmnop"), ("3", "", "M", "t", "x")], "key string, folder string, base string, tag string, doc_id string")
    taken = spark.createDataFrame([("F/N.md",), ("M.md",)], "path string")
    got = {r["key"]: r["path"] for r in routing.free_paths(wanted, taken).collect()}
    assert got == {"1": "F/N (t).md", "2": "F/N (ijklmn).md", "3": "M (t).md"}


def test_incremental_gate_and_transitions(spark):
    state = spark.createDataFrame([("k", "d", "active", 30, "n.md"), ("o", "e", "orphaned", None, "gone.md")], "sync_key string, doc_id string, status string, render_version int, note_path string")
    notes = spark.createDataFrame([("n.md",)], "path string")
    assert incremental.nothing_to_do("r", "r", "f", "f", state, notes)
    assert not incremental.nothing_to_do("r", "s", "f", "f", state, notes) and not incremental.nothing_to_do("r", "r", "f", "g", state, notes)
    assert not incremental.nothing_to_do("r", "r", "f", "f", incremental.invalidated(state), notes)
    assert not incremental.nothing_to_do("r", "r", "f", "f", state, notes.where("false"))
    due = spark.range(1).select(*(incremental.interval_due(F.lit(x), F.lit(2), F.unix_millis(F.to_timestamp(F.lit("2024-01-01 12:00:00")))).alias(n) for n, x in (("a", "2024-01-01 10:00:00"), ("b", "2024-01-01 10:00:01"), ("c", "nonsense"), ("d", None)))).first()
    assert tuple(due) == (True, False, True, True)


def test_nearest_keeps_rows_without_an_answer(spark):
    left = spark.createDataFrame([(1, "p", 5.0), (2, "q", 5.0)], "id int, page string, x double")
    right = spark.createDataFrame([("p", "a", 1, 4.0), ("p", "b", 2, 6.0), ("p", "c", 3, 50.0)], "page string, name string, ord int, rx double")
    got = nearest.nearest(left, right, ["page"], ["id"], F.abs(F.col("x") - F.col("rx")), F.col("ord"), F.col("name"), "found", 2.0)
    assert sorted((r["id"], r["found"]) for r in got.collect()) == [(1, "a"), (2, None)]


def test_peak_bands(spark):
    rows = spark.createDataFrame([("p", 0, 10), ("p", 2, 8), ("p", 2, 5), ("p", 6, 8), ("p", 20, 30)], "page string, a int, b int")
    got = sequences.peak_bands(sequences.sweep(rows, ["page"], "a", "b"), ["page"], 2)
    assert [(r["start"], r["end"], r["peak"]) for r in got.collect()] == [(2, 5, 3)]


def test_digest_text(spark):
    entries = spark.createDataFrame([("d", 1, "### A", "x"), ("d", 2, "### A", "y"), ("d", 3, "### B", "z")], "doc string, ord int, heading string, body string")
    assert rendering.digests(entries, "doc", ["ord"], "heading", "body").first()["digest"] == "\n### A\n\nx\n\ny\n\n### B\n\nz"
    one = spark.range(1).select(
        rendering.note_entry(F.lit("a\n> b"), F.lit(""), F.lit(" · [[p]]"), F.lit("nt-1"), F.lit(None).cast("struct<page:int,x:double,y:double,width:double,height:double>")).alias("n"),
        rendering.highlight_entry(F.lit("a <b> c d e f g"), F.array(F.lit("c")), F.lit(" · p"), F.lit("hl-1")).alias("h"),
    ).first()
    assert one["n"] == "> [!handwritten] [[p]]\n> a\n> \\> b ^nt-1"
    assert one["h"] == "a \\<b> ==c== d e f g · p\n^hl-1"


def test_note_rewriting(spark):
    from annolake.functions.text import FENCE_END as fence

    def note(text, transcript):
        return spark.range(1).select(rendering.with_transcript(F.lit(text), F.lit(transcript)).alias("v")).first()["v"]

    base = f"top\n{fence}\nmine"
    added = note(base, "said")
    assert added == f"top\n## Transcript\nsaid\n{fence}\nmine"
    assert note(added, "new") == f"top\n## Transcript\nnew\n{fence}\nmine" and note(added, "") == base
    assert note("no block", "x") is None and note(f"x\n## Digest\ny\n{fence}", "x") is None and note(base, "") is None


@pytest.mark.parametrize("stop", [False, True])
def test_stream_commits_state_after_output(spark, tmp_path, stop):
    schema = "sync_key string, doc_id string, tag string, folder string, page_hash long, n_items long, ord long, gone boolean"
    source, path, check = str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "check")

    def arrive(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    arrive(("a", "d", "t", "f", 1, 1, 0, False), ("a", "d", "t", "f", 2, 2, 1, False), ("b", "d", "t", "f", 1, 1, 2, None), ("c", "e", "t", "f", 1, 1, 3, False), ("u", "e", "t", "f", 1, 1, 4, False))
    seen = []

    def write(plan, number):
        seen.append({r["sync_key"]: r["action"] for r in plan.collect()})
        if stop and len(seen) == 1:
            raise RuntimeError("stopped")

    def run():
        return sync.sync_stream(spark.readStream.schema(schema).parquet(source), path, check, write, 4)

    query = run()
    if stop:
        with pytest.raises(Exception, match="stopped"):
            query.awaitTermination()
        assert sync.state(spark, path).count() == 0
        query = run()
    query.awaitTermination()
    assert seen[-1] == {k: "write" for k in "abcu"}
    assert sorted((r["sync_key"], r["page_hash"]) for r in sync.state(spark, path).collect()) == [("a", 2), ("b", 1), ("c", 1), ("u", 1)]
    # a later batch: one changed, one moved, one gone, one as it was, one new; keys without a unit stay
    arrive(("a", "d", "t", "f", 3, 1, 0, False), ("b", "d", "t", "g", 1, 1, 0, False), ("c", "e", "t", "f", 1, 1, 0, True), ("x", "e", "t", "f", 1, 1, 0, False))
    run().awaitTermination()
    assert seen[-1] == {"a": "rewrite", "b": "move", "c": "orphan", "x": "write"}
    arrive(("a", "d", "t", "f", 3, 1, 0, False), ("c", "e", "t", "f", 1, 1, 0, True))
    run().awaitTermination()
    assert seen[-1] == {"a": "skip", "c": "keep"}
    got = {r["sync_key"]: (r["page_hash"], r["folder"], r["status"], r["render_version"]) for r in sync.state(spark, path).collect()}
    assert got == {"a": (3, "f", "active", 30), "b": (1, "g", "active", 30), "c": (1, "f", "orphaned", None), "u": (1, "f", "active", 30), "x": (1, "f", "active", 30)}
