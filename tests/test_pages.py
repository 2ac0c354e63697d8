import pytest
from annolake.operators import canvas, marks, typed


def test_canvas_aggregates(spark):
    nan = float("nan")
    points = spark.createDataFrame([("a", 10.0, 20.0, 4.0), ("a", -800.0, 2000.0, 2.0), ("b", nan, 5.0, 1.0), ("b", 700.0, -3.0, 1.0)], "page_id string, x double, y double, stroke_width double")
    got = {r["page_id"]: r for r in canvas.annotated_box(points, 1404.0, 1872.0, 72.0).collect()}
    assert (got["a"]["x"], got["a"]["y"], got["a"]["width"], got["a"]["height"]) == (-98.0, -128.0, 1502.0, 2000.0)
    assert (got["b"]["x"], got["b"]["height"]) == (0.0, 1875.0)
    got = {r["page_id"]: (r["width_px"], r["height_px"]) for r in canvas.ink_canvas(points, 1404.0, 1872.0).collect()}
    assert got == {"a": (1648.0, 2024.0), "b": (1448.0, 1872.0)}
    assert {r["page_id"]: r["width_px"] for r in canvas.expanded_width(points, 1404.0, 1872.0).collect()} == {"a": 1872.0, "b": 1404.0}
    rects = spark.createDataFrame([("a", 100.0, 50.0), ("c", 90000.0, 1.0)], "page_id string, y double, height double")
    assert {r["page_id"]: r["bottom"] for r in canvas.content_bottom(points, rects, 37440.0).collect()} == {"a": 2001.0, "b": 5.5}
    papers = spark.createDataFrame([("d", 0, 5.0, 5.0), ("d", 1, 1620.0, 2160.0), ("e", 0, 1.0, 1.0)], "doc_id string, ord int, width double, height double")
    assert {r["doc_id"]: r["canvas"]["widthPx"] for r in canvas.declared_canvas(papers).collect()} == {"d": 1620.0, "e": 1404.0}


def test_typed_text(spark):
    schema = "page_id string, runs array<struct<id:string,text:string,deleted:int>>, styles map<string,int>, pos_x double, pos_y double, width double"
    runs = [("1:10", "Head\nsome words here", 0), ("1:90", "gone", 3)]
    text = spark.createDataFrame([("p", runs, {"0:0": 3}, -100.0, 0.0, 12.0)], schema)
    assert "".join(r["char"] for r in typed.live_characters(text).orderBy("ord").collect()) == "Head\nsome words here"
    assert typed.live_characters(text).where("char_id = '1:11'").first()["char"] == "e"
    lines = typed.laid_out(text, {}, 1.0).orderBy("ord").collect()
    assert [(x["text"], x["first"], x["style"]) for x in lines] == [("Head", True, 3), ("some words", True, 1), ("here", False, 1)]
    assert [round(x["y"], 1) for x in lines] == [68.2, 137.7, 183.2]
    heights = typed.anchor_heights(text, {}, 1.0).first()
    assert heights["top"] == lines[0]["y"] and heights["bottom"] == lines[2]["y"] and heights["char_y"]["1:26"] == lines[2]["y"]
    head = typed.scene_headings(typed.laid_out(text, {}, 1.0)).collect()
    assert [(h["title"], h["y"]) for h in head] == [("Head", lines[0]["y"])]


LINES = [("p", 0, "First line of the text.", 0.0, 100.0, 230.0, 10.0), ("p", 1, "Second one runs", 0.0, 88.0, 150.0, 10.0), ("p", 2, "over here. Third.", 0.0, 76.0, 170.0, 10.0)]


@pytest.fixture(scope="module")
def page_lines(spark):
    return spark.createDataFrame(LINES, "page_id string, ord int, text string, x double, y double, width double, height double")


def test_mark_rects_and_quotes(spark, page_lines):
    from pyspark.sql import functions as F

    rect = "struct<x:double,y:double,width:double,height:double>"
    rows = [("p", "under", (0.0, 85.0, 60.0, 2.0), False, False, 12.0), ("p", "marker", (70.0, 90.0, 30.0, 3.0), False, True, 12.0), ("p", "loop", (0.0, 74.0, 40.0, 12.0), True, False, 12.0), ("p", "word", (0.0, 300.0, 60.0, 20.0), False, False, 12.0), ("p", "speck", (0.0, 85.0, 3.0, 1.0), False, False, 12.0)]
    given = spark.createDataFrame(rows, f"page_id string, mark_id string, rect {rect}, is_loop boolean, is_marker boolean, line_height double")
    as_lines = page_lines.select("page_id", "ord", F.struct("text", "x", "y", "width", "height").alias("line"))
    rects = marks.mark_rects(given, as_lines)
    got = {r["mark_id"]: r["rect"] for r in rects.collect()}
    assert set(got) == {"under", "marker", "loop"} and (got["under"]["y"], got["under"]["height"]) == (88.0, 10.0)
    assert {r["mark_id"] for r in marks.split_marks(given, rects)[1].collect()} == {"word", "speck"}
    quoted = marks.quotes(rects.groupBy("page_id", F.col("mark_id").alias("id")).agg(F.collect_list("rect").alias("rects")), page_lines)
    said = {r["id"]: (r["sentence"], r["marked"]) for r in quoted.collect()}
    assert said["under"] == ("Second one runs over here.", ["Second"])
    assert said["marker"] == ("Second one runs over here.", ["one"])


def test_sections(spark, page_lines):
    lines = spark.createDataFrame([("d", 0, *r[1:2], *r[3:]) for r in LINES], "doc_id string, page_index int, ord int, x double, y double, width double, height double")
    headings = spark.createDataFrame([("d", 0, 0, "A", 0.0, 100.0), ("d", 0, 1, "B", 0.0, 88.0), ("d", 2, 2, "C", None, None)], "doc_id string, page_index int, ord int, title string, x double, y double")
    entries = spark.createDataFrame([("d", 0, "above", 0.0, 120.0), ("d", 0, "one", 0.0, 99.0), ("d", 0, "two", 0.0, 76.0), ("d", 1, "next", 0.0, 5.0), ("d", 2, "last", 0.0, 5.0)], "doc_id string, page_index int, entry_id string, x double, y double")
    got = {r["entry_id"]: r["section"] for r in marks.sections(entries, headings, lines).collect()}
    assert got == {"above": None, "one": "A", "two": "B", "next": "B", "last": "C"}
