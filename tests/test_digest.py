import re

from annolake.functions import geometry as G
from annolake.operators import backends, digest, outline
from pyspark.sql import functions as F

DPI, HEIGHT = 226.0, 600.0


def scene(x, y, w, h):
    """A rect of a 400 x 600 point page in scene pixels."""
    k = DPI / 72
    return ((x - 200) * k, (HEIGHT - y - h) * k, w * k, h * k)


def test_a_document_of_three_pages(spark):
    rect = "struct<x:double,y:double,width:double,height:double>"
    pages = spark.createDataFrame(
        [("d", "p1", 0, 1, False, 400.0, 600.0, "iv"), ("d", "p2", 1, 2, False, 400.0, 600.0, None), ("d", "p3", 2, 3, True, 400.0, 600.0, None)],
        "doc_id string, page_id string, source_index int, embed_page int, appended boolean, width double, height double, label string",
    )
    text = ["A first line stands here.", "The second line is marked by", "hand and goes on.", "The last line is alone."]
    lines = spark.createDataFrame([("p1", i, t, 50.0, 500.0 - 20 * i, 200.0, 12.0) for i, t in enumerate(text)], "page_id string, ord int, text string, x double, y double, width double, height double")
    headings = spark.createDataFrame([("d", 0, 0, "Beginnings", 50.0, 560.0)], "doc_id string, page_index int, ord int, title string, x double, y double")
    highlights = spark.createDataFrame([("p1", 0, "h1", "device text", [scene(50, 480, 200, 12)]), ("p2", 0, "h2", " as the\n device told ", [scene(50, 480, 200, 12)]), ("p3", 0, "h3", "on an added page", [scene(50, 480, 200, 12)])], f"page_id string, ord int, id string, text string, rects array<{rect}>")

    def stroke(page, ord_, id_, x, y, w, h):
        sx, sy, sw, sh = scene(x, y, w, h)
        return (page, ord_, id_, (sx, sy, sx + sw, sy + sh), (float(x), float(y), float(w), float(h)), False, False)

    rows = [stroke("p1", 0, "1:1", 50, 459, 200, 1), stroke("p1", 1, "1:2", 300, 300, 30, 14), stroke("p1", 2, "1:3", 262, 479, 30, 14), stroke("p3", 0, "1:9", 10, 10, 30, 14), stroke("p3", 1, "1:4", 300, 500, 30, 14)]
    strokes = spark.createDataFrame(rows, f"page_id string, ord int, id string, box struct<minX:double,minY:double,maxX:double,maxY:double>, rect {rect}, is_marker boolean, is_loop boolean")

    def read(content):
        if b"1:2" in bytes(content):
            raise ValueError("unreadable")
        return f" read {bytes(content).decode()}\r\n\n twice "

    told, warnings = digest.digest(pages, lines, headings, highlights, strokes, backends.per_page(read), F.lit("e.pdf"))
    row = told.first()
    blocks = re.sub(r"(hl|nt)-[0-9a-f]{6}", r"\1", row["digest"]).strip("\n").split("\n\n")
    assert row["status"] == "failed" and {(w["page_id"], w["kind"]) for w in warnings.collect()} == {("p2", "no text"), ("p1", "not transcribed")}
    assert blocks[0] == "### Beginnings"
    # the highlight and the underline quote one sentence: one entry, and the note beside the highlight under it
    assert blocks[1].replace("==", "") == "The second line is marked by hand and goes on. · [[e.pdf#page=1|p. iv]]\n^hl"
    assert sum("^hl" in b for b in blocks) == 2 and blocks[2].startswith("> [!handwritten]\n> read 1:3 twice ^nt")
    assert "*Not transcribed*" in row["digest"]
    # the section goes on across the page break
    assert "\n\nas the device told · [[e.pdf#page=2|p. 2]]\n^hl-" in row["digest"] and row["digest"].count("### Beginnings") == 1
    last = row["digest"].split("### ")[-1]
    assert last.startswith("[[e.pdf#page=3|Added page]]\n\n> [!handwritten]\n> read 1:9,1:4\n> twice ^nt-") and "```" not in last


    assert "added page" not in row["digest"].replace("[[e.pdf#page=3|Added page]]", "").lower()  # its highlights go nowhere
    # without notes: no handwriting, no added page, and a warning for marks that no text answers to
    flat = spark.createDataFrame([stroke("p1", 9, "1:8", 50, 200, 200, 1)], strokes.schema)
    told, warnings = digest.digest(pages, lines, headings, highlights, strokes.unionByName(flat), backends.per_page(read), F.lit("e.pdf"), margin_notes=False)
    row = told.first()
    assert "handwritten" not in row["digest"] and "Added page" not in row["digest"] and row["digest"].count("^hl-") == 2
    assert {(w["page_id"], w["kind"], w["n"]) for w in warnings.collect()} == {("p2", "no text", 1), ("p1", "unmatched mark", 1)}


def test_regions_follow_the_fit_and_the_device(spark):
    """Ink 40 points left of the paper shrinks the drawn page; the region is where the note lies on it."""
    rect = "struct<x:double,y:double,width:double,height:double>"
    pages = spark.createDataFrame([("d", "p", 0, 1, False, 400.0, 600.0, None)], "doc_id string, page_id string, source_index int, embed_page int, appended boolean, width double, height double, label string")
    lines = spark.createDataFrame([("p", 0, "Words.", 50.0, 500.0, 200.0, 12.0)], "page_id string, ord int, text string, x double, y double, width double, height double")
    headings = spark.createDataFrame([], "doc_id string, page_index int, ord int, title string, x double, y double")
    highlights = spark.createDataFrame([], f"page_id string, ord int, id string, text string, rects array<{rect}>")
    k = 229.0 / 72
    box = lambda x, y, w, h: ((x - 200) * k, (600.0 - y - h) * k, (x - 200 + w) * k, (600.0 - y) * k)
    rows = [("p", 0, "1:1", box(-40, 300, 30, 14), (-40.0, 300.0, 30.0, 14.0), False, False)]
    strokes = spark.createDataFrame(rows, f"page_id string, ord int, id string, box struct<minX:double,minY:double,maxX:double,maxY:double>, rect {rect}, is_marker boolean, is_loop boolean")
    devices = spark.createDataFrame([("d", 229.0)], "doc_id string, dpi double").select("doc_id", F.struct("dpi").alias("canvas"))
    told, _ = digest.digest(pages, lines, headings, highlights, strokes, backends.per_page(lambda c: "a note"), F.lit("e.pdf"), devices=devices)
    region = re.search(r"```[^\n]*\n(.*?)```", told.first()["digest"], re.S).group(1)
    scale = 400 / 440
    got = [int(x) for x in re.search(r"rect: (.*)", region).group(1).split()]
    assert got == [round(x) for x in ((-40 + 40) * scale, 600 - ((300 + 14) * scale + 600 - 600 * scale), 30 * scale, 14 * scale)]


def test_labels_and_regions(spark):
    def value(c):
        return spark.range(1).select(c.alias("v")).first()["v"]

    yes, no = F.lit(True), F.lit(False)
    assert [value(digest.page_label(F.lit(x).cast("string"), F.lit(4), a)) for x, a in (("iv", no), (None, no), ("iv", yes))] == ["iv", "5", None]
    fit = F.struct(F.lit(0.5).alias("scale"), F.lit(10.0).alias("dx"), F.lit(20.0).alias("dy"))
    rect = G.rect(*(F.lit(float(x)) for x in (100, 200, 30, 40)))
    assert tuple(value(digest.note_region(rect, fit, F.lit(600.0), F.lit(2)))) == (2, 60.0, 460.0, 15.0, 20.0)
    assert value(digest.note_region(rect, F.when(no, fit), F.lit(600.0), F.lit(2))) is None


def test_preorder(spark):
    rows = [(1, None, 0), (2, 1, 1), (3, 1, 0), (4, 3, 0), (5, 3, 1), (6, 2, 0), (7, None, 1), (8, 99, 0)]
    got = {(r["id"], r["depth"], r["position"]) for r in outline.preorder(spark.createDataFrame(rows, "id long, up long, ord int")).collect()}
    assert got == {(1, 1, 1), (3, 2, 2), (4, 3, 3), (5, 3, 4), (2, 2, 5), (6, 3, 6), (7, 1, 7)}
    assert outline.preorder(spark.createDataFrame([], "id long, up long, ord int")).count() == 0


def test_preorder_of_deep_and_broken_trees(spark):
    import random

    r = random.Random(7)
    path = [(i, i - 1 if i else None, 0) for i in range(300)]
    tree = [(1000 + i, 1000 + r.randrange(i) if i and r.random() < 0.97 else None, r.randrange(3)) for i in range(400)]
    ring = [(5000, 5002, 0), (5001, 5000, 0), (5002, 5001, 0), (5003, 5001, 1), (6000, 9999, 0), (6001, 6000, 0)]
    rows = path + tree + ring
    got = {(x["id"], x["depth"], x["position"]) for x in outline.preorder(spark.createDataFrame(rows, "id long, up long, ord int")).collect()}
    below = {}
    for i, up, o in sorted(rows, key=lambda x: (x[2], x[0])):
        below.setdefault(up, []).append(i)
    want, stack = set(), [(i, 1) for i in reversed(below[None])]
    while stack:
        i, depth = stack.pop()
        want.add((i, depth, len(want) + 1))
        stack += [(c, depth + 1) for c in reversed(below.get(i, []))]
    assert got == want
