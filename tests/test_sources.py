import io
import struct
import zipfile

import pytest
from annolake.sources import books, catalog, scenes


def varint(n):
    out = b""
    while True:
        out += bytes([n & 0x7F | (0x80 if n > 0x7F else 0)])
        n >>= 7
        if not n:
            return out


def tag(i, kind):
    return varint(i << 4 | kind)


def ident(i, a, b):
    return tag(i, 0xF) + bytes([a]) + varint(b)


def four(i, n):
    return tag(i, 4) + struct.pack("<I", n)


def nested(i, body):
    return tag(i, 0xC) + struct.pack("<I", len(body)) + body


def string(s):
    raw = s.encode()
    return varint(len(raw)) + b"\1" + raw


def block(kind, body, version=2):
    return struct.pack("<IBBBB", len(body), 0, 1, version, kind) + body


def item(kind, value, layer=(0, 11), own=(1, 300), deleted=0):
    return ident(1, *layer) + ident(2, *own) + ident(3, 0, 0) + ident(4, 0, 0) + four(5, deleted) + nested(6, bytes([kind]) + value)


def stroke(version):
    if version == 1:
        pts = struct.pack("<6f", 1.5, 2.5, 1.0, 3.141592653589793, 2.0, 0.5)
    else:
        pts = struct.pack("<ffHHBB", 1.5, 2.5, 4, 8, 128, 128)
    return four(1, 17) + four(2, 0) + tag(3, 8) + struct.pack("<d", 2.0) + tag(4, 4) + struct.pack("<f", 0.0) + nested(5, pts) + ident(6, 1, 5) + tag(8, 4) + struct.pack("<I", 0xFF102030)


def page():
    out = b"header, version=6".ljust(scenes.HEADER_BYTES)
    out += block(scenes.LAYER, ident(1, 0, 11))
    lww = lambda i, value: nested(i, ident(1, 0, 1) + value)
    out += block(scenes.NODE, ident(1, 0, 11) + nested(2, ident(1, 0, 1) + nested(2, string("Layer é"))) + lww(3, tag(2, 1) + b"\1") + lww(7, ident(2, 1, 20)) + lww(10, tag(2, 4) + struct.pack("<f", -5.0)))
    out += block(scenes.LINE, item(scenes.LINE_ITEM, stroke(2))) + block(scenes.LINE, item(scenes.LINE_ITEM, stroke(1), own=(1, 301)), 1)
    out += block(scenes.LINE, item(scenes.LINE_ITEM, stroke(2), own=(1, 302), deleted=1)) + block(scenes.LINE, b"\xff\xff")
    glyph = four(2, 1) + four(3, 4) + four(4, 9) + nested(5, string("quoted")) + nested(6, b"\1" + struct.pack("<4d", 1, 2, 3, 4))
    out += block(scenes.GLYPH, item(scenes.GLYPH_ITEM, glyph, own=(1, 400)))
    run = ident(2, 1, 20) + ident(3, 0, 0) + ident(4, 0, 0) + four(5, 0) + nested(6, string("typed"))
    style = ident(0, 1, 21)[1:] + ident(1, 0, 1) + nested(2, b"\x11\3")
    out += block(scenes.TEXT, ident(1, 0, 0) + nested(2, nested(1, nested(1, varint(1) + b"\x0c" + struct.pack("<I", len(run)) + run)) + nested(2, nested(1, varint(1) + style))) + nested(3, struct.pack("<dd", -10, 20)) + tag(4, 4) + struct.pack("<f", 900.0))
    out += block(scenes.INFO, nested(1, b"\0") + nested(5, struct.pack("<II", 1620, 2160)))
    key = bytes(range(16))
    entry = key + nested(1, ident(1, 0, 3) + nested(2, string("a.png")))
    out += block(scenes.IMAGE_TABLE, nested(1, varint(1) + b"\x0c" + struct.pack("<I", len(entry)) + entry))
    mesh = b"\0" + b"".join(struct.pack("<4f", x, y, 0, 0) for x, y in ((1, 2), (4, 2), (4, 8)))
    image = nested(1, ident(1, 0, 3) + nested(2, key)) + ident(2, 0, 4) + nested(3, mesh)
    out += block(scenes.IMAGE, item(scenes.IMAGE_ITEM, image, own=(1, 500))) + block(scenes.IMAGE, item(scenes.IMAGE_ITEM, image.replace(key, b"\7" * 16), own=(1, 501)))
    return out + block(0x42, b"unknown")


def test_scene_of_all_kinds_of_blocks(spark, tmp_path):
    (tmp_path / "p1.rm").write_bytes(page())
    scene = scenes.scan(spark, str(tmp_path)).cache()
    rows = {}
    for r in scene.collect():
        rows.setdefault(r["kind"], []).append(r)
    assert {k: len(v) for k, v in rows.items()} == {"layer": 1, "node": 1, "stroke": 2, "error": 1, "highlight": 1, "text": 1, "paper": 1, "image_name": 1, "image": 2}
    a, b = rows["stroke"]
    assert (a["points"][0].speed, a["points"][0].width, a["points"][0].direction, a["points"][0].pressure) == (4, 8, 128, 128)
    assert (b["points"][0].speed, b["points"][0].width, b["points"][0].direction, b["points"][0].pressure) == (4, 8, 128, 128)
    assert (a["pen"], a["brush"], a["rgba"].asDict()) == (17, 2.0, {"r": 16, "g": 32, "b": 48})
    assert rows["highlight"][0]["rects"][0].asDict() == {"x": 1, "y": 2, "width": 3, "height": 4}
    text = rows["text"][0]
    assert (text["pos_x"], text["pos_y"], text["width"], text["runs"][0]["text"], text["styles"]) == (-10, 20, 900, "typed", {"1:21": 3})
    layer = scenes.layers(scene).collect()[0]
    assert (layer["name"], layer["visible"], layer["anchor_id"], layer["origin_x"], len(layer["strokes"])) == ("Layer é", True, "1:20", -5.0, 2)
    assert [(r["file_name"], r["pos_x"], r["height"]) for r in scenes.images(scene).collect()] == [("a.png", 1, 6)]
    assert scenes.unnamed_images(scene).count() == 1
    heights = spark.createDataFrame([("p1", 100.0, 900.0, {"1:20": 250.0})], "page_id string, top double, bottom double, char_y map<string,double>")
    moved = scenes.placed(scenes.layers(scene), heights).collect()[0]
    assert (moved["placement"], moved["strokes"][0]["points"][0]["x"], moved["strokes"][0]["points"][0]["y"]) == ("applied", -3.5, 252.5)


def test_missing_content_is_an_empty_scene(spark):
    assert scenes.parsed(spark.createDataFrame([("p", None)], "page_id string, content binary")).count() == 0


def test_varints_and_ids():
    assert scenes.varint(varint(300), 0) == (300, 2)
    assert scenes.entity(bytes([1]) + varint(300), 0) == ("1:300", "01ac02", 3)
    with pytest.raises(scenes.BrokenBlock):
        scenes.varint(b"\x80", 0)


def test_books(spark):
    def archive(files, **kw):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", **kw) as z:
            for name, body in files:
                z.writestr(name, body)
        return data.getvalue()

    pages = [("b.xhtml", "<p>One &amp; two</p>"), ("a.html", "<style>x</style><p>th&#233;e&#x21;</p><nav epub:type='toc'><a href=1>C 1</a><a>C  2</a></nav>"), ("x.png", b"no")]
    ncx = ("toc.ncx", "<navLabel><text>First</text></navLabel><navLabel><text>Second </text></navLabel>")
    rows = [("d1", archive(pages)), ("d2", archive([*pages, ncx], compression=zipfile.ZIP_DEFLATED)), ("d3", b"not a zip"), ("d4", None)]
    got = {r["doc_id"]: r for r in books.books(spark.createDataFrame(rows, "doc_id string, content binary")).collect()}
    assert got["d1"]["body"] == got["d2"]["body"] == "One & two thée! C 1 C 2"
    assert got["d1"]["chapters"] == ["C 1", "C 2"] and got["d2"]["chapters"] == ["First", "Second"]
    assert got["d3"]["body"] is None and got["d4"]["body"] is None


def test_catalog(spark):
    good = '{"visibleName":"n","parent":"","lastModified":"1","type":"DocumentType","pinned":false,"x":null}'
    rows = [(1, good), (2, "[1]"), (3, good.replace('"pinned":false', '"pinned":null')), (4, good.replace("DocumentType", "Other")), (5, None)]
    got = {r["id"]: r["error"] for r in catalog.metadata(spark.createDataFrame(rows, "id int, text string")).collect()}
    assert got == {1: None, 2: "not an object", 3: "pinned", 4: "type", 5: "not an object"}

    pages = "doc_id string, file_type string, c_pages array<struct<id:string,idx:string,deleted:int,redir:int>>, pages array<string>"
    content = spark.createDataFrame([("a", "pdf", [("p2", "bb", None, 4), ("p1", "ba", None, None), ("p0", "a", 1, 0)], None), ("b", "notebook", None, ["x", "y"])], pages)
    got = sorted(tuple(r) for r in catalog.live_pages(content).collect())
    assert got == [("a", "p1", 0, None, True), ("a", "p2", 1, 4, False), ("b", "x", 0, 0, False), ("b", "y", 1, 1, False)]

    files = spark.createDataFrame([("d", "d/p.rm", "h1", 0), ("d", "d/i/a.png", "h2", 1), ("d", "d/j/a.png", "h3", 2), ("d", "d.epub", "h4", 3)], "doc_id string, path string, hash string, ord int")
    got = catalog.page_files(files).collect()[0]
    assert (got["pages"], got["images"], got["epub"]) == ({"p": "h1"}, {"a.png": "h3"}, "h4")

    saved = spark.createDataFrame([('{"attachmentFolder":"old","ocrBackend":"gone"}',), ("{}",), ('{"ocrBackend":"local","tagFolders":{"a":"b"}}',)], "saved string")
    got = [(r["attachments_folder"], r["ocr_backend"], r["tag_folders"]) for r in catalog.settings(saved, ("off", "local")).collect()]
    assert got == [("old", "off", {}), ("attachments", "off", {}), ("attachments", "local", {"a": "b"})]
