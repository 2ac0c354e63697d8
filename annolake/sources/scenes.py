"""Binary page scenes: length-prefixed blocks of tagged values.

A block's body is a stream of tags (varint of index << 4 | kind) with a value each: an id, a byte, four or eight bytes, or a nested stream. `fields`
reads any such stream into a map by index, so the block readers below only name the indexes they want. A broken block costs that block only.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql.pandas.types import to_arrow_schema

from annolake.sources.vault import read_vault

# Fixed values of the format.
HEADER_BYTES = 43
LAYER, NODE, GLYPH, LINE, TEXT, INFO, IMAGE_TABLE, IMAGE = 0x01, 0x02, 0x03, 0x05, 0x07, 0x0D, 0x0E, 0x0F
ID, NESTED, EIGHT, FOUR, ONE = 0xF, 0xC, 0x8, 0x4, 0x1
GLYPH_ITEM, LINE_ITEM, IMAGE_ITEM = 1, 3, 7
POINT_V1, POINT_V2 = np.dtype([("v", "<f4", 6)]), np.dtype([("x", "<f4"), ("y", "<f4"), ("speed", "<u2"), ("width", "<u2"), ("direction", "u1"), ("pressure", "u1")])
#: Rows of a batch at least, so that many small pages share one.
ROWS = 1024
ANCHOR_TOP, ANCHOR_BOTTOM = "0:281474976710654", "0:281474976710655"

def _struct(**kinds: ST.DataType) -> ST.StructType:
    return ST.StructType([ST.StructField(k, v) for k, v in kinds.items()])


_S, _I, _D = ST.StringType(), ST.IntegerType(), ST.DoubleType()
POINT = _struct(x=_D, y=_D, speed=_I, width=_I, direction=_I, pressure=_I)
RECT = _struct(x=_D, y=_D, width=_D, height=_D)
RGB = _struct(r=_I, g=_I, b=_I)
RUN = _struct(id=_S, text=_S, deleted=_I)
SCENE = _struct(
    page_id=_S, kind=_S, ord=_I, layer_id=_S, id=_S, name=_S, visible=ST.BooleanType(), anchor_id=_S, origin_x=_D, pen=_I, color=_I, brush=_D, points=ST.ArrayType(POINT), rgba=RGB,
    text=_S, rects=ST.ArrayType(RECT), pos_x=_D, pos_y=_D, width=_D, height=_D, runs=ST.ArrayType(RUN), styles=ST.MapType(_S, _I), error=_S,
)


class BrokenBlock(ValueError):
    pass


def varint(data: bytes, at: int) -> tuple[int, int]:
    """(value, place behind it); little-endian groups of seven bits, 32 bits kept."""
    if at < len(data) and data[at] < 0x80:  # most are one byte
        return data[at], at + 1
    out = shift = 0
    while True:
        if at >= len(data):
            raise BrokenBlock("a number runs over the end")
        byte = data[at]
        out |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return out & 0xFFFFFFFF, at


def entity(data: bytes, at: int) -> tuple[str, str, int]:
    """An id as `part:number` and as the hexadecimal form of its bytes, and the place behind it."""
    end = at + 1
    if end < len(data) and data[end] < 0x80:
        return f"{data[at]}:{data[end]}", data[at : end + 1].hex(), end + 1
    while end < len(data) and data[end] & 0x80:
        end += 1
    if end >= len(data):
        raise BrokenBlock("an id runs over the end")
    number = sum((b & 0x7F) << 7 * i for i, b in enumerate(data[at + 1 : end + 1]))
    return f"{data[at]}:{number}", data[at : end + 1].hex(), end + 1


def fields(data: bytes, at: int = 0, end: int | None = None) -> tuple[dict[int, tuple], int]:
    """Values by index, up to what is no tag: an id is (key, hex), four and eight bytes are raw, a nested stream is (start, end)."""
    end = len(data) if end is None else end
    out: dict[int, tuple] = {}
    while at < end:
        try:
            tag, body = varint(data, at)
        except BrokenBlock:
            break
        kind, index = tag & 0xF, tag >> 4
        if kind == ID:
            key, raw, body = entity(data, body)
            value: tuple = (key, raw)
        elif kind in (EIGHT, FOUR, ONE):
            value, body = (data[body : body + kind],), body + kind
        elif kind == NESTED and body + 4 <= end:
            size = struct.unpack_from("<I", data, body)[0]
            value, body = (body + 4, body + 4 + size), body + 4 + size
        else:
            break
        if body > end:
            raise BrokenBlock(f"field {index} runs over the end")
        out[index], at = value, body
    return out, at


def _u32(value: tuple) -> int:
    return struct.unpack("<I", value[0])[0]


def _string(data: bytes, place: tuple[int, int]) -> str:
    size, at = varint(data, place[0])
    return data[at + 1 : at + 1 + size].decode("utf-8", "replace")  # one byte between says whether it is ASCII


def _latest(data: bytes, place: tuple[int, int]) -> tuple | None:
    """The value of a last-writer-wins register; its time stamp is not needed, as one value is kept."""
    return fields(data, *place)[0].get(2)


def _rgba(own: dict[int, tuple], index: int) -> dict | None:
    if index not in own:
        return None
    packed = _u32(own[index])
    return {"r": packed >> 16 & 255, "g": packed >> 8 & 255, "b": packed & 255}


def _item(data: bytes, kind: int) -> tuple[dict, int, int] | None:
    """(outer fields, start and end of the value) of a scene item of that kind; None for a deleted or other one."""
    own, _ = fields(data)
    if 1 not in own or 2 not in own or 5 not in own:
        raise BrokenBlock("an item without ids")
    if _u32(own[5]) or 6 not in own or data[own[6][0]] != kind:
        return None
    return own, own[6][0] + 1, own[6][1]


def points(data: bytes, version: int) -> list[dict]:
    """Pen points; version 1 holds pixels and shares, which are brought to the units of version 2."""
    if version != 1:
        table = np.frombuffer(data[: len(data) // 14 * 14], POINT_V2)
        return [dict(zip(("x", "y", "speed", "width", "direction", "pressure"), p, strict=True)) for p in table.tolist()]
    table = np.frombuffer(data[: len(data) // 24 * 24], POINT_V1)["v"].astype(float).reshape(-1, 6)
    scale = table[:, 2:] * (4, 255 / (2 * math.pi), 4, 255)
    speed, direction, width, pressure = np.floor(scale + 0.5).astype(int).T
    return [
        {"x": x, "y": y, "speed": s, "width": w, "direction": d, "pressure": p}
        for x, y, s, w, d, p in zip(*table[:, :2].T.tolist(), speed.tolist(), width.tolist(), direction.tolist(), pressure.tolist(), strict=True)
    ]


def _stroke(data: bytes, version: int) -> dict | None:
    item = _item(data, LINE_ITEM)
    if item is None:
        return None
    own, start, end = item
    line, _ = fields(data, start, end)
    return {
        "kind": "stroke", "layer_id": own[1][1], "id": own[2][1], "pen": _u32(line[1]), "color": _u32(line[2]), "brush": struct.unpack("<d", line[3][0])[0],
        "points": points(data[slice(*line[5])], version), "rgba": _rgba(line, 8),
    }


def _highlight(data: bytes) -> dict | None:
    item = _item(data, GLYPH_ITEM)
    if item is None:
        return None
    own, start, end = item
    glyph, _ = fields(data, start, end)
    at, stop = glyph[6]
    if stop - at != 1 + 32 * data[at]:
        return None
    rects = np.frombuffer(data[at + 1 : stop], "<f8").reshape(-1, 4)
    return {
        "kind": "highlight", "id": own[2][1], "color": _u32(glyph[4]), "text": _string(data, glyph[5]), "rgba": _rgba(glyph, 10),
        "rects": [dict(zip(("x", "y", "width", "height"), r, strict=True)) for r in rects.tolist()],
    }


def _image(data: bytes) -> dict | None:
    item = _item(data, IMAGE_ITEM)
    if item is None:
        return None
    own, start, end = item
    image, _ = fields(data, start, end)
    reference, _ = fields(data, *image[1])
    key = data[slice(*reference[2])]
    body = data[image[3][0] + 1 : image[3][1]]
    if len(key) != 16 or len(body) % 16 or len(body) < 48:
        return None
    xy = np.frombuffer(body, "<f4").reshape(-1, 4)[:, :2].astype(float)
    low, high = xy.min(0), xy.max(0)
    return {"kind": "image", "layer_id": own[1][1], "id": own[2][1], "name": key.hex(), "pos_x": low[0], "pos_y": low[1], "width": high[0] - low[0], "height": high[1] - low[1]}


def _image_names(data: bytes) -> Iterator[dict]:
    own, _ = fields(data)
    _, at = varint(data, own[1][0])
    while at < own[1][1] and data[at] == NESTED:
        size = struct.unpack_from("<I", data, at + 1)[0]
        at, end = at + 5, at + 5 + size
        entry, _ = fields(data, at + 16, end)
        inner, _ = fields(data, *entry[1])
        yield {"kind": "image_name", "name": data[at : at + 16].hex(), "text": _string(data, inner[2])}
        at = end


def _node(data: bytes) -> dict:
    own, _ = fields(data)
    label, _ = fields(data, *own[2])
    out = {"kind": "node", "layer_id": own[1][1], "name": _string(data, label[2])}
    try:
        visible, anchor, origin = (_latest(data, own[i]) if i in own else None for i in (3, 7, 10))
        out["visible"] = visible[0] != b"\0" if visible else None
        if anchor and origin:
            raw = origin[0]
            out |= {"anchor_id": anchor[0], "origin_x": struct.unpack("<f" if len(raw) == 4 else "<d", raw)[0]}
    except (BrokenBlock, struct.error):
        pass
    return out


def _text(data: bytes) -> dict | None:
    own, _ = fields(data)
    body, _ = fields(data, *own[2])
    inner, _ = fields(data, *body[1])
    count, at = varint(data, inner[1][0])
    runs, styles = [], {}
    for _ in range(count):
        size = struct.unpack_from("<I", data, at + 1)[0]
        at, end = at + 5, at + 5 + size
        run, _ = fields(data, at, end)
        runs.append({"id": run[2][0], "text": _string(data, run[6]) if 6 in run else "", "deleted": _u32(run[5])})
        at = end
    if 2 in body:
        outer, _ = fields(data, *body[2])
        n, at = varint(data, outer[1][0])
        try:
            for _ in range(n):
                key, _, at = entity(data, at)
                own_style, at = fields(data, at, at + _style_size(data, at))
                styles[key] = data[own_style[2][0] + 1]
        except (BrokenBlock, struct.error, KeyError, IndexError):
            pass
    if 3 not in own or 4 not in own:
        return None
    x, y = struct.unpack_from("<dd", data, own[3][0])
    return {"kind": "text", "pos_x": x, "pos_y": y, "width": struct.unpack("<f", own[4][0])[0], "runs": runs, "styles": styles}


def _style_size(data: bytes, at: int) -> int:
    """Bytes of one style: an id and a nested value."""
    _, start = varint(data, at)
    _, _, start = entity(data, start)
    _, body = varint(data, start)
    return body + 4 + struct.unpack_from("<I", data, body)[0] - at


def _paper(data: bytes) -> dict | None:
    own, _ = fields(data)
    if 5 not in own or own[5][1] - own[5][0] < 8:
        return None
    width, height = struct.unpack_from("<II", data, own[5][0])
    return {"kind": "paper", "width": float(width), "height": float(height)}


def blocks(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(type, version, body) of each block behind the header."""
    at = HEADER_BYTES
    while at + 8 <= len(data):
        size, _, _, version, kind = struct.unpack_from("<IBBBB", data, at)
        yield kind, version, data[at + 8 : at + 8 + size]
        at += 8 + size


def scene_rows(page: str, data: bytes) -> Iterator[dict]:
    """Everything on one page, one row each; a block that can't be read is a row with its error."""
    readers = {NODE: _node, GLYPH: _highlight, TEXT: _text, INFO: _paper, IMAGE: _image}
    for ord_, (kind, version, body) in enumerate(blocks(data)):
        try:
            if kind == LAYER:
                found = [{"kind": "layer", "layer_id": fields(body)[0][1][1]}]
            elif kind == LINE:
                found = [_stroke(body, version)]
            elif kind == IMAGE_TABLE:
                found = list(_image_names(body))
            else:
                found = [readers[kind](body)] if kind in readers else []
        except (BrokenBlock, struct.error, KeyError, IndexError, ValueError) as e:
            found = [{"kind": "error", "error": f"block {kind}: {e}"}]
        for row in found:
            if row is not None:
                yield {"page_id": page, "ord": ord_} | row


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, rows = to_arrow_schema(SCENE), []
    for batch in batches:
        for page, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows += (r | {"styles": list(r["styles"].items())} if "styles" in r else r for r in scene_rows(page, content.as_py() or b""))
            if len(rows) >= ROWS:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def parsed(pages: DataFrame) -> DataFrame:
    """Scene rows of (page_id, content binary); a page without content is an empty scene."""
    return pages.select("page_id", "content").mapInArrow(_batches, SCENE)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Scene rows of all `.rm` files under a path; the page is the file's name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.rm").option("recursiveFileLookup", "true").load(path)
    return parsed(files.select(F.regexp_extract("path", r"([^/]+)\.rm$", 1).alias("page_id"), "content"))


def stored(spark: SparkSession, root: str) -> DataFrame:
    """Scene rows of all `.rm` files of a vault. Its folders are listed and its files read in tasks, many of them in each; `scan` lists all on the driver and opens a few in a task, which takes longer than to read them."""
    files = read_vault(spark, root).where(F.col("path").endswith(".rm"))
    return parsed(files.select(F.regexp_extract("path", r"([^/]+)\.rm$", 1).alias("page_id"), "content"))


def layers(scene: DataFrame) -> DataFrame:
    """(page_id, layer_id, ord, name, visible, anchor_id, origin_x, strokes): layer order, left-joined with names and strokes."""
    own = scene.where("kind = 'layer'").select("page_id", "layer_id", "ord")
    nodes = scene.where("kind = 'node'").groupBy("page_id", "layer_id").agg(*(F.max_by(c, "ord").alias(c) for c in ("name", "visible", "anchor_id", "origin_x")))
    strokes = scene.where("kind = 'stroke'").groupBy("page_id", "layer_id").agg(F.sort_array(F.collect_list(F.struct("ord", "id", "pen", "color", "brush", "points", "rgba"))).alias("strokes"))
    keys = ["page_id", "layer_id"]
    return own.join(nodes, keys, "left").join(strokes, keys, "left").withColumn("strokes", F.coalesce("strokes", F.array().cast(strokes.schema["strokes"].dataType)))


def images(scene: DataFrame) -> DataFrame:
    """Images with their file names; those whose name the page lacks are left out (see `unnamed_images`)."""
    names = scene.where("kind = 'image_name'").groupBy("page_id", "name").agg(F.max_by("text", "ord").alias("file_name"))
    return scene.where("kind = 'image'").select("page_id", "ord", "layer_id", "id", "name", "pos_x", "pos_y", "width", "height").join(names, ["page_id", "name"])


def unnamed_images(scene: DataFrame) -> DataFrame:
    return scene.where("kind = 'image'").join(scene.where("kind = 'image_name'").select("page_id", "name"), ["page_id", "name"], "left_anti").select("page_id", "id", "name")


def placed(layer_rows: DataFrame, heights: DataFrame) -> DataFrame:
    """Layers with their points moved to their anchors. heights: (page_id, top, bottom, char_y map); a page without one has no text, an
    anchor that is not in it falls back to the top; both are told in ``placement``."""
    joined = layer_rows.join(heights, "page_id", "left")
    known = F.when(F.col("anchor_id") == ANCHOR_TOP, F.col("top")).when(F.col("anchor_id") == ANCHOR_BOTTOM, F.col("bottom")).otherwise(F.col("char_y")[F.col("anchor_id")])
    placement = F.when(F.col("anchor_id").isNull(), F.lit(None)).when(F.col("top").isNull(), "no-text").when(known.isNull(), "unknown-anchor").otherwise("applied")
    dy = F.when(F.col("anchor_id").isNotNull() & F.col("top").isNotNull(), F.coalesce(known, F.col("top"))).otherwise(F.lit(0.0))
    dx = F.when(F.col("anchor_id").isNotNull() & F.col("top").isNotNull(), F.col("origin_x")).otherwise(F.lit(0.0))
    moved = F.transform("strokes", lambda s: s.withField("points", F.transform(s["points"], lambda p: p.withField("x", p["x"] + dx).withField("y", p["y"] + dy))))
    return joined.select("page_id", "layer_id", "ord", "name", "visible", placement.alias("placement"), moved.alias("strokes"))
