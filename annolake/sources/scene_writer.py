"""Page scenes in their binary form, from rows: the reverse of `scenes`. Each function gives the bytes of one block; a page is a header and its blocks."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterable, Sequence

from annolake.sources import scenes as S

HEADER = b"page scene, version=6"
Id = tuple[int, int]


def varint(n: int) -> bytes:
    if n < 0x80:
        return bytes((n,))
    groups = [n >> shift & 0x7F for shift in range(0, max(n.bit_length(), 1), 7)]
    return bytes([g | 0x80 for g in groups[:-1]] + groups[-1:])


def _field(index: int, kind: int, raw: bytes) -> bytes:
    return varint(index << 4 | kind) + raw


def _id(index: int, own: Id) -> bytes:
    return _field(index, S.ID, bytes([own[0]]) + varint(own[1]))


def _int(index: int, n: int) -> bytes:
    return _field(index, S.FOUR, struct.pack("<I", n))


def _float(index: int, x: float) -> bytes:
    return _field(index, S.FOUR, struct.pack("<f", x))


def _nested(index: int, body: bytes) -> bytes:
    return _field(index, S.NESTED, struct.pack("<I", len(body)) + body)


def _string(text: str) -> bytes:
    raw = text.encode()
    return varint(len(raw)) + bytes([raw.isascii()]) + raw


def _register(index: int, value: bytes) -> bytes:
    """A last-writer-wins register: a time stamp and a value."""
    return _nested(index, _id(1, (0, 1)) + value)


def block(kind: int, body: bytes, version: int = 2) -> bytes:
    return struct.pack("<IBBBB", len(body), 0, 1, version, kind) + body


def _item(kind: int, value: bytes, layer: Id, own: Id, deleted: bool) -> bytes:
    return _id(1, layer) + _id(2, own) + _id(3, (0, 0)) + _id(4, (0, 0)) + _int(5, int(deleted)) + _nested(6, bytes([kind]) + value)


def _points(points: Iterable[Sequence[float]], version: int) -> bytes:
    """(x, y, speed, width, direction, pressure) in the units of version 2; version 1 holds pixels and shares."""
    if version == 2:
        return b"".join(struct.pack("<ffHHBB", x, y, speed, width, direction, pressure) for x, y, speed, width, direction, pressure in points)
    return b"".join(struct.pack("<6f", x, y, speed / 4, direction * 2 * math.pi / 255, width / 4, pressure / 255) for x, y, speed, width, direction, pressure in points)


def _colour(index: int, rgba: int | None) -> bytes:
    return b"" if rgba is None else _int(index, rgba)


def layer(own: Id, name: str, visible: bool | None = None, anchor: Id | None = None, origin: float = 0.0) -> bytes:
    node = _id(1, own) + _register(2, _nested(2, _string(name)))
    node += b"" if visible is None else _register(3, _field(2, S.ONE, bytes([visible])))
    node += b"" if anchor is None else _register(7, _id(2, anchor)) + _register(10, _float(2, origin))
    return block(S.LAYER, _id(1, own)) + block(S.NODE, node)


def stroke(own: Id, layer_: Id, pen: int, colour: int, brush: float, points: Iterable[Sequence[float]], rgba: int | None = None, deleted: bool = False, version: int = 2) -> bytes:
    line = _int(1, pen) + _int(2, colour) + _field(3, S.EIGHT, struct.pack("<d", brush)) + _float(4, 0.0) + _nested(5, _points(points, version)) + _id(6, (0, 1)) + _colour(8, rgba)
    return block(S.LINE, _item(S.LINE_ITEM, line, layer_, own, deleted), version)


def highlight(own: Id, layer_: Id, text: str, colour: int, rects: Sequence[Sequence[float]], rgba: int | None = None) -> bytes:
    glyph = _int(2, 0) + _int(3, len(text)) + _int(4, colour) + _nested(5, _string(text)) + _nested(6, bytes([len(rects)]) + b"".join(struct.pack("<4d", *r) for r in rects)) + _colour(10, rgba)
    return block(S.GLYPH, _item(S.GLYPH_ITEM, glyph, layer_, own, False))


def typed(runs: Sequence[tuple[Id, str, int]], styles: Sequence[tuple[Id, int]], x: float, y: float, width: float) -> bytes:
    """Runs of (id, text, how many deleted); styles of (id of a character, style)."""
    def entry(body: bytes) -> bytes:
        return bytes([S.NESTED]) + struct.pack("<I", len(body)) + body

    chars = [entry(_id(2, i) + _id(3, (0, 0)) + _id(4, (0, 0)) + _int(5, gone) + (_nested(6, _string(text)) if text else b"")) for i, text, gone in runs]
    marks = [bytes([i[0]]) + varint(i[1]) + _id(1, (0, 1)) + _nested(2, bytes([0x11, style])) for i, style in styles]
    body = _nested(1, _nested(1, varint(len(chars)) + b"".join(chars))) + _nested(2, _nested(1, varint(len(marks)) + b"".join(marks)))
    return block(S.TEXT, _id(1, (0, 0)) + _nested(2, body) + _nested(3, struct.pack("<dd", x, y)) + _float(4, width))


def paper(width: int, height: int) -> bytes:
    return block(S.INFO, _nested(1, b"\0") + _nested(5, struct.pack("<II", width, height)))


def image(own: Id, layer_: Id, key: bytes, corners: Sequence[tuple[float, float]]) -> bytes:
    body = _nested(1, _id(1, (0, 3)) + _nested(2, key)) + _id(2, (0, 4)) + _nested(3, b"\0" + b"".join(struct.pack("<4f", x, y, 0, 0) for x, y in corners))
    return block(S.IMAGE, _item(S.IMAGE_ITEM, body, layer_, own, False))


def image_names(names: Sequence[tuple[bytes, str]]) -> bytes:
    entries = [key + _nested(1, _id(1, (0, 3)) + _nested(2, _string(name))) for key, name in names]
    return block(S.IMAGE_TABLE, _nested(1, varint(len(entries)) + b"".join(bytes([S.NESTED]) + struct.pack("<I", len(e)) + e for e in entries)))


def page(blocks: Iterable[bytes]) -> bytes:
    return HEADER.ljust(S.HEADER_BYTES) + b"".join(blocks)
