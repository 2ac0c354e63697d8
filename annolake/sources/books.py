"""EPUB books: the text of every page in archive order, and the labels of the navigation."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolake.functions import text as T

ENTRIES = "doc_id string, ord int, name string, body string"


def directory(data: bytes) -> list[tuple[str, int, int, int]] | None:
    """(name, method, packed size, place of its header) of each entry, None without a readable central directory."""
    end = data.rfind(b"PK\x05\x06")
    if end < 0 or end + 22 > len(data):
        return None
    count, _, at = struct.unpack_from("<HII", data, end + 10)
    out = []
    for _ in range(count):
        if data[at : at + 4] != b"PK\x01\x02":
            return None
        method, packed, name, extra, comment, place = *struct.unpack_from("<H8xI4xHHH8xI", data, at + 10),
        out.append((data[at + 46 : at + 46 + name].decode("utf-8", "replace"), method, packed, place))
        at += 46 + name + extra + comment
    return out


def content(data: bytes, entry: tuple[str, int, int, int]) -> bytes | None:
    """An entry's bytes: stored or deflated; None for any other method or a broken stream."""
    _, method, packed, place = entry
    name, extra = struct.unpack_from("<HH", data, place + 26)
    start = place + 30 + name + extra
    body = data[start : start + packed]
    if method == 0:
        return body
    if method != 8:
        return None
    try:
        return zlib.decompressobj(-15).decompress(body)
    except zlib.error:
        return None


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for doc, data in zip(frame.doc_id, frame.content, strict=True):
            for i, entry in enumerate(directory(data or b"") or []):
                if entry[0].lower().endswith((".html", ".xhtml", ".htm", ".ncx")):
                    body = content(data, entry)
                    if body is not None:
                        rows.append((doc, i, entry[0], body.decode("utf-8", "replace")))
        yield pd.DataFrame(rows, columns=["doc_id", "ord", "name", "body"])


def entries(files: DataFrame) -> DataFrame:
    """Readable text entries of (doc_id, content binary)."""
    return files.select("doc_id", "content").mapInPandas(_read, ENTRIES)


def books(files: DataFrame) -> DataFrame:
    """(doc_id, body, chapters): texts joined by a space in archive order; labels of the NCX, else of the first page with a table of contents."""
    e = entries(files)
    is_ncx = F.lower("name").endswith(".ncx")
    pages = F.sort_array(F.collect_list(F.when(~is_ncx, F.struct("ord", T.markup_text(F.col("body")).alias("t")))))
    ncx = F.min_by(F.when(is_ncx, T.nav_labels(F.col("body"))), F.when(is_ncx & (F.size(T.nav_labels(F.col("body"))) > 0), F.col("ord")))
    toc = T.toc_labels(F.col("body"))
    nav = F.min_by(F.when(~is_ncx, toc), F.when(~is_ncx & (F.size(toc) > 0), F.col("ord")))
    got = e.groupBy("doc_id").agg(F.array_join(F.transform(pages, lambda s: s["t"]), " ").alias("body"), F.coalesce(ncx, nav, F.array().cast("array<string>")).alias("chapters"))
    return files.select("doc_id").join(got, "doc_id", "left")


def scan(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", "true").load(path)
    return books(files.select(F.regexp_extract("path", r"([^/]+)\.epub$", 1).alias("doc_id"), "content"))
