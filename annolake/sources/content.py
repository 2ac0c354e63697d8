"""Positioned text from page content streams.

A stream's operators become rows; everything after that is windows over them. The matrix at an operator is a product over the levels of saved states that are open there: each level's own `cm` operators since it was
opened, inner levels first. So what a restore takes back simply is not in the product, and no matrix is ever inverted. Font size and leading come from the innermost open level that sets them. Lines move by
running sums of offsets since the text matrix was set, and runs on a line by running sums of widths.

Text is measured by given widths of characters, as a stream's own fonts are outside of it. What cannot be used is left out and told: operators without their operands, restores without a save, pages
without a stream or without text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annolake.functions import text as T

OPS = "page_id string, ord int, op string, n array<double>, text string"
#: Operators that are followed, with the numbers that each needs; the rest draw nothing that is read.
NUMBERS = {"q": 0, "Q": 0, "cm": 6, "BT": 0, "ET": 0, "Tf": 1, "TL": 1, "Td": 2, "TD": 2, "Tm": 6, "T*": 0, "Tj": 0, "TJ": 0, "'": 0, '"': 2}
_TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|<[0-9A-Fa-f\s]*>|/[^\s()<>\[\]{}/%]*|[+-]?(?:\d+\.?\d*|\.\d+)(?=[\s()<>\[\]{}/%]|$)|[\[\](]|[^\s()<>\[\]{}/%]+")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_INSIDE = re.compile(rb"\\([0-7]{1,3}|\r\n|[\s\S])|[()]|[^\\()]+")


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in parentheses, from behind the first one, and the place behind the last."""
    out, depth = [], 1
    for m in _INSIDE.finditer(data, at):
        token = m.group()
        if m.group(1) is not None:
            own = m.group(1)
            out.append(bytes([int(own, 8) & 255]) if own[:1].isdigit() and own[0] < 56 else b"" if own in (b"\n", b"\r", b"\r\n") else _ESCAPES.get(own, own))
            continue
        depth += (token == b"(") - (token == b")")
        if not depth:
            return b"".join(out), m.end()
        out.append(token)
    return b"".join(out), len(data)


def operators(data: bytes) -> Iterator[tuple[str, list[float], str | None]]:
    """(operator, numbers, text) in order; a show of several strings is a row for each, with rows ``k`` for the offsets between. An operator without its operands is a row ``?``."""
    at, operands, inside = 0, [], None
    while m := _TOKEN.search(data, at):
        token, at = m.group(), m.end()
        put = operands if inside is None else inside
        if token[:1] == b"%" or token in (b"<<", b">>"):
            continue
        if token == b"(":
            raw, at = _literal(data, at)
            put.append(raw.decode("latin-1"))
        elif token[:1] == b"<":
            digits = bytes(c for c in token[1:-1] if chr(c).isalnum())
            put.append(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1"))
        elif token == b"[":
            inside = []
        elif token == b"]":
            operands.append(inside or [])
            inside = None
        elif token[:1] == b"/":
            put.append(None)
        elif token[:1] in b"+-.0123456789" and re.fullmatch(rb"[+-]?(?:\d+\.?\d*|\.\d+)", token):
            put.append(float(token))
        else:
            op, own, operands, inside = token.decode("latin-1"), operands, [], None
            if op not in NUMBERS:
                continue
            numbers, strings, lists = [x for x in own if isinstance(x, float)], [x for x in own if isinstance(x, str)], [x for x in own if isinstance(x, list)]
            if len(numbers) < NUMBERS[op] or op in ("Tj", "'", '"') and not strings or op == "TJ" and not lists:
                yield "?", [], op
            elif op == "TJ":
                for x in lists[-1]:
                    if isinstance(x, float):
                        yield "k", [x], None
                    elif isinstance(x, str):
                        yield "Tj", [], x
            elif op in ("'", '"'):
                yield "T*", [], None
                yield "Tj", [], strings[-1]
            else:
                yield op, numbers[-NUMBERS[op] :] if NUMBERS[op] else [], strings[-1] if op == "Tj" else None


def operator_rows(pages: DataFrame) -> DataFrame:
    """The operators of (page_id, content binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = list(operators(content.as_py() or b""))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([page] * len(own), pa.string()), pa.array(range(len(own)), pa.int32()), pa.array([o for o, _, _ in own], pa.string()), pa.array([n for _, n, _ in own], pa.list_(pa.float64())), pa.array([t for _, _, t in own], pa.string())],
                    names=["page_id", "ord", "op", "n", "text"],
                )

    return pages.select("page_id", "content").mapInArrow(run, OPS)


def product(a: Column, b: Column) -> Column:
    """a x b of matrices as six numbers, as points are rows: first a, then b."""
    return F.array(
        a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5],
    )


def _identity() -> Column:
    return F.array(*(F.lit(x) for x in (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)))


def _products(matrices: Column) -> Column:
    """Of matrices in order, later ones first: what a later one does is done to a point before."""
    return F.aggregate(matrices, _identity(), lambda acc, m: product(m, acc))


def _depths(ops: DataFrame) -> DataFrame:
    """With ``depth``, how many saved states are open at an operator (of a restore: before it); restores without a save count for nothing."""
    w = W.partitionBy("page_id").orderBy("ord").rowsBetween(W.unboundedPreceding, W.currentRow)
    step = F.when(F.col("op") == "q", 1).when(F.col("op") == "Q", -1).otherwise(0)
    rows = ops.withColumn("_s", F.sum(step).over(w)).withColumn("_low", F.least(F.lit(0), F.min("_s").over(w)))
    spare = (F.col("op") == "Q") & (F.col("_low") < F.coalesce(F.lag("_low").over(W.partitionBy("page_id").orderBy("ord")), F.lit(0)))
    depth = F.col("_s") - F.col("_low") + F.when((F.col("op") == "Q") & ~spare, 1).otherwise(0)
    return rows.select(*ops.columns, depth.cast("int").alias("depth"), spare.alias("spare"))


def _states(deep: DataFrame) -> DataFrame:
    """(page_id, ord, ctm, size, leading) at each operator that shows or moves text."""
    asks = F.col("op").isin("Tj", "k", "T*", "TD")
    level = F.when(asks, F.sequence(F.lit(0), F.col("depth"))).otherwise(F.array("depth"))
    rows = deep.where(asks | F.col("op").isin("q", "cm", "Tf", "TL", "TD")).select("page_id", "ord", "op", "n", asks.alias("asks"), "depth", F.explode(level).alias("level"))
    # which of the states of a level is open: that of the last save that led there
    at_level = W.partitionBy("page_id", "level").orderBy("ord").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("scope", F.coalesce(F.last(F.when(F.col("op") == "q", F.col("ord")), True).over(at_level), F.lit(-1)))
    inside = W.partitionBy("page_id", "level", "scope").orderBy("ord").rowsBetween(W.unboundedPreceding, W.currentRow)
    own = F.col("level") == F.col("depth")
    rows = rows.withColumn("_m", _products(F.collect_list(F.when(F.col("op") == "cm", F.col("n"))).over(inside)))
    rows = rows.withColumn("_size", F.last(F.when(F.col("op") == "Tf", F.col("n")[0]), True).over(inside))
    rows = rows.withColumn("_lead", F.last(F.when(F.col("op") == "TL", F.col("n")[0]).when((F.col("op") == "TD") & own, -F.col("n")[1]), True).over(inside))
    listed = F.sort_array(F.collect_list(F.struct("level", "_m", "_size", "_lead")))
    deepest = lambda field: F.try_element_at(F.filter(F.transform("_levels", lambda s: s[field]), lambda x: x.isNotNull()), F.lit(-1))
    told = rows.where("asks").groupBy("page_id", "ord").agg(listed.alias("_levels"))
    return told.select("page_id", "ord", _products(F.transform("_levels", lambda s: s["_m"])).alias("ctm"), F.coalesce(deepest("_size"), F.lit(0.0)).alias("size"), F.coalesce(deepest("_lead"), F.lit(0.0)).alias("leading"))


def text_items(pages: DataFrame, widths: dict[str, float] | None = None, default: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """((page_id, ord, text, x, y, width, height), warnings (page_id, ord, warning)) of (page_id, content binary): runs of text in the order in which they are shown, in the units of the page. Empty runs, and runs
    whose place is no number, are left out. ``widths``: of characters, as shares of the font size; ``default`` of all others."""
    deep = _depths(operator_rows(pages))
    rows = deep.where(F.col("op").isin("BT", "Tm", "Td", "TD", "T*", "Tj", "k")).join(_states(deep), ["page_id", "ord"], "left")
    w = W.partitionBy("page_id").orderBy("ord").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("_base", F.count(F.when(F.col("op").isin("BT", "Tm"), 1)).over(w)).withColumn("_line", F.count(F.when(~F.col("op").isin("Tj", "k"), 1)).over(w))
    based = W.partitionBy("page_id", "_base").orderBy("ord").rowsBetween(W.unboundedPreceding, W.currentRow)
    dx = F.when(F.col("op").isin("Td", "TD"), F.col("n")[0]).otherwise(0.0)
    dy = F.when(F.col("op").isin("Td", "TD"), F.col("n")[1]).when(F.col("op") == "T*", -F.col("leading")).otherwise(0.0)
    base = F.coalesce(F.first(F.when(F.col("op") == "Tm", F.col("n")), True).over(based), _identity())
    wide = F.when(F.col("op") == "Tj", T.measured(F.col("text"), widths or {}, default) * F.col("size")).when(F.col("op") == "k", -F.col("n")[0] / 1000 * F.col("size")).otherwise(0.0)
    rows = rows.withColumns({"_x": F.sum(dx).over(based), "_y": F.sum(dy).over(based), "_tm": base, "_w": wide})
    on_line = W.partitionBy("page_id", "_line").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    shown = rows.withColumn("_x", F.col("_x") + F.coalesce(F.sum("_w").over(on_line), F.lit(0.0))).where((F.col("op") == "Tj") & (F.col("text") != ""))
    one = F.lit(1.0)
    whole = product(product(F.array(one, F.lit(0.0), F.lit(0.0), one, F.col("_x"), F.col("_y")), F.col("_tm")), F.col("ctm"))
    placed = shown.withColumn("_p", whole).select(
        "page_id", "ord", "text", F.col("_p")[4].alias("x"), F.col("_p")[5].alias("y"), (F.col("_w") * F.hypot(F.col("_p")[0], F.col("_p")[1])).alias("width"), (F.col("size") * F.hypot(F.col("_p")[2], F.col("_p")[3])).alias("height")
    )
    items = placed.where(F.abs("x") < float("inf")).where(F.abs("y") < float("inf"))
    bad = deep.where("op = '?' OR spare").select("page_id", "ord", F.when(F.col("op") == "?", F.concat(F.lit("without operands: "), "text")).otherwise("a restore without a save").alias("warning"))
    silent = pages.join(items.select("page_id").distinct(), "page_id", "left_anti")
    silent = silent.select("page_id", F.lit(None).cast("int").alias("ord"), F.when(F.col("content").isNull(), "no stream").otherwise("no text").alias("warning"))
    return items, bad.unionByName(silent)


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, page_index, label): what each page of (doc_id, page_index) is called: its own label of (doc_id, page_index, label), else its number from 1."""
    own = labels.where("label <> ''").groupBy("doc_id", "page_index").agg(F.max("label").alias("label"))
    return pages.join(own, ["doc_id", "page_index"], "left").withColumn("label", F.coalesce("label", (F.col("page_index") + 1).cast("string"))).select("doc_id", "page_index", "label")
