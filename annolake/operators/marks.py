"""Pen marks and highlights to the text that they point at, page by page: interval and containment joins with an ordered minimum."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annolake.functions import geometry as G
from annolake.operators.lines import line_spacing, quote
from annolake.operators.shared import Rounds, by_group

# Fixed values, in line heights.
MIN_MARK_WIDTH, MAX_UNDERLINE_HEIGHT = 2.5, 0.4


def reads_as_mark(width: Column, height: Column, is_loop: Column, line: Column) -> Column:
    return (width >= MIN_MARK_WIDTH * line) & ((height < MAX_UNDERLINE_HEIGHT * line) | is_loop)


def mark_rects(marks: DataFrame, lines: DataFrame, page: str = "page_id") -> DataFrame:
    """(page_id, mark_id, rect): what each mark covers. marks: (page_id, mark_id, rect, is_loop, is_marker, line_height) in points; lines: (page_id, ord, line).
    A flat pen stroke covers the band of the nearest line above it, a flat marker the line that holds it (both over half its width), a loop its own box;
    marks without a line are left out."""
    r, line, h = F.col("rect"), F.col("line"), F.col("line_height")
    flat = r["height"] < MAX_UNDERLINE_HEIGHT * h
    wide = marks.where(r["width"] >= MIN_MARK_WIDTH * h)
    gap = (line["y"] - (r["y"] + r["height"])) / h
    under = ~F.col("is_marker") & gap.between(G.UNDERLINE_ABOVE, G.UNDERLINE_BELOW)
    inside = F.col("is_marker") & (r["y"] >= line["y"]) & (r["y"] + r["height"] <= line["y"] + line["height"])
    pairs = wide.where(flat).join(lines, page).where((G.x_coverage(r, line) >= G.MIN_X_COVERAGE) & (under | inside))
    order = F.struct(F.when(F.col("is_marker"), F.lit(0.0)).otherwise(gap).alias("g"), F.col("ord"))
    band = F.min_by(G.rect(r["x"], line["y"], r["width"], line["height"]), order)
    flats = pairs.groupBy(page, "mark_id").agg(band.alias("rect"))
    whole = wide.where(~flat & (F.col("is_loop") | F.col("is_marker"))).select(page, "mark_id", "rect")
    return flats.unionByName(whole)


def split_marks(marks: DataFrame, rects: DataFrame, page: str = "page_id") -> tuple[DataFrame, DataFrame]:
    """Marks that quote text, and the strokes that remain handwriting."""
    return marks.join(rects.select(page, "mark_id"), [page, "mark_id"], "left_semi"), marks.join(rects.select(page, "mark_id"), [page, "mark_id"], "left_anti")


def quotes(rects: DataFrame, lines: DataFrame, page: str = "page_id") -> DataFrame:
    """(page_id, id, sentence, marked array) of (page_id, id, rects array) over (page_id, ord, text, x, y, width, height). Which characters of which line are
    covered is an expression on the join; the sentences need neighbouring lines and are made page by page."""
    line = F.struct("text", "x", "y", "width", "height")
    own, lines = lines.toDF(*lines.columns), lines.toDF(*lines.columns)  # rects may come from the same lines
    hits = rects.join(own, page).withColumn("range", G.marked_range(line, F.col("rects"))).where(F.col("range").isNotNull())
    hit = hits.select(page, "id", "ord", F.col("range.start").alias("start"), F.col("range.end").alias("end"))

    # a page's hits, then its lines
    none = lambda *fields: [F.lit(None).cast(kind).alias(name) for name, kind in fields]
    kinds = dict(own.dtypes)
    lined = lines.select(page, F.lit(1).alias("kind"), "ord", "text", "y", "height", *none(("id", "string"), ("start", "int"), ("end", "int")))
    asked = hit.select(page, F.lit(0).alias("kind"), "ord", *none(*((c, kinds[c]) for c in ("text", "y", "height"))), "id", "start", "end")

    def run(rows: pd.DataFrame):
        hits, right = rows[rows.kind == 0], rows[rows.kind == 1].reset_index(drop=True)
        if hits.empty:
            return []
        place, spacing, wanted = {o: i for i, o in enumerate(right.ord)}, line_spacing(right), {}
        for i, o, a, b in zip(hits.id, hits.ord, hits.start, hits.end, strict=True):
            wanted.setdefault(i, []).append((place[o], int(a), int(b)))
        return [(rows[page].iloc[0], i, *quote(right, own_hits, spacing)) for i, own_hits in sorted(wanted.items())]

    return by_group(asked.unionByName(lined), page, ["kind", "ord"], run, f"{page} string, id string, sentence string, marked array<string>")


def nearest_lines(points: np.ndarray, lines: np.ndarray, cells: int = 1 << 18) -> np.ndarray:
    """For each point (x, y) the least order of the lines (order, x, y, width, height) at the least distance; nan without lines. So many points at a time that about ``cells`` distances are held; a missing coordinate is no distance."""
    out = np.full(len(points), np.nan)
    if not len(lines):
        return out
    rank, x, y, width, height = lines[np.argsort(lines[:, 0], kind="stable")].T
    step = max(1, cells // len(lines))
    for a in range(0, len(points), step):
        px, py = points[a : a + step, 0][:, None], points[a : a + step, 1][:, None]
        dx, dy = np.fmax(0, np.fmax(x - px, px - (x + width))), np.fmax(0, np.fmax(y - py, py - (y + height)))
        out[a : a + step] = rank[np.sqrt(dx * dx + dy * dy).argmin(1)]  # the first of equal ones
    return out


def sections(entries: DataFrame, headings: DataFrame, lines: DataFrame, page: str = "page_index", doc: str = "doc_id") -> DataFrame:
    """(doc_id, entry_id, section): the last heading at or before each entry in reading order; on one page by the nearest line's rank, of equal ranks one that does not
    stand below the entry. entries: (doc_id, page_index, entry_id, x, y); headings: (doc_id, page_index, ord, title, x, y); lines: (doc_id, page_index, ord, x, y, width, height)."""
    place = ("x", "y", "width", "height")
    size = lambda *names: [F.lit(None).cast("double").alias(c) for c in names]
    xy = [F.col(c).cast("double").alias(c) for c in ("x", "y")]
    points = entries.select(doc, page, F.lit(1).alias("kind"), F.col("entry_id").cast("string").alias("id"), F.lit(None).cast("double").alias("ord"), *xy, *size("width", "height"), F.lit(None).cast("string").alias("title")).unionByName(
        headings.select(doc, page, F.lit(2).alias("kind"), F.lit(None).cast("string").alias("id"), F.col("ord").cast("double").alias("ord"), xy[0], F.coalesce(xy[1], F.lit(float("inf"))).alias("y"), *size("width", "height"), "title")
    )
    boxes = lines.groupBy(doc, page, *(F.col(c).cast("double").alias(c) for c in place)).agg(F.min(F.col("ord").cast("double")).alias("ord"))  # of equal boxes the first is the nearest
    boxes = boxes.select(doc, page, F.lit(0).alias("kind"), F.lit(None).cast("string").alias("id"), "ord", *place, F.lit(None).cast("string").alias("title"))

    def run(rows: pd.DataFrame):
        right, left = rows[rows.kind == 0], rows[rows.kind > 0]
        ranks = nearest_lines(left[["x", "y"]].to_numpy(float), right[["ord", *place]].to_numpy(float))
        return zip(left["_page"], left["kind"], left["id"], left["ord"], left["y"], left["title"], ranks, strict=True)

    kinds = dict(entries.dtypes)
    keyed = points.unionByName(boxes).withColumn("_page", F.to_json(F.struct(F.col(doc).alias("d"), F.col(page).alias("p"))))
    ranked = by_group(keyed.drop(doc, page), "_page", ["kind"], run, "_page string, kind int, id string, ord double, y double, title string, rank double")
    ranked = Rounds(entries.sparkSession, "sections").write(ranked)  # read four times below
    key = F.from_json("_page", f"d {kinds[doc]}, p {kinds[page]}")
    ranked = ranked.withColumns({doc: key["d"], page: key["p"], "y": F.when(~F.isnan("y"), F.col("y")), "rank": F.coalesce(F.when(~F.isnan("rank"), F.col("rank")), -F.when(~F.isnan("y"), F.col("y")))})
    e = ranked.where("kind = 1").select(doc, page, F.col("id").cast(kinds["entry_id"]).alias("entry_id"), "rank", F.col("y").alias("ey"))
    h = ranked.where("kind = 2").select(doc, page, "ord", "title", F.col("rank").alias("hr"), "y")
    # the last heading of a lower rank, unless one of the entry's own rank does not stand below it; in order of rank, a rank's entries come before its headings, and again from the bottom up after them
    both = e.select(doc, page, "entry_id", "rank", F.col("ey").alias("y"), F.lit(0).alias("k"), F.lit(None).cast("double").alias("ord"), F.lit(None).cast("string").alias("title")).unionByName(
        h.select(doc, page, F.lit(None).cast(kinds["entry_id"]).alias("entry_id"), F.col("hr").alias("rank"), "y", F.lit(1).alias("k"), "ord", "title")
    )
    head = F.when((F.col("k") == 1) & F.col("rank").isNotNull(), F.struct("ord", "title"))
    lower = F.last(head, ignorenulls=True).over(W.partitionBy(doc, page).orderBy("rank", "k", "ord").rowsBetween(W.unboundedPreceding, W.currentRow))
    own = F.max(head).over(W.partitionBy(doc, page, "rank").orderBy(F.desc("y"), F.desc("k")).rowsBetween(W.unboundedPreceding, W.currentRow))
    here = both.withColumn("_lower", lower).withColumn("_own", F.when(F.col("rank").isNotNull() & F.col("y").isNotNull(), own)).where("k = 0").select(doc, page, "entry_id", F.coalesce("_own", "_lower")["title"].alias("here"))
    last = h.groupBy(doc, page).agg(F.max_by("title", F.struct((-F.col("y")).alias("below"), F.col("ord"))).alias("title"))
    # pages carry the last heading of earlier pages forward
    pages = e.select(doc, page).distinct().withColumn("title", F.lit(None).cast("string")).withColumn("_k", F.lit(0)).unionByName(last.withColumn("_k", F.lit(1)))
    before = W.partitionBy(doc).orderBy(page, "_k").rowsBetween(W.unboundedPreceding, -1)
    carried = pages.withColumn("carried", F.last("title", ignorenulls=True).over(before)).where("_k = 0").select(doc, page, "carried")
    return here.join(carried, [doc, page], "left").select(doc, "entry_id", F.coalesce("here", "carried").alias("section"))
