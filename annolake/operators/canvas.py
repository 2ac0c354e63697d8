"""Sizes of pages and of the ink on them, as aggregates over points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.functions.geometry import finite

# Device screens (pixels, dots per inch) and limits.
DEVICES = ((1404.0, 1872.0, 226.0), (1620.0, 2160.0, 229.0))
OVERHANG, INK_MARGIN, MAX_CANVAS, SCROLLED = 1.0, 24.0, 20000.0, 20


def _canvas(width: Column, height: Column, dpi: Column) -> Column:
    return F.struct(width.alias("widthPx"), height.alias("heightPx"), dpi.alias("dpi"))


def device(n: int) -> Column:
    return _canvas(*(F.lit(x) for x in DEVICES[n]))


def declared_canvas(papers: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc_id, canvas): of (doc_id, ord, width, height) the first declared size that is a known device's, else the first device."""
    known = F.coalesce(*(F.when((F.col("width") == w) & (F.col("height") == h), device(i)) for i, (w, h, _) in enumerate(DEVICES)))
    first = F.min_by(known, F.when(known.isNotNull(), F.col("ord")))
    return papers.groupBy(doc).agg(F.coalesce(first, device(0)).alias("canvas"))


def detected_canvas(points: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The larger device where any ink lies beside the smaller one's screen but on the larger's."""
    wide = finite(F.col("x")) & (F.abs("x") > DEVICES[0][0] / 2) & (F.abs("x") < DEVICES[1][0])
    return points.groupBy(doc).agg(F.when(F.bool_or(wide), device(1)).otherwise(device(0)).alias("canvas"))


def _reach(points: DataFrame, page: str) -> DataFrame:
    """Bounds of the finite points of each page; the frame's columns are carried along."""
    good = finite(F.col("x")) & finite(F.col("y"))
    return points.groupBy(page).agg(*(f(F.when(good, F.col(c))).alias(n) for n, f, c in (("x0", F.min, "x"), ("x1", F.max, "x"), ("y0", F.min, "y"), ("y1", F.max, "y"))))


def ink_bounds(points: DataFrame, page: str = "page_id") -> DataFrame:
    """(page_id, minX, minY, maxX, maxY) of (page_id, x, y, radius), grown by the largest radius; pages without points have none."""
    grown = points.groupBy(page).agg(F.min("x").alias("a"), F.min("y").alias("b"), F.max("x").alias("c"), F.max("y").alias("d"), F.max("radius").alias("r"))
    return grown.select(page, (F.col("a") - F.col("r")).alias("minX"), (F.col("b") - F.col("r")).alias("minY"), (F.col("c") + F.col("r")).alias("maxX"), (F.col("d") + F.col("r")).alias("maxY"))


def ink_canvas(points: DataFrame, device_width: float, device_height: float, page: str = "page_id") -> DataFrame:
    """(page_id, width_px, height_px): the device's screen, or as far as the ink reaches with a margin, within a limit."""
    r = _reach(points, page)
    across = F.greatest(F.abs(F.coalesce("x0", F.lit(0.0))), F.abs(F.coalesce("x1", F.lit(0.0))))
    width = F.least(F.greatest(F.lit(device_width), 2 * across + 2 * INK_MARGIN), F.lit(MAX_CANVAS))
    height = F.least(F.greatest(F.lit(device_height), F.greatest(F.coalesce("y1", F.lit(0.0)), F.lit(0.0)) + INK_MARGIN), F.lit(MAX_CANVAS))
    return r.select(page, width.alias("width_px"), height.alias("height_px"))


def expanded_width(points: DataFrame, width: float, height: float, page: str = "page_id") -> DataFrame:
    """(page_id, width_px): a page steps to its height's width where ink lies beside the screen but within the step."""
    beside = finite(F.col("x")) & (F.abs("x") > width / 2) & (F.abs("x") <= height)
    return points.groupBy(page).agg(F.when(F.bool_or(beside), F.lit(height)).otherwise(F.lit(width)).alias("width_px"))


def content_bottom(points: DataFrame, rects: DataFrame, limit: float, page: str = "page_id") -> DataFrame:
    """(page_id, bottom): the lowest ink (with half its width) or highlight that is not beyond the limit."""
    ink = points.where(F.col("y") <= limit).select(page, (F.col("y") + F.col("stroke_width") / 2).alias("at"))
    marks = rects.where(F.col("y") + F.col("height") <= limit).select(page, (F.col("y") + F.col("height")).alias("at"))
    return ink.unionByName(marks).groupBy(page).agg(F.max("at").alias("bottom"))


def annotated_box(points: DataFrame, width: float, height: float, dpi: float, page: str = "page_id") -> DataFrame:
    """(page_id, x, y, width, height) in points: the paper grown on each side to the ink's reach, by its own size at most."""
    k, half, r = 72 / dpi, width / 2, _reach(points, page)

    def grow(amount: Column, cap: float) -> Column:
        return F.least(F.greatest(F.coalesce(amount, F.lit(0.0)), F.lit(0.0)), F.lit(cap * OVERHANG)) * k

    left, right = grow(-F.col("x0") - half, width), grow(F.col("x1") - half, width)
    above, below = grow(-F.col("y0"), height), grow(F.col("y1") - height, height)
    return r.select(page, (-left).alias("x"), (-below).alias("y"), (width * k + left + right).alias("width"), (height * k + above + below).alias("height"))


def text_column(lines: DataFrame, width_px: float, dpi: float, page: str = "page_id") -> DataFrame:
    """(page_id, left, right) of the printed text in scene pixels, from its lines that have text."""
    inked = lines.where(F.trim("text") != "")
    return inked.groupBy(page).agg((F.min("x") * dpi / 72 - width_px / 2).alias("left"), (F.max(F.col("x") + F.col("width")) * dpi / 72 - width_px / 2).alias("right"))
