"""Strokes as pixels without a bitmap: rows of a page as runs of ink.

A stroke is drawn as discs along its segments, close enough to leave no gaps; a disc is one run of pixels on each row that it touches, so ink is spans (page, y, x0, x1), and overlapping ones become one by a
window over a row. Everything is arithmetic on rows of tables; a page's ink is a few thousand spans where its bitmap is millions of pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annolake.functions.geometry import finite
from annolake.functions.text import clamp

# Fixed values of drawing: the unit of a recorded width, limits of a radius, the width of a stroke that records none, the page in pixels, how far from it a point counts, and the largest raster.
WIDTH_UNITS, MIN_RADIUS, MAX_RADIUS, PLAIN_WIDTH = 4, 0.5, 50.0, 2.0
PAGE, MARGIN, MAX_RASTER = (1404, 1872), 4000, 6000
#: Points of a task, about: each makes tens of spans, which a task holds to unite them.
POINTS = 1 << 16


def radius_of(width: Column, is_marker: Column, brush: Column) -> Column:
    """What a point of a stroke is drawn with: its own width, except of markers, which would bury the words, and of points that record none."""
    plain = F.when(brush > 0, brush).otherwise(PLAIN_WIDTH) / 2
    return clamp(F.when(~is_marker & (width > 0), width / (2 * WIDTH_UNITS)).otherwise(plain), MIN_RADIUS, MAX_RADIUS)


def placed_points(points: DataFrame) -> DataFrame:
    """(page_id, stroke_id, ord, x, y, r) of (page_id, stroke_id, ord, x, y, width, is_marker, brush); points far off the page are pulled to its margin."""
    pulled = [clamp(F.col(c), float(-MARGIN), float(size + MARGIN)).alias(c) for c, size in zip("xy", PAGE, strict=True)]
    return points.where(finite(F.col("x")) & finite(F.col("y"))).select("page_id", "stroke_id", "ord", *pulled, radius_of(F.col("width"), F.col("is_marker"), F.coalesce("brush", F.lit(0.0))).alias("r"))


def raster_bounds(placed: DataFrame, padding: int = 0) -> DataFrame:
    """(page_id, left, top, width, height): the box of a page's ink, grown by its widest radius and by ``padding``: the raster's origin in the scene and its size in pixels."""
    box = placed.groupBy("page_id").agg(F.min("x").alias("a"), F.min("y").alias("b"), F.max("x").alias("c"), F.max("y").alias("d"), F.max("r").alias("r"))
    size = lambda low, high: (F.least(F.greatest(F.ceil(F.col(high) - F.col(low) + 2 * F.col("r")), F.lit(1)), F.lit(MAX_RASTER)) + 2 * padding).cast("int")
    return box.select("page_id", (F.col("a") - F.col("r") - padding).alias("left"), (F.col("b") - F.col("r") - padding).alias("top"), size("a", "c").alias("width"), size("b", "d").alias("height"))


def discs(placed: DataFrame, bounds: DataFrame) -> DataFrame:
    """(page_id, cx, cy, r, width, height) in pixels: along each segment, with the wider radius of its ends, as many as leave no gap; a stroke of one point is one disc."""
    w = W.partitionBy("page_id", "stroke_id").orderBy("ord")
    ends = placed.select("*", *(F.lag(c).over(w).alias(f"_{c}") for c in ("x", "y", "r")), F.count("*").over(W.partitionBy("page_id", "stroke_id")).alias("_n"))
    ends = ends.where(F.col("_x").isNotNull() | (F.col("_n") == 1)).join(bounds, "page_id")
    x, y = F.col("x") - F.col("left"), F.col("y") - F.col("top")
    from_x, from_y = F.coalesce(F.col("_x") - F.col("left"), x), F.coalesce(F.col("_y") - F.col("top"), y)
    r = F.greatest("r", F.coalesce("_r", "r"))
    far = F.hypot(x - from_x, y - from_y)
    lined = ends.select("page_id", "width", "height", x.alias("x"), y.alias("y"), from_x.alias("fx"), from_y.alias("fy"), r.alias("r"), F.when(F.col("_x").isNull(), 0).otherwise(F.greatest(F.lit(1), F.ceil(far / r))).cast("int").alias("steps"))
    t = F.when(F.col("steps") > 0, F.col("step") / F.col("steps")).otherwise(F.lit(0.0))
    stepped = lined.withColumn("step", F.explode(F.sequence(F.lit(0), F.col("steps"))))
    return stepped.select("page_id", "width", "height", "r", (F.col("fx") + (F.col("x") - F.col("fx")) * t).alias("cx"), (F.col("fy") + (F.col("y") - F.col("fy")) * t).alias("cy"))


def spans_of(discs_: DataFrame) -> DataFrame:
    """(page_id, y, x0, x1): each disc's run of pixels, ends included, on each row of the raster that it touches."""
    cy, cx, r = F.col("cy"), F.col("cx"), F.col("r")
    low, high = F.greatest(F.lit(0), F.floor(cy - r)).cast("int"), F.least(F.col("height") - 1, F.ceil(cy + r)).cast("int")
    rows = discs_.withColumn("y", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))))
    dy = F.col("y") - cy
    rows = rows.withColumn("_s", r * r - dy * dy).where("_s >= 0").withColumn("_s", F.sqrt("_s"))

    def inked(x: Column) -> Column:
        return (x - cx) * (x - cx) + dy * dy <= r * r

    # the root can be off by a hair: the pixel beside is asked by the very test of the disc
    def edge(x: Column, out: int) -> Column:
        return F.when(inked(x + out), x + out).when(inked(x), x).when(inked(x - out), x - out)

    ends = rows.select("page_id", "y", "width", edge(F.ceil(cx - F.col("_s")), -1).alias("a"), edge(F.floor(cx + F.col("_s")), 1).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return ends.select("page_id", "y", F.greatest("a", F.lit(0)).cast("int").alias("x0"), F.least("b", F.col("width") - 1).cast("int").alias("x1")).where("x0 <= x1")


def united(spans: DataFrame) -> DataFrame:
    """(page_id, y, x0, x1): spans that overlap or touch as one."""
    one = spans.groupBy("page_id", "y", "x0").agg(F.max("x1").alias("x1"))
    w = W.partitionBy("page_id", "y").orderBy("x0")
    reach = F.max("x1").over(w.rowsBetween(W.unboundedPreceding, -1))
    begun = one.withColumn("_new", (reach.isNull() | (F.col("x0") > reach + 1)).cast("int"))
    numbered = begun.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return numbered.groupBy("page_id", "y", "_run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_run")


def rasterised(points: DataFrame, padding: int = 0) -> tuple[DataFrame, DataFrame]:
    """(runs of ink (page_id, y, x0, x1), bounds as of `raster_bounds`) of each page that has any. The points are counted first: pages are dealt to more tasks where there are more of them, so what a task holds does
    not grow with the table."""
    least = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = placed_points(points).repartition(max(least, -(-points.count() // POINTS)), "page_id")
    bounds = raster_bounds(placed, padding)
    return united(spans_of(discs(placed, bounds))), bounds


def run_lengths(runs: DataFrame, bounds: DataFrame) -> DataFrame:
    """(page_id, width, height, rows): a page's raster as one value: for each row with ink its number and the ends of its runs."""
    row = runs.groupBy("page_id", "y").agg(F.sort_array(F.collect_list(F.struct("x0", "x1"))).alias("runs"))
    page = row.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("y", "runs"))).alias("rows"))
    return bounds.select("page_id", "width", "height").join(page, "page_id")
