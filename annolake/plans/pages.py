"""Queries on pages: canvases, marks, sections, typed text, recognition and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from annolake.functions import geometry as G
from annolake.operators import backends, canvas, marks, raster, typed
from annolake.plans.catalogue import query, table


def _points(spark, sf_dir):
    """Vectors as points of the page of their label."""
    e = lambda i, k: F.floor(F.col("embedding")[i].cast("double") * k).cast("double")
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("page_id"), "vec_id", e(0, 4000).alias("x"), e(1, 4000).alias("y"), (F.col("vec_id") % 9).cast("double").alias("radius"))


_P = "p AS (SELECT label::VARCHAR AS page_id, vec_id, floor(embedding[1]::DOUBLE * 4000) AS x, floor(embedding[2]::DOUBLE * 4000) AS y, (vec_id % 9)::DOUBLE AS radius FROM embeddings)"


@query(
    "annotated_box",
    f"""
    WITH {_P}, r AS (SELECT page_id, least(greatest(max(-x) - 702, 0), 1404) AS l, least(greatest(max(x) - 702, 0), 1404) AS r, least(greatest(max(-y), 0), 1872) AS a, least(greatest(max(y) - 1872, 0), 1872) AS b FROM p GROUP BY page_id)
    SELECT page_id, -l AS x, -b AS y, 1404 + l + r AS width, 1872 + a + b AS height FROM r
    """,
)
def annotated_box(spark, sf_dir):
    return canvas.annotated_box(_points(spark, sf_dir), 1404.0, 1872.0, 72.0)


@query(
    "ink_canvas",
    f"WITH {_P} SELECT page_id, least(greatest(1404, 2 * max(abs(x)) + 48), 20000)::DOUBLE AS width_px, least(greatest(1872, greatest(max(y), 0) + 24), 20000)::DOUBLE AS height_px FROM p GROUP BY page_id",
)
def ink_canvas(spark, sf_dir):
    return canvas.ink_canvas(_points(spark, sf_dir), 1404.0, 1872.0)


@query("ink_bounds", f'WITH {_P} SELECT page_id, min(x) - max(radius) AS "minX", min(y) - max(radius) AS "minY", max(x) + max(radius) AS "maxX", max(y) + max(radius) AS "maxY" FROM p GROUP BY page_id')
def ink_bounds(spark, sf_dir):
    return canvas.ink_bounds(_points(spark, sf_dir))


@query("device_canvas", f"WITH {_P} SELECT page_id, CASE WHEN bool_or(abs(x) > 702 AND abs(x) < 1620) THEN 1620.0::DOUBLE ELSE 1404.0::DOUBLE END AS width FROM p GROUP BY page_id")
def device_canvas(spark, sf_dir):
    return canvas.detected_canvas(_points(spark, sf_dir), "page_id").select("page_id", F.col("canvas.widthPx").alias("width"))


_L = "l AS (SELECT label::VARCHAR AS page_id, vec_id AS ord, (vec_id % 7 * 30)::DOUBLE AS x, (vec_id * 3 % 997)::DOUBLE AS y, (60 + vec_id % 5 * 40)::DOUBLE AS w, (10 + vec_id % 3)::DOUBLE AS h FROM embeddings WHERE vec_id % 2 = 0), m AS (SELECT label::VARCHAR AS page_id, vec_id AS id, (vec_id % 11 * 20)::DOUBLE AS x, (vec_id * 7 % 997)::DOUBLE AS y, (20 + vec_id % 4 * 30)::DOUBLE AS w, (1 + vec_id % 5)::DOUBLE AS h, vec_id % 3 = 0 AS mk FROM embeddings WHERE vec_id % 2 = 1)"


@query(
    "underline_match",
    f"""
    WITH {_L}, c AS (SELECT m.page_id, m.id, l.ord, l.y AS ly, l.h AS lh, CASE WHEN mk THEN 0 ELSE (l.y - m.y - m.h) / 12 END AS g FROM m JOIN l ON l.page_id = m.page_id
      AND greatest(0, least(m.x + m.w, l.x + l.w) - greatest(m.x, l.x)) / m.w >= 0.5
      AND CASE WHEN mk THEN m.y >= l.y AND m.y + m.h <= l.y + l.h ELSE (l.y - m.y - m.h) / 12 BETWEEN -0.1 AND 0.6 END WHERE m.w >= 30 AND m.h < 0.4 * 12),
    r AS (SELECT *, row_number() OVER (PARTITION BY page_id, id ORDER BY g, ord) AS k FROM c)
    SELECT page_id, id::VARCHAR AS mark_id, ly AS y, lh AS height FROM r WHERE k = 1
    """,
)
def underline_match(spark, sf_dir):
    e, v = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    d = lambda c: c.cast("double")
    lines = e.where("vec_id % 2 = 0").select(F.col("label").cast("string").alias("page_id"), v.alias("ord"), G.rect(d(v % 7 * 30), d(v * 3 % 997), d(60 + v % 5 * 40), d(10 + v % 3)).alias("line"))
    own = e.where("vec_id % 2 = 1").select(
        F.col("label").cast("string").alias("page_id"), v.cast("string").alias("mark_id"), G.rect(d(v % 11 * 20), d(v * 7 % 997), d(20 + v % 4 * 30), d(1 + v % 5)).alias("rect"),
        F.lit(False).alias("is_loop"), (v % 3 == 0).alias("is_marker"), F.lit(12.0).alias("line_height"),
    ).where("rect.height < 0.4 * 12")
    return marks.mark_rects(own, lines).select("page_id", "mark_id", F.col("rect.y").alias("y"), F.col("rect.height").alias("height"))


@query(
    "section_asof",
    """
    WITH b AS (SELECT label::VARCHAR AS doc_id, vec_id % 5 AS page, vec_id AS ord, (vec_id % 7 * 30)::DOUBLE AS x, (vec_id * 3 % 997)::DOUBLE AS y FROM embeddings),
    r AS (
      SELECT p.*, l.ord AS rank FROM b p JOIN b l ON l.doc_id = p.doc_id AND l.page = p.page WHERE p.ord % 4 = 1 OR p.ord % 9 = 0
      QUALIFY row_number() OVER (PARTITION BY p.ord ORDER BY sqrt(greatest(l.x - p.x, p.x - l.x - 100, 0) ** 2 + greatest(l.y - p.y, p.y - l.y - 10, 0) ** 2), l.ord) = 1
    ),
    e AS (SELECT * FROM r WHERE ord % 4 = 1), h AS (SELECT *, 'H' || ord AS title FROM r WHERE ord % 9 = 0),
    here AS (SELECT e.ord, h.title FROM e JOIN h ON h.doc_id = e.doc_id AND h.page = e.page AND (h.rank < e.rank OR (h.rank = e.rank AND h.y >= e.y)) QUALIFY row_number() OVER (PARTITION BY e.ord ORDER BY h.rank DESC, h.ord DESC) = 1),
    carried AS (SELECT e.ord, h.title FROM e JOIN h ON h.doc_id = e.doc_id AND h.page < e.page QUALIFY row_number() OVER (PARTITION BY e.ord ORDER BY h.page DESC, h.y, h.ord DESC) = 1)
    SELECT e.doc_id, e.ord::VARCHAR AS entry_id, coalesce(here.title, carried.title) AS section FROM e LEFT JOIN here USING (ord) LEFT JOIN carried USING (ord)
    """,
)
def section_asof(spark, sf_dir):
    """Entries under headings in reading order."""
    e, v = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    base = e.select(F.col("label").cast("string").alias("doc_id"), (v % 5).cast("int").alias("page_index"), v.cast("int").alias("ord"), (v % 7 * 30).cast("double").alias("x"), (v * 3 % 997).cast("double").alias("y"))
    lines = base.withColumn("width", F.lit(100.0)).withColumn("height", F.lit(10.0))
    headings = base.where("ord % 9 = 0").withColumn("title", F.concat(F.lit("H"), F.col("ord").cast("string")))
    entries = base.where("ord % 4 = 1").select("doc_id", "page_index", F.col("ord").cast("string").alias("entry_id"), "x", "y")
    return marks.sections(entries, headings, lines)


def _typed(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    run = F.struct(F.concat(F.lit("1:"), (F.col("turn") * 100000000).cast("string")).alias("id"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("text"), F.when(F.col("role") == "system", 1).otherwise(0).alias("deleted"), F.col("turn").alias("turn"))
    runs = F.transform(F.sort_array(F.collect_list(F.struct(F.col("turn").alias("t"), run.alias("r")))), lambda s: F.struct(s["r"]["id"].alias("id"), s["r"]["text"].alias("text"), s["r"]["deleted"].alias("deleted")))
    pages = c.groupBy(F.col("conv_id").cast("string").alias("page_id")).agg(runs.alias("runs"))
    return pages.select("page_id", "runs", F.create_map(F.lit("0:0"), F.lit(3)).alias("styles"), F.lit(-600.0).alias("pos_x"), F.lit(100.0).alias("pos_y"), F.lit(1200.0).alias("width"))


@query("live_characters", "SELECT conv_id::VARCHAR AS page_id, sum(length(coalesce(text, '')) + 1)::BIGINT AS n FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def live_characters(spark, sf_dir):
    return typed.live_characters(_typed(spark, sf_dir)).groupBy("page_id").agg(F.count("*").alias("n"))


@query("typed_layout")
def typed_layout(spark, sf_dir):
    return typed.laid_out(_typed(spark, sf_dir), {"e": 5.5, " ": 2.5}, 6.0)


@query("recognition", "SELECT conv_id || ':' || turn AS page_id, CASE WHEN role = 'system' THEN 'skipped' WHEN turn % 5 = 4 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN role <> 'system' AND turn % 5 <> 4 THEN replace(text, 'e', 'E') ELSE '' END AS text FROM conversations")
def recognition(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    content = F.when(F.col("role") != "system", F.concat(F.when(F.col("turn") % 5 == 4, "!").otherwise("+"), F.col("text")).cast("binary"))
    pages = c.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("page_id"), content.alias("content"))

    def read(raw: bytes) -> str:
        text = bytes(raw).decode()
        if text[0] == "!":
            raise ValueError("unreadable")
        return text[1:].replace("e", "E")

    return backends.recognised(pages, backends.per_page(read))


@query(
    "run_gates",
    """
    WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS label, (8 + o_orderkey % 24)::BIGINT * 1073741824 AS bytes, CASE o_orderkey % 3 WHEN 0 THEN 'darwin' WHEN 1 THEN 'win32' ELSE 'linux' END AS platform FROM orders)
    SELECT k AS o_orderkey, CASE WHEN k % 17 = 0 THEN 'auto-sync-off' WHEN k % 2 = 0 THEN 'already-running' WHEN k % 3 = 0 THEN 'not-connected' WHEN k % 5 = 0 THEN 'no-background-consent' END AS blocked,
           CASE WHEN k % 4 = 0 AND k % 3 <> 0 THEN 'no-consent-to-spend' END AS spend,
           CASE WHEN k % 4 = 0 THEN 'vision' ELSE 'unavailable' END AS use,
           CASE WHEN k % 7 = 0 THEN NULL WHEN k % 4 = 0 THEN label || ' needs a licence — using the local reader for this run.' ELSE label || ' needs a licence.' END AS gated_notice,
           CASE WHEN k % 7 <> 0 AND k % 4 = 0 THEN 'No API key set for ' || label || ' — using the local reader for this run.' END AS key_notice,
           CASE WHEN platform = 'linux' OR k % 13 = 0 THEN 'architecture' WHEN bytes < (CASE platform WHEN 'darwin' THEN 17 ELSE 23 END)::BIGINT * 1073741824 THEN 'memory' END AS model FROM o
    """,
)
def run_gates(spark, sf_dir):
    k, label = F.col("o_orderkey"), F.col("o_orderstatus")
    platform = F.when(k % 3 == 0, "darwin").when(k % 3 == 1, "win32").otherwise("linux")
    gated, bare = backends.gated_fallback(label, k % 4 == 0, k % 7 == 0), backends.unconfigured_fallback(label, k % 4 == 0, k % 7 == 0)
    model = backends.model_block(platform, F.when(k % 13 == 0, "x64").otherwise("arm64"), (8 + k % 24) * (1 << 30))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", backends.background_blocked(k % 17 != 0, k % 2 == 0, k % 3 != 0, k % 5 != 0).alias("blocked"), backends.spend_blocked(k % 4 == 0, k % 3 == 0).alias("spend"),
        gated["use"].alias("use"), gated["notice"].alias("gated_notice"), bare["notice"].alias("key_notice"), model["kind"].alias("model"),
    )


@query(
    "model_states",
    """
    SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'corrupt' WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'downloading' ELSE 'partial' END WHEN o_orderkey % 7 = 0 THEN 'absent'
           WHEN o_orderkey % 3 = 0 THEN 'verifying' WHEN o_orderkey % 13 = 0 THEN 'absent' WHEN o_orderkey % 4 = 0 THEN 'removed' ELSE 'ready' END AS state,
           CASE WHEN o_orderkey % 9 = 0 THEN 'keep' WHEN o_orderkey % 4 = 0 THEN 'offer' WHEN o_orderkey % 5 = 0 THEN 'delete' ELSE 'keep' END AS cleanup FROM orders
    """,
)
def model_states(spark, sf_dir):
    k, o = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    snapshot = F.struct(
        (k % 11 == 0).alias("corrupt"), (k % 5 == 0).alias("part_present"), F.when(k % 2 == 0, 950_000).when(k % 6 == 1, 10).cast("long").alias("lock_held_at_ms"), F.lit(1_000_000).alias("now_ms"),
        F.when(k % 7 != 0, F.when(k % 13 == 0, 99).otherwise(100)).alias("model_bytes"), F.lit(50).alias("mmproj_bytes"), (k % 3 != 0).alias("verified_present"), (k % 4 != 0).alias("runtime_present"),
    )
    states = o.select("o_orderkey", backends.model_state(snapshot, 100, 50).alias("state"))
    folders = o.select(k.cast("string").alias("id"), F.when(k % 9 == 0, "pinned").otherwise(k.cast("string")).alias("name"), (k % 4 == 0).alias("complete"), (k % 5 == 0).alias("has_part"))
    plan = backends.cleanup_plan(folders.where("name <> 'pinned'"), "pinned").select(F.col("name").cast("long").alias("o_orderkey"), F.col("action").alias("cleanup"))
    return states.join(plan, "o_orderkey", "left").select("o_orderkey", "state", F.coalesce("cleanup", F.lit("keep")).alias("cleanup"))


@query(
    "inserted_lines",
    """
    WITH l AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) - 1 AS ord, value AS center, event_id FROM events WHERE event_id % 3 > 0),
    x AS (SELECT e.user_id, e.event_id, e.value, coalesce((SELECT min(l.ord) FROM l WHERE l.user_id = e.user_id AND l.center < e.value), 2147483647) AS spot FROM events e WHERE event_id % 3 = 0),
    a AS (SELECT user_id, ord AS spot, 1 AS own, 0 AS c, ord AS n, event_id FROM l UNION ALL SELECT user_id, spot, 0, -value, event_id, event_id FROM x)
    SELECT user_id::VARCHAR AS page_id, row_number() OVER (PARTITION BY user_id ORDER BY spot, own, c, n) - 1 AS ord, event_id::VARCHAR AS text FROM a
    """,
)
def inserted_lines(spark, sf_dir):
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("page_id"), F.col("value").alias("center"), F.col("event_id").cast("string").alias("text"), "event_id")
    order = W.partitionBy("page_id").orderBy(F.col("center").desc(), "event_id")
    lines = e.where("event_id % 3 > 0").withColumn("ord", (F.row_number().over(order) - 1).cast("long"))
    return backends.inserted_lines(lines, e.where("event_id % 3 = 0").withColumn("ord", F.col("event_id"))).select("page_id", F.col("ord").cast("long").alias("ord"), "text")


_INK = """
    pts AS (SELECT user_id AS page_id, event_id // 6 AS stroke_id, event_id AS ord, (event_id * 37 % 101) / 2.0 AS x, (event_id * 53 % 67) / 2.0 AS y, greatest(least((CASE WHEN value > 0 THEN value % 24 ELSE 0 END) / 8.0, 50), 0.5) AS w8, value > 0 AND value % 24 > 0 AS own FROM events),
    p AS (SELECT page_id, stroke_id, ord, x, y, CASE WHEN own THEN w8 ELSE 1.0 END AS r FROM pts),
    b AS (SELECT page_id, min(x) - max(r) AS l, min(y) - max(r) AS t, least(greatest(ceil(max(x) - min(x) + 2 * max(r)), 1), 6000)::INT AS width, least(greatest(ceil(max(y) - min(y) + 2 * max(r)), 1), 6000)::INT AS height FROM p GROUP BY page_id),
    s AS (SELECT *, lag(x) OVER w AS fx, lag(y) OVER w AS fy, lag(r) OVER w AS fr, count(*) OVER (PARTITION BY page_id, stroke_id) AS n FROM p WINDOW w AS (PARTITION BY page_id, stroke_id ORDER BY ord)),
    seg AS (SELECT page_id, width, height, x - l AS x, y - t AS y, coalesce(fx - l, x - l) AS fx, coalesce(fy - t, y - t) AS fy, greatest(r, coalesce(fr, r)) AS r, fx IS NULL AS single FROM s JOIN b USING (page_id) WHERE fx IS NOT NULL OR n = 1),
    st AS (SELECT *, CASE WHEN single THEN 0 ELSE greatest(1, ceil(sqrt((x - fx) * (x - fx) + (y - fy) * (y - fy)) / r))::INT END AS steps FROM seg),
    d AS (SELECT page_id, width, height, r, fx + (x - fx) * k AS cx, fy + (y - fy) * k AS cy FROM (SELECT *, CASE WHEN steps = 0 THEN 0 ELSE unnest(range(0, steps + 1)) / steps::DOUBLE END AS k FROM st)),
    ys AS (SELECT *, unnest(range(greatest(0, floor(cy - r)::INT), least(height - 1, ceil(cy + r)::INT) + 1)) AS py FROM d),
    px AS (SELECT *, unnest(range(greatest(0, floor(cx - r)::INT), least(width - 1, ceil(cx + r)::INT) + 1)) AS qx FROM ys)"""


@query(
    "ink_rows",
    f"""
    WITH {_INK}, ink AS (SELECT DISTINCT page_id, py, qx FROM px WHERE (qx - cx) * (qx - cx) + (py - cy) * (py - cy) <= r * r)
    SELECT page_id, width, height, count(*) AS n_pixels, count(DISTINCT py) AS n_rows, sum(qx * 7 + py * 13)::BIGINT AS checksum FROM ink JOIN b USING (page_id) GROUP BY page_id, width, height
    """,
)
def ink_rows(spark, sf_dir):
    """Every six events of a user as a stroke: the ink's pixels, counted from runs; the SQL draws them one by one."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    value = F.when(F.col("value") > 0, F.col("value") % 24).otherwise(F.lit(0.0))
    points = e.select(F.col("user_id").alias("page_id"), F.floor(k / 6).alias("stroke_id"), k.alias("ord"), (k * 37 % 101 / 2).alias("x"), (k * 53 % 67 / 2).alias("y"), value.alias("width"), F.lit(False).alias("is_marker"), F.lit(2.0).alias("brush"))
    runs, bounds = raster.rasterised(points)
    n = (F.col("x1") - F.col("x0") + 1).cast("long")
    sums = runs.groupBy("page_id").agg(F.sum(n).alias("n_pixels"), F.count_distinct("y").alias("n_rows"), F.sum(((F.col("x0") + F.col("x1")) * n / 2 * 7 + F.col("y") * n * 13).cast("long")).alias("checksum"))
    return bounds.select("page_id", "width", "height").join(sums, "page_id")
