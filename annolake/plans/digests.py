"""A query on the composed digest: every web page as a document of one page with a heading, three lines, a highlight, a pen mark and a note."""

from __future__ import annotations

from pyspark.sql import functions as F

from annolake.functions import geometry as G
from annolake.operators import backends, digest
from annolake.plans.catalogue import query, table

_HOST = "split_part(url, '/', 3)"


def inputs(spark, sf_dir):
    """The tables of `digest.digest`. Every fifth page has no text; every seventh was added on the device, and what is highlighted there goes nowhere."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("k"), F.split("url", "/")[2].alias("host"))
    k = F.col("k")
    page = k.cast("string").alias("page_id")
    n = lambda x: F.lit(float(x))
    pages = p.select(F.concat(F.lit("d"), k.cast("string")).alias("doc_id"), page, F.lit(0).alias("source_index"), F.lit(1).alias("embed_page"), (k % 7 == 0).alias("appended"), n(400).alias("width"), n(600).alias("height"), F.when(k % 2 == 0, F.lit("iv")).alias("label"))
    texted = p.where((k % 5 != 0) & (k % 7 != 0))
    text = lambda i: F.concat(F.lit(("Here is ", "This stands on ", "That was ")[i]), F.col("host"), F.lit(f" in line {i}."))
    lines = texted.select(page, F.inline(F.array(*(F.struct(F.lit(i).alias("ord"), text(i).alias("text"), n(50).alias("x"), n(500 - 20 * i).alias("y"), n(200).alias("width"), n(12).alias("height")) for i in range(3)))))
    headings = texted.select(F.concat(F.lit("d"), k.cast("string")).alias("doc_id"), F.lit(0).alias("page_index"), F.lit(0).alias("ord"), F.concat(F.lit("About "), "host").alias("title"), n(50).alias("x"), n(560).alias("y"))
    px = 226 / 72
    scene = lambda x, y, w, h: G.rect(n((x - 200) * px), n((600 - y - h) * px), n(w * px), n(h * px))
    highlights = p.select(page, F.lit(0).alias("ord"), F.lit("h1").alias("id"), F.lit("  as the device \n told").alias("text"), F.array(scene(50, 480, 200, 12)).alias("rects"))

    def stroke(i, name, x, y, w, h, marker=False):
        s = scene(x, y, w, h)
        box = G.box(s["x"], s["y"], s["x"] + s["width"], s["y"] + s["height"])
        return F.struct(F.lit(i).alias("ord"), F.lit(name).alias("id"), box.alias("box"), G.rect(n(x), n(y), n(w), n(h)).alias("rect"), F.lit(marker).alias("is_marker"), F.lit(False).alias("is_loop"))

    strokes = p.select(page, F.inline(F.array(stroke(1, "1:1", 50, 459, 200, 1), stroke(2, "1:2", 300, 300, 30, 14), stroke(3, "1:3", 335, 300, 20, 12))))
    return pages, lines, headings, highlights, strokes


def read(content: bytes) -> str:
    return f"note of {bytes(content).decode().count(',') + 1} strokes"


@query(
    "digest_pipeline",
    f"""
    WITH p AS (SELECT page_id, page_id % 7 = 0 AS added, page_id % 5 <> 0 AND page_id % 7 <> 0 AS texted, {_HOST} AS host FROM pages)
    SELECT 'd' || page_id AS doc_id, CASE WHEN added THEN 0 WHEN texted THEN 2 ELSE 1 END::BIGINT AS n_quotes, CASE WHEN texted OR added THEN 1 ELSE 2 END::BIGINT AS n_notes, 'ok' AS status,
           CASE WHEN added THEN '### [[e.pdf#page=1|Added page]]' WHEN texted THEN '### About ' || host WHEN page_id % 2 = 0 THEN '### [[e.pdf#page=1|Page iv]]' ELSE '### [[e.pdf#page=1|Page 1]]' END AS heading,
           CASE WHEN added THEN '' WHEN texted THEN 'This stands on ' || host || ' in line 1.' ELSE 'as the device told' END AS quote,
           CASE WHEN added THEN 'note of 3 strokes' ELSE 'note of 2 strokes' END AS said, CASE WHEN NOT added AND NOT texted THEN 1 ELSE 0 END::BIGINT AS n_warnings FROM p
    """,
)
def digest_pipeline(spark, sf_dir):
    pages, lines, headings, highlights, strokes = inputs(spark, sf_dir)
    told, warnings = digest.digest(pages, lines, headings, highlights, strokes, backends.per_page(read), F.lit("e.pdf"))
    count = lambda what: F.regexp_count("digest", F.lit(what)).cast("long")
    warned = warnings.groupBy("doc_id").agg(F.count("*").alias("n_warnings"))
    out = told.select(
        "doc_id", count(r"(?m)\^hl-[0-9a-f]{6}$").alias("n_quotes"), count(r"(?m) \^nt-[0-9a-f]{6}$").alias("n_notes"), "status", F.regexp_extract("digest", r"\A\n(###[^\n]*)", 1).alias("heading"),
        F.regexp_extract("digest", r"\A\n###[^\n]*\n\n((?!>)[^\n]*?)(?: · [^\n]*)?\n\^hl-", 1).alias("quote"), F.regexp_extract("digest", r"(note of [23] strokes)", 1).alias("said"),
    )
    return out.join(warned, "doc_id", "left").withColumn("n_warnings", F.coalesce("n_warnings", F.lit(0)))
