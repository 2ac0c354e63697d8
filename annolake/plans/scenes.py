"""Queries on binary page scenes (rows written as scenes, put away as files, and read again) and on page content streams."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from annolake.operators.shared import Rounds, by_group, shared_folder
from annolake.plans.catalogue import query, table
from annolake.sources import content
from annolake.sources import scene_writer as E
from annolake.sources import scenes as S
from annolake.sources import vault as V


def _scanned(pages, results):
    """Pages (page_id, content) as files, their scenes, and what ``results`` makes of them, written; the files are deleted. Every file is read and parsed once, as ``results`` asks for several kinds of rows. The
    files are dealt over 256 folders by a hash, as ids mostly begin alike, and a task reads a folder."""
    spark = pages.sparkSession
    root, out, parsed = f"{shared_folder(spark)}/scenes-{uuid.uuid4().hex}", Rounds(spark, "scene-result"), Rounds(spark, "scene")
    V.write_files(pages, root, F.concat(F.substring(F.md5("page_id"), 1, 2), F.lit("/"), F.col("page_id"), F.lit(".rm")))
    result = out.write(results(parsed.write(S.stored(spark, root))))
    parsed.forget(0)
    V.Store(root).delete("")
    return result


def _drawn(rows: pd.DataFrame) -> Iterator[tuple]:
    """A user's events as strokes on two layers."""
    user = int(rows.user_id.iloc[0])
    blocks = [E.layer((0, 11), f"Layer of {user}", True, (1, 5), -5.0), E.layer((0, 12), "é")]
    for n, value in zip(rows.event_id.tolist(), rows.value.tolist(), strict=True):
        points = [(n % 50 + k / 2, n % 70 - k, n % 9, n % 31 + k, n % 255, n % 251) for k in range(1 + n % 3)]
        blocks.append(E.stroke((1, n), (0, 11 + n % 2), n % 24, n % 13, value, points, 0xFF000000 | n % 65536 if n % 3 == 0 else None, n % 11 == 0, 1 + n % 2))
        if n % 17 == 0:
            blocks += [E.block(S.LINE, b"\xff\xff"), E.block(0x42, b"unknown")]
    yield str(user), E.page(blocks)


@query(
    "scene_strokes",
    """
    WITH n AS (SELECT user_id, event_id AS n, value, unnest(range(0, 1 + event_id % 3)) AS k FROM events),
    s AS (SELECT user_id, n % 2 AS layer, count(DISTINCT n) AS n_strokes, sum(n % 50 + k / 2.0) AS x, sum(n % 70 - k)::DOUBLE AS y, sum(n % 9)::BIGINT AS speed, sum(n % 31 + k)::BIGINT AS width, sum(n % 255)::BIGINT AS direction, sum(n % 251)::BIGINT AS pressure,
                 sum((n % 24) * CASE WHEN k = 0 THEN 1 ELSE 0 END)::BIGINT AS pens, sum((n % 13) * CASE WHEN k = 0 THEN 1 ELSE 0 END)::BIGINT AS colours, round(sum(CASE WHEN k = 0 THEN value ELSE 0 END), 4) AS brushes,
                 sum(CASE WHEN k = 0 AND n % 3 = 0 THEN n % 65536 ELSE 0 END)::BIGINT AS rgb FROM n WHERE n % 11 <> 0 GROUP BY 1, 2),
    e AS (SELECT user_id, count(*) FILTER (event_id % 17 = 0) AS n_errors FROM events GROUP BY user_id)
    SELECT user_id::VARCHAR AS page_id, CASE WHEN layer = 0 THEN 'Layer of ' || user_id ELSE 'é' END AS name, CASE WHEN layer = 0 THEN '1:5' END AS anchor_id, CASE WHEN layer = 0 THEN -5.0 END AS origin_x, s.* EXCLUDE (user_id, layer), n_errors
    FROM s JOIN e USING (user_id)
    """,
)
def scene_strokes(spark, sf_dir):
    """The events as pen strokes of both versions, some deleted and some blocks broken: layers with their strokes, by sums over the points."""
    events = table(spark, sf_dir, "events").where("user_id IS NOT NULL").select("user_id", "event_id", "value")
    pages = by_group(events, "user_id", ["event_id"], _drawn, "page_id string, content binary")

    def results(scene):
        total = lambda field: F.aggregate("strokes", F.lit(0.0), lambda a, s: a + F.aggregate(s["points"], F.lit(0.0), lambda b, p: b + p[field].cast("double")))
        own = lambda value: F.aggregate("strokes", F.lit(0.0), lambda a, s: a + value(s).cast("double"))
        layers = S.layers(scene).where(F.size("strokes") > 0).select(
            "page_id", "name", "anchor_id", "origin_x", F.size("strokes").cast("long").alias("n_strokes"), total("x").alias("x"), total("y").alias("y"),
            *(total(c).cast("long").alias(c) for c in ("speed", "width", "direction", "pressure")), own(lambda s: s["pen"]).cast("long").alias("pens"), own(lambda s: s["color"]).cast("long").alias("colours"),
            F.round(own(lambda s: s["brush"]), 4).alias("brushes"), own(lambda s: F.coalesce(s["rgba"]["r"] * 65536 + s["rgba"]["g"] * 256 + s["rgba"]["b"], F.lit(0))).cast("long").alias("rgb"),
        )
        errors = scene.where("kind = 'error'").groupBy("page_id").agg(F.count("*").alias("n_errors"))
        return layers.join(errors, "page_id", "left").withColumn("n_errors", F.coalesce("n_errors", F.lit(0)))

    return _scanned(pages, results)


def _written(rows: pd.DataFrame) -> Iterator[tuple]:
    """A conversation as a page: turns as typed runs and as highlights, every turn an image of which every second has a name."""
    blocks, runs, styles, names, conv = [E.layer((0, 11), "one"), E.paper(1620, 2160)], [], [], [], int(rows.conv_id.iloc[0])
    for n, text in zip(rows.turn.tolist(), rows.text.fillna("").tolist(), strict=True):
        runs.append(((1, 100_000 * (n + 1)), text, 0))
        styles.append(((1, 100_000 * (n + 1)), 1 + n % 7))
        blocks.append(E.highlight((2, n + 1), (0, 11), text[:50], 3 + n % 4, [(n, 2.0 * n, 10.0, 4.5)] * (1 + n % 2), 0xFF112233 if n % 2 else None))
        picture = conv.to_bytes(8, "big") + n.to_bytes(8, "big")
        blocks.append(E.image((3, n + 1), (0, 11), picture, [(n, 1), (n + 3, 1), (n + 3, 6 + n)]))
        names += [(picture, f"{conv}-{n}.png")] if n % 2 == 0 else []
    yield f"c{conv}", E.page([*blocks, E.image_names(names), E.typed(runs, styles, -10.0, 20.0, 900.0)])


@query(
    "scene_parts",
    """
    WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
    SELECT 'c' || conv_id AS page_id, count(*) AS n_runs, md5(string_agg(text, '|' ORDER BY turn)) AS typed_md5, sum(1 + turn % 7)::BIGINT AS styles, md5(string_agg(substr(text, 1, 50), '|' ORDER BY turn)) AS highlights_md5, sum(3 + turn % 4)::BIGINT AS colours,
           sum((1 + turn % 2) * (3 * turn + 14.5)) AS rects, count(*) FILTER (turn % 2 = 1) AS n_coloured, count(*) FILTER (turn % 2 = 0) AS n_images, count(*) FILTER (turn % 2 = 1) AS n_unnamed,
           coalesce(sum(turn + 1 + 3 + 5 + turn) FILTER (turn % 2 = 0), 0)::DOUBLE AS boxes, 1620.0::DOUBLE AS paper_width
    FROM t GROUP BY conv_id
    """,
)
def scene_parts(spark, sf_dir):
    """Conversations as pages of typed text, highlights and images: what is read of each kind."""
    c = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL").select("conv_id", "turn", "text")
    pages = by_group(c, "conv_id", ["turn"], _written, "page_id string, content binary")

    def results(scene):
        joined = lambda column: F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", column))), lambda x: x[column]), "|"))
        runs = scene.where("kind = 'text'").select(
            "page_id", F.size("runs").cast("long").alias("n_runs"), F.md5(F.array_join(F.transform("runs", lambda r: r["text"]), "|")).alias("typed_md5"), F.aggregate(F.map_values("styles"), F.lit(0), lambda a, s: a + s).cast("long").alias("styles")
        )
        rect = F.aggregate("rects", F.lit(0.0), lambda a, r: a + r["x"] + r["y"] + r["width"] + r["height"])
        marks = scene.where("kind = 'highlight'").groupBy("page_id").agg(joined("text").alias("highlights_md5"), F.sum("color").cast("long").alias("colours"), F.sum(rect).alias("rects"), F.count("rgba").alias("n_coloured"))
        images = S.images(scene).groupBy("page_id").agg(F.count("*").alias("n_images"), F.sum(F.col("pos_x") + F.col("pos_y") + F.col("width") + F.col("height")).alias("boxes"))
        unnamed = S.unnamed_images(scene).groupBy("page_id").agg(F.count("*").alias("n_unnamed"))
        papers = scene.where("kind = 'paper'").groupBy("page_id").agg(F.max("width").alias("paper_width"))
        whole = runs.join(marks, "page_id").join(papers, "page_id").join(images, "page_id", "left").join(unnamed, "page_id", "left")
        return whole.fillna({"n_images": 0, "n_unnamed": 0, "boxes": 0.0})

    return _scanned(pages, results)


@query(
    "stream_text",
    """
    WITH p AS (SELECT page_id, page_id % 97 AS k, split_part(url, '/', 3) AS host, split_part(url, '/', 4) AS lang FROM pages WHERE url IS NOT NULL),
    i AS (
      SELECT page_id, 1 AS n, host AS text, 10.0 + 2 * (5 + k) AS x, 20.0 + 2 * 700 AS y, 12.0 * length(host) AS width, 24.0 AS height FROM p UNION ALL
      SELECT page_id, 2, lang, 10.0 + 2 * (5 + k + 6 * length(host) + 3.6), 20.0 + 2 * 700, 12.0 * length(lang), 24.0 FROM p UNION ALL
      SELECT page_id, 3, lang || '.', 10.0 + 2 * (5 + k), 20.0 + 2 * (700 - 14), 12.0 * (length(lang) + 1), 24.0 FROM p UNION ALL
      SELECT page_id, 4, 'tail', 10.0 + 2 * 3, 20.0 + 2 * k, 4 * 0.5 * 10 * 2, 20.0 FROM p
    )
    SELECT page_id::VARCHAR AS page_id, n::BIGINT AS n, text, round(x::DOUBLE, 3) AS x, round(y::DOUBLE, 3) AS y, round(width::DOUBLE, 3) AS width, round(height::DOUBLE, 3) AS height FROM i
    """,
)
def stream_text(spark, sf_dir):
    """Every web page's address as a content stream with nested states: where its parts stand."""
    p = table(spark, sf_dir, "pages").where("url IS NOT NULL").select("page_id", F.split("url", "/")[2].alias("host"), F.split("url", "/")[3].alias("lang"), (F.col("page_id") % 97).cast("string").alias("k"))
    source = F.concat(
        F.lit("q 2 0 0 2 10 20 cm /F2 10 Tf q 1 0 0 1 5 0 cm\nBT /F1 12 Tf 14 TL 1 0 0 1 "), "k", F.lit(" 700 Tm [("), "host", F.lit(") -300 ("), "lang", F.lit(")] TJ ("), "lang", F.lit(".) ' ET Q % back\nBT 3 "), "k", F.lit(" Td (tail) Tj ET Q")
    )
    items, _ = content.text_items(p.select(F.col("page_id").cast("string").alias("page_id"), source.cast("binary").alias("content")))
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("page_id").orderBy("ord")).cast("long")
    return items.select("page_id", n.alias("n"), "text", *(F.round(c, 3).alias(c) for c in ("x", "y", "width", "height")))
