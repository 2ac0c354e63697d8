"""A document's digest: what was marked and written on its pages, beside the text that it belongs to, under that text's headings.

Every step is a join or an aggregate by page, so pages are independent; only headings and the final text are by document.

pages: (doc_id, page_id, source_index, embed_page, appended, width, height, label): ``width`` and ``height`` of the source page in points, ``label`` null where the source has none, ``appended`` for
pages that were added on the device, and if there is one a column ``typed``: pages that the device itself laid out. lines: (page_id, ord, text, x, y, width, height) in points from the bottom left. headings: (doc_id, page_index, ord, title, x, y).
highlights: (page_id, ord, id, text, rects array<rect> in scene pixels). strokes: (page_id, ord, id, box, rect in points, is_marker, is_loop), the box in scene pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annolake.functions import geometry as G
from annolake.functions import text as T
from annolake.operators import backends, clusters, fuzzy, incremental, marks, nearest, rendering, sequences
from annolake.operators.lines import page_measures
from annolake.operators.shared import Rounds

#: The height of a line where the text tells none, in points; how near headings and highlights must be to a note, in line heights.
LINE_HEIGHT, HEADING_REACH, HIGHLIGHT_REACH = 14.0, 1.0, 3.0
OVERHANG = 1.0
ADDED, RECT = "added page", "struct<x:double,y:double,width:double,height:double>"


def page_label(label: Column, source_index: Column, appended: Column) -> Column:
    """What a page is called: its own label, else its number; nothing for a page that was added on the device."""
    return F.when(~appended, F.coalesce(label, (source_index + 1).cast("string")))


def note_region(rect: Column, fit: Column, height: Column, page: Column) -> Column:
    """The region of the drawn page, from its top left, where a rect of the source page has come to lie; null without a text to measure by."""
    scaled = G.rect(rect["x"] * fit["scale"] + fit["dx"], height - ((rect["y"] + rect["height"]) * fit["scale"] + fit["dy"]), rect["width"] * fit["scale"], rect["height"] * fit["scale"])
    return F.when(fit.isNotNull(), F.struct(page.alias("page"), *(scaled[k].alias(k) for k in ("x", "y", "width", "height"))))


def page_geometry(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """The pages with has_text and line_height: pages without readable text keep going."""
    measured = page_measures(lines).select("page_id", F.col("line_spacing").alias("_spacing"))
    there = lines.select("page_id").distinct().withColumn("_there", F.lit(True))
    known = pages.join(there, "page_id", "left").join(measured, "page_id", "left")
    out = known.select(*pages.columns, (F.coalesce("_there", F.lit(False)) & ~F.col("appended")).alias("has_text"), F.coalesce("_spacing", F.lit(LINE_HEIGHT)).alias("line_height"))
    return out


def silent_pages(pages: DataFrame, annotated: DataFrame) -> DataFrame:
    """(doc_id, page_id, kind, n): pages that have something on them and no text to put it beside. annotated: (page_id)."""
    silent = pages.where(~F.col("has_text") & ~F.col("appended")).join(annotated.select("page_id").distinct(), "page_id", "left_semi")
    return silent.select("doc_id", "page_id", F.lit("no text").alias("kind"), F.lit(1).cast("long").alias("n"))


def page_fits(pages: DataFrame, strokes: DataFrame) -> DataFrame:
    """The pages with ``fit``: where the drawn page has the source page. Ink beside the paper shrinks it; typed pages are drawn as they are."""
    reach = strokes.groupBy("page_id").agg(*(f(f"box.{k}").alias(n) for n, f, k in (("_x0", F.min, "minX"), ("_x1", F.max, "maxX"), ("_y0", F.min, "minY"), ("_y1", F.max, "maxY"))))
    known, k = pages.join(reach, "page_id", "left"), 72 / F.col("dpi")
    wide, high = F.col("width") / k, F.col("height") / k

    def grown(amount: Column, most: Column) -> Column:
        return F.least(F.greatest(F.coalesce(amount, F.lit(0.0)), F.lit(0.0)), most * OVERHANG) * k

    left, right, above, below = grown(-F.col("_x0") - wide / 2, wide), grown(F.col("_x1") - wide / 2, wide), grown(-F.col("_y0"), high), grown(F.col("_y1") - high, high)
    fit = G.page_fit(F.col("width"), F.col("height"), G.rect(-left, -below, F.col("width") + left + right, F.col("height") + above + below))
    same = F.struct(F.lit(1.0).alias("scale"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"))
    return known.select(*pages.columns, (F.when(F.col("typed"), same).otherwise(fit) if "typed" in pages.columns else fit).alias("fit"))


def unmatched(handwriting: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_id, kind, n): how many strokes of a page with a text look like marks and belong to no text."""
    on = handwriting.join(pages.where("has_text").select("page_id", "doc_id", "line_height"), "page_id")
    like = on.where(marks.reads_as_mark(F.col("rect.width"), F.col("rect.height"), F.col("is_loop"), F.col("line_height")))
    return like.groupBy("doc_id", "page_id").agg(F.lit("unmatched mark").alias("kind"), F.count("*").alias("n"))


def all_lines(printed: DataFrame, typed: DataFrame) -> DataFrame:
    """Lines of source pages and of typed pages in one form: whatever comes after does not know which it was given."""
    return printed.unionByName(typed.select(*printed.columns))


def highlight_entries(highlights: DataFrame, lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, ord, id, sentence, marked, rect, top, is_ink): a highlight with the sentence of the page's text that it covers, or with the text that the device recorded. A page that was added on
    the device has none."""
    placed = highlights.join(pages.where("NOT appended").select("page_id", "width", "height", "has_text", "dpi"), "page_id")
    frame = G.page_frame(F.col("width"), F.col("height"), F.col("dpi"))
    rects = F.transform("rects", lambda r: G.scene_rect_to_pdf(r, frame["widthPx"], frame["heightPx"], F.col("dpi")))
    top = F.coalesce(F.array_min(F.transform("rects", lambda r: r["y"])), F.lit(0.0))
    placed = placed.withColumn("_pdf", rects).withColumn("_top", top)
    found = marks.quotes(placed.where("has_text").select("page_id", "id", F.col("_pdf").alias("rects")), lines)
    both = placed.join(found, ["page_id", "id"], "left")
    return both.select(
        "page_id", "ord", "id", F.coalesce("sentence", T.one_line(F.col("text"))).alias("sentence"), F.coalesce("marked", F.array().cast("array<string>")).alias("marked"),
        F.when(F.size("_pdf") > 0, G.union_rect(F.col("_pdf"))).cast(RECT).alias("rect"), F.col("_top").alias("top"), F.lit(False).alias("is_ink"),
    )


def mark_entries(strokes: DataFrame, lines: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries like those of highlights, strokes that are handwriting): pen and marker strokes drawn at text quote it. Without a text nothing is a mark."""
    on = strokes.join(pages.where("has_text").select("page_id", "line_height"), "page_id").withColumnRenamed("id", "mark_id")
    line = lines.select("page_id", "ord", F.struct("x", "y", "width", "height").alias("line"))
    rects = marks.mark_rects(on.select("page_id", "mark_id", "rect", "is_loop", "is_marker", "line_height"), line)
    quoted = marks.quotes(rects.select("page_id", F.col("mark_id").alias("id"), F.array("rect").alias("rects")), lines)
    own = strokes.select("page_id", "ord", "id", F.col("rect").cast(RECT).alias("rect"), F.col("box.minY").alias("top"))
    entries = quoted.join(own, ["page_id", "id"]).select("page_id", "ord", "id", "sentence", "marked", "rect", "top", F.lit(True).alias("is_ink"))
    rest = strokes.where(~F.col("is_marker")).join(entries.select("page_id", "id"), ["page_id", "id"], "left_anti")
    return entries, rest


def merged(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """Entries with one for each sentence: of entries whose sentences hold one another the topmost recorded one stays (groups: (page_id, id, survivor_id)), with the longest sentence and the marks of all."""
    listed = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("ord", "marked"))), lambda s: s["marked"]))
    wide = entries.join(groups, ["page_id", "id"]).groupBy("page_id", F.col("survivor_id").alias("id")).agg(
        F.max_by("sentence", F.struct(F.length("sentence").alias("n"), (-F.col("ord")).alias("o"))).alias("sentence"), listed.alias("marked")
    )
    return entries.drop("sentence", "marked").join(wide, ["page_id", "id"])


def written_notes(strokes: DataFrame, pages: DataFrame, lines: DataFrame, recognise: backends.Recognise, steps: Rounds) -> DataFrame:
    """(page_id, id, anchor_id, text, status, rect, top): strokes that belong together, read one note at a time; what could not be read stays with an empty text. Notes in the margins of the page's
    text belong together from further away. A page that was added on the device is one note, whole."""
    k, half = F.col("dpi") / 72, F.col("width") * F.col("dpi") / 144
    inked = lines.where(F.trim("text") != "").groupBy("page_id").agg(F.min("x").alias("_left"), F.max(F.col("x") + F.col("width")).alias("_right"))
    own = pages.join(inked, "page_id", "left").select(
        "page_id", "line_height", "appended", "width", "height", "dpi", *(F.when(F.col("has_text"), F.col(c) * k - half).alias(n) for c, n in (("_left", "column_left"), ("_right", "column_right")))
    )
    on = strokes.join(own, "page_id")
    boxes = [F.col(f"box.{k}").alias(n) for k, n in (("minX", "min_x"), ("minY", "min_y"), ("maxX", "max_x"), ("maxY", "max_y"))]
    flat = on.select("page_id", "ord", "id", "appended", (F.col("line_height") * k).alias("line_height"), "column_left", "column_right", *boxes)
    parts = clusters.clustered(flat.where(~F.col("appended")).drop("appended")).select("page_id", "anchor_id", "min_x", "min_y", "max_x", "max_y", F.col("row_top").alias("top"), "strokes")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("ord", "id"))), lambda s: s["id"])
    whole = flat.where("appended").groupBy("page_id").agg(F.lit("page").alias("anchor_id"), F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"), F.lit(0.0).alias("top"), listed.alias("strokes"))
    notes = steps.write(parts.unionByName(whole).withColumn("_key", F.concat_ws(":", "page_id", "anchor_id")))  # asked for three times below
    read = backends.recognised(notes.select(F.col("_key").alias("page_id"), F.array_join("strokes", ",").cast("binary").alias("content")), recognise).withColumnRenamed("page_id", "_key")
    frame = pages.select("page_id", "width", "height", "appended", "dpi")
    scene = G.rect(F.col("min_x"), F.col("min_y"), F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    rows = F.array_join(F.filter(F.transform(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n"), T.strip), lambda x: x != ""), "\n")
    return notes.join(read, "_key").join(frame, "page_id").select(
        "page_id", T.digest_id("nt", F.col("page_id"), F.col("anchor_id")).alias("id"), "anchor_id", F.when(F.col("appended"), rows).otherwise(T.one_line(F.col("text"))).alias("text"), "status",
        G.scene_rect_to_pdf(scene, F.col("width") * k, F.col("height") * k, F.col("dpi")).cast(RECT).alias("rect"), "top", "appended",
    )


def anchored(notes: DataFrame, pages: DataFrame, headings: DataFrame, entries: DataFrame, lines: DataFrame) -> DataFrame:
    """The notes with anchor_kind (heading, highlight, line, page) and anchor: the title of a heading within a line's height, else the id of a highlight within three, else the text of the
    nearest line."""
    own = notes.join(pages.where("has_text").select("page_id", "doc_id", "source_index", "line_height"), "page_id")
    middle = F.col("rect.y") + F.col("rect.height") / 2
    ids = ["page_id", "id"]
    at = headings.where(F.col("y").isNotNull()).select("doc_id", F.col("page_index").alias("source_index"), F.col("ord").alias("h_ord"), "title", F.col("y").alias("h_y"))
    heading = nearest.nearest(own.select(*ids, "doc_id", "source_index", "line_height", "rect"), at, ["doc_id", "source_index"], ids, F.abs(middle - F.col("h_y")) / F.col("line_height"), F.col("h_ord"), F.col("title"), "answer", HEADING_REACH)
    marked = entries.where(F.col("rect").isNotNull()).select("page_id", F.col("ord").alias("e_ord"), F.col("id").alias("e_id"), F.col("rect").alias("e_rect"))
    highlight = nearest.nearest(own.select(*ids, "line_height", "rect"), marked, ["page_id"], ids, G.rect_distance(F.col("rect"), F.col("e_rect")) / F.col("line_height"), F.col("e_ord"), F.col("e_id"), "answer", HIGHLIGHT_REACH)
    printed = lines.select("page_id", F.col("ord").alias("l_ord"), F.col("text").alias("l_text"), F.struct("x", "y", "width", "height").alias("l_rect"))
    line = nearest.nearest(own.select(*ids, "rect"), printed, ["page_id"], ids, G.rect_distance(F.col("rect"), F.col("l_rect")), F.col("l_ord"), F.col("l_text"), "answer")
    tiers = [(name, found.select(*ids, "answer")) for name, found in (("heading", heading), ("highlight", highlight), ("line", line))]
    return nearest.tiered(notes, ids, tiers).withColumnsRenamed({"answer": "anchor", "kind": "anchor_kind"})


def hosted(notes: DataFrame, survivors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notes with the id of the entry that they stand under, notes that stand alone): a note beside a highlight goes where that highlight has gone."""
    host = survivors.select("page_id", F.col("id").alias("anchor"), F.col("survivor_id").alias("host_id"))
    both = notes.join(host, ["page_id", "anchor"], "left").withColumn("host_id", F.when(F.col("anchor_kind") == "highlight", F.col("host_id")))
    return both.where(F.col("host_id").isNotNull()), both.where(F.col("host_id").isNull()).drop("host_id")


def named_headings(headings: DataFrame, chapters: DataFrame | None) -> DataFrame:
    """Headings with the chapter names of the book that the pages were rendered from, where they are near enough. chapters: (doc_id, chapter)."""
    if chapters is None:
        return headings
    keyed = headings.withColumn("heading_id", F.concat_ws(":", "doc_id", "ord"))
    named = fuzzy.chapter_names(keyed.select("heading_id", "doc_id", "title"), chapters).select("heading_id", "chapter")
    return keyed.join(named, "heading_id", "left").withColumn("title", F.coalesce("chapter", "title")).select(*headings.columns)


def digest(
    pages: DataFrame, lines: DataFrame, headings: DataFrame, highlights: DataFrame, strokes: DataFrame, recognise: backends.Recognise, embed: Column, dpi: float = 226.0, chapters: DataFrame | None = None,
    bodies: DataFrame | None = None, devices: DataFrame | None = None, margin_notes: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """((doc_id, digest, status), warnings (doc_id, page_id, kind, n)). ``embed`` is the path of the drawn document, of ``doc_id``; bodies: (doc_id, body) of the book, by which quotes are corrected;
    devices: (doc_id, canvas) as of `canvas.declared_canvas`, where not all have ``dpi``. Without ``margin_notes`` nothing that is written by hand is read, and pen marks that no text answers to are
    warned of. Both results are tables in the shared folder; the steps on the way to them are deleted."""
    seen = highlights.select("page_id").unionByName(strokes.select("page_id"))
    steps, results = Rounds(pages.sparkSession, "digest"), Rounds(pages.sparkSession, "digest-result")
    told, lost = _digest(steps, pages, lines, headings, highlights, strokes, seen, recognise, embed, dpi, chapters, bodies, devices, margin_notes)
    told, lost = results.write(told), results.write(lost)
    steps.forget(0)
    return told, lost


def _digest(steps, pages, lines, headings, highlights, strokes, seen, recognise, embed, dpi, chapters, bodies, devices, margin_notes):
    pages = pages.withColumn("dpi", F.lit(dpi)) if devices is None else pages.join(devices.select("doc_id", F.col("canvas.dpi").alias("dpi")), "doc_id", "left").withColumn("dpi", F.coalesce("dpi", F.lit(dpi)))
    pages = steps.write(page_geometry(page_fits(pages, strokes), lines))
    warnings = silent_pages(pages, seen)
    headings = named_headings(headings, chapters) if chapters is None else steps.write(named_headings(headings, chapters))
    recorded = highlight_entries(highlights, lines, pages)
    drawn, handwriting = mark_entries(strokes, lines, pages)
    drawn = steps.write(drawn)
    handwriting = strokes.where(~F.col("is_marker")).join(drawn.select("page_id", "id"), ["page_id", "id"], "left_anti")
    placed = steps.write(recorded.unionByName(drawn))
    survivors = steps.write(clusters.merged_highlights(placed.select("page_id", "ord", "id", "sentence", "top", "is_ink")))
    one = steps.write(merged(placed, survivors))
    if bodies is not None:
        docs = pages.select("page_id", "doc_id")
        fixed = fuzzy.corrected(one.join(docs, "page_id").select(F.concat_ws(":", "page_id", "id").alias("quote_id"), "doc_id", F.col("sentence").alias("text")), bodies)
        one = one.withColumn("quote_id", F.concat_ws(":", "page_id", "id")).join(fixed.withColumnRenamed("sentence", "_fixed"), "quote_id", "left").withColumn("sentence", F.coalesce("_fixed", "sentence")).drop("quote_id", "_fixed")
    if not margin_notes:
        warnings, handwriting = warnings.unionByName(steps.write(unmatched(handwriting, pages))), handwriting.where("false")
    notes = steps.write(written_notes(handwriting, pages, lines, recognise, steps))
    notes = steps.write(anchored(notes, pages, headings, placed, lines))
    under, alone = hosted(notes, survivors)
    failed = notes.where(F.col("status") == "failed").join(pages.select("page_id", "doc_id"), "page_id").select("doc_id", "page_id", F.lit("not transcribed").alias("kind"), F.lit(1).cast("long").alias("n"))

    # sections of entries and of notes that no heading is beside
    where = pages.select("page_id", "doc_id", F.col("source_index").alias("page_index"), F.col("height").alias("_h"), "appended")
    spots = one.select("page_id", "id", "rect").unionByName(alone.where((F.col("anchor_kind") != "heading") & ~F.col("appended")).select("page_id", "id", "rect")).join(where, "page_id")
    entry_id = F.concat_ws(":", "page_id", "id")
    spots = spots.select("doc_id", "page_index", entry_id.alias("entry_id"), F.coalesce("rect.x", F.lit(0.0)).alias("x"), F.coalesce(F.col("rect.y") + F.col("rect.height"), "_h").alias("y"))
    printed = lines.join(where, "page_id").select("doc_id", "page_index", "ord", "x", "y", "width", "height")
    sections = steps.write(marks.sections(spots, headings, printed).select("entry_id", "section"))

    own = pages.select("page_id", "doc_id", "source_index", "embed_page", "has_text", "height", "fit", page_label(F.col("label"), F.col("source_index"), F.col("appended")).alias("_label"), embed.alias("_embed"))
    region = note_region(F.col("rect"), F.when(F.col("has_text"), F.col("fit")), F.col("height"), F.col("embed_page"))

    # notes under an entry carry no locator of their own
    said = rendering.note_entry(F.col("text"), F.lit(""), F.lit(""), F.col("id"), region)
    below = under.join(own, "page_id").groupBy("page_id", F.col("host_id").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("top", F.col("id").alias("note_id"), said.alias("said")))), lambda s: s["said"]), "\n\n").alias("_below"))
    link = lambda text: F.concat(F.lit("[["), F.col("_embed"), F.lit("#page="), F.col("embed_page").cast("string"), F.lit("|"), text, F.lit("]]"))
    locator = F.when(F.col("section").isNull(), F.lit("")).otherwise(F.concat(F.lit(" · "), link(F.when(F.col("_label").isNull(), ADDED).otherwise(F.concat(F.lit("p. "), "_label")))))
    heading = F.concat(F.lit("### "), F.when(F.col("section").isNotNull(), T.escaped(F.col("section"))).otherwise(link(F.when(F.col("_label").isNull(), "Added page").otherwise(F.concat(F.lit("Page "), "_label")))))
    quotes = one.withColumn("entry_id", entry_id).join(sections, "entry_id", "left").join(own, "page_id").join(below, ["page_id", "id"], "left").withColumn("locator", locator)
    block_id = T.digest_id("hl", F.col("page_id"), F.col("id"))
    quotes = quotes.select("doc_id", "page_id", "embed_page", "section", "top", F.lit(0).alias("kind"), "ord", heading.alias("heading"), F.concat_ws("\n\n", rendering.highlight_entry(F.col("sentence"), F.col("marked"), F.col("locator"), block_id), "_below").alias("body"))
    alone = alone.withColumn("entry_id", entry_id).join(sections, "entry_id", "left").withColumn("section", F.when(F.col("anchor_kind") == "heading", F.col("anchor")).otherwise(F.col("section")))
    alone = alone.join(own, "page_id").withColumn("locator", locator).withColumn("title", F.when(F.col("anchor_kind") == "line", T.anchor_title(F.col("anchor"))).otherwise(""))
    apart = alone.select("doc_id", "page_id", "embed_page", "section", "top", F.lit(1).alias("kind"), F.row_number().over(W.partitionBy("page_id").orderBy("top", "id")).alias("ord"), heading.alias("heading"), rendering.note_entry(F.col("text"), F.col("title"), F.col("locator"), F.col("id"), F.when(~F.col("appended"), region)).alias("body"))
    every = sequences.section_rank(quotes.unionByName(apart), ["page_id"], "section", "top", ["kind", "ord"], "_rank")
    told = rendering.digests(every, "doc_id", ["embed_page", "_rank", "top", "kind", "ord"], "heading", "body")
    status = notes.join(pages.select("page_id", "doc_id"), "page_id").groupBy("doc_id").agg(incremental.worst_status(F.col("status")).alias("status"))
    return told.join(status, "doc_id", "full_outer").select("doc_id", F.coalesce("digest", F.lit("")).alias("digest"), F.coalesce("status", F.lit("skipped")).alias("status")), warnings.unionByName(failed)
