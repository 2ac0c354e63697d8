"""Typed text: live characters, and their layout on the page. One page's text is one bounded group for the layout fold."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the device's layout, in pixels.
GAP, TOP, INDENT, FIRST = 24.0, 33.8, 48.0, "0:0"
LEADING, ABOVE = {1: 45.5, 3: 58.1, 4: 45.5}, {2: 28.2, 3: 34.4}
PLAIN, HEADING, LIST = 1, 3, 4

LINES = "page_id string, ord int, text string, x double, y double, style int, first boolean"


def live_characters(text: DataFrame) -> DataFrame:
    """(page_id, ord, char_id, char) of (page_id, runs array<struct<id, text, deleted>>): runs that are not deleted, each character with its own id."""
    runs = text.select("page_id", F.posexplode("runs").alias("r", "run")).where("run.deleted = 0")
    part, number = F.split("run.id", ":")[0], F.split("run.id", ":")[1].cast("long")
    letters = runs.select("page_id", "r", part.alias("part"), number.alias("number"), F.posexplode(F.filter(F.split("run.text", ""), lambda c: c != "")).alias("i", "char"))
    return letters.select("page_id", (F.col("r").cast("long") * 2**31 + F.col("i")).alias("ord"), F.concat_ws(":", "part", (F.col("number") + F.col("i")).cast("string")).alias("char_id"), "char")


def _lines_of(paragraph: str, width: float, measure) -> list[str]:
    """Greedy lines with their trailing spaces; breaks behind spaces and slashes; a chunk wider than the line stands alone."""
    import re

    lines, line = [], ""
    for chunk in re.findall(r" |[^ /]*/|[^ /]+", paragraph):
        if chunk != " " and line.strip() and measure((line + chunk).rstrip()) > width:
            lines.append(line)
            line = ""
        line += chunk
    return [*lines, line]


def lay_out(runs: list, styles: dict[str, int], x: float, y: float, width: float, measure) -> tuple[list[tuple], dict[str, float], float, float]:
    """(lines of (text, x, y, style, first), y by character id, top, bottom)."""
    letters = [(f"{a}:{int(b) + i}", c) for run in runs if not run["deleted"] for a, b in [run["id"].split(":")] for i, c in enumerate(run["text"])]
    text = "".join(c for _, c in letters)
    at_y = y + TOP + ABOVE.get(styles.get(FIRST, PLAIN), 0.0)
    top, out, heights, start = at_y, [], {}, 0
    pieces = text.split("\n")
    for n, paragraph in enumerate(pieces):
        if n == len(pieces) - 1 and not paragraph:
            break
        style = styles.get(FIRST if start == 0 else letters[start - 1][0], PLAIN)
        indent, leading = INDENT if style == LIST else 0.0, LEADING.get(style, LEADING[PLAIN])
        if n:
            at_y += leading + GAP + ABOVE.get(style, 0.0)
        at = start
        for k, line in enumerate(_lines_of(paragraph, width - indent, lambda t, s=style: measure(t, s == HEADING)) or [""]):
            at_y += leading if k else 0.0
            out.append((line.rstrip(), x + indent, at_y, style, k == 0))
            heights.update((letters[i][0], at_y) for i in range(at, at + len(line)))
            at += len(line)
        start += len(paragraph) + 1
        if start <= len(letters):
            heights[letters[start - 1][0]] = at_y
    return out, heights, top, out[-1][2] if out else top


def _measure(widths: dict[str, float], default: float):
    return lambda text, heading: sum(widths.get(c, default) for c in text) * (1.3 if heading else 1.0)


def laid_out(text: DataFrame, widths: dict[str, float], default: float) -> DataFrame:
    """Lines of every page's typed text: (page_id, runs, styles, pos_x, pos_y, width)."""

    def run(frames):
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                lines, *_ = lay_out(list(r.runs), dict(r.styles or {}), r.pos_x, r.pos_y, r.width, _measure(widths, default))
                rows += [(r.page_id, i, *line) for i, line in enumerate(lines)]
            yield pd.DataFrame(rows, columns=["page_id", "ord", "text", "x", "y", "style", "first"])

    return text.select("page_id", "runs", "styles", "pos_x", "pos_y", "width").mapInPandas(run, LINES)


def anchor_heights(text: DataFrame, widths: dict[str, float], default: float) -> DataFrame:
    """(page_id, top, bottom, char_y): what anchored ink is placed by."""

    def run(frames):
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                _, heights, top, bottom = lay_out(list(r.runs), dict(r.styles or {}), r.pos_x, r.pos_y, r.width, _measure(widths, default))
                rows.append((r.page_id, top, bottom, list(heights.items())))
            yield pd.DataFrame(rows, columns=["page_id", "top", "bottom", "char_y"])

    raw = text.select("page_id", "runs", "styles", "pos_x", "pos_y", "width").mapInPandas(run, "page_id string, top double, bottom double, char_y array<struct<k:string,v:double>>")
    return raw.withColumn("char_y", F.map_from_entries("char_y"))


def typed_text(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc_id, text): non-blank lines of each page, pages parted by a blank line. lines: (doc_id, page_ord, ord, text)."""
    page = lines.where(F.trim("text") != "").groupBy(doc, "page_ord").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda s: s["text"]), "\n").alias("t"))
    return page.groupBy(doc).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_ord", "t"))), lambda s: s["t"]), "\n\n").alias("text"))


def is_document_text(lines: DataFrame, page: str = "page_id", least: int = 10) -> DataFrame:
    """(page_id, is_document): at least ten lines with text, one of them wrapped."""
    return lines.groupBy(page).agg(((F.count_if(F.trim("text") != "") >= least) & F.bool_or(~F.col("first"))).alias("is_document"))


def scene_headings(lines: DataFrame, page: str = "page_id") -> DataFrame:
    """(page_id, title, x, y): neighbouring lines of a heading as one, unless a new paragraph starts."""
    from pyspark.sql import Window as W

    from annolake.functions.text import heading_title

    w = W.partitionBy(page).orderBy("ord")
    is_heading = F.col("style") == HEADING
    marked = lines.withColumn("_new", (is_heading & (F.col("first") | ~F.coalesce(F.lag("style").over(w) == HEADING, F.lit(False)))).cast("int"))
    grouped = marked.withColumn("_g", F.sum("_new").over(w)).where(is_heading)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda s: s["text"])
    return grouped.groupBy(page, "_g").agg(heading_title(F.array_join(listed, " ")).alias("title"), F.min_by("x", "ord").alias("x"), F.min_by("y", "ord").alias("y")).where(F.col("title") != "").drop("_g")
