"""Putting notes together from ordered rows: each document's text is one ordered aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.functions import text as T
from annolake.operators.sequences import collapsed_runs

FAILED_PAGE = "> [!warning] Could not read this page"
NOT_TRANSCRIBED = "*Not transcribed*"
OWNERSHIP = "> [!info]- Generated — do not edit"


def ordered(rows: DataFrame, keys: list[str], order: list, text: Column, separator: str, out: str) -> DataFrame:
    listed = F.sort_array(F.collect_list(F.struct(*order, text.alias("_t"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda s: s["_t"]), separator).alias(out))


def page_link(embed: Column, page: Column, label: Column) -> Column:
    return F.concat(F.lit("[["), embed, F.lit("#page="), page.cast("string"), F.lit("|"), label, F.lit("]]"))


def transcripts(pages: DataFrame, key: str, embed: Column) -> DataFrame:
    """(key, transcript) of (key, label, embed, status, text): one page alone has no heading; pages without text are named in one last line, runs of
    three and more as first–last."""
    body = F.when(F.col("status") == "ok", F.col("text")).when(F.col("status") == "failed", F.lit(FAILED_PAGE))
    shown = pages.where(F.col("status") != "skipped")
    head = F.concat(F.lit("### "), page_link(embed, F.col("embed"), F.concat(F.lit("Page "), F.col("label").cast("string"))), F.lit("\n\n"), body)
    sections = ordered(shown, [key], [F.col("label")], head, "\n\n", "_sections")
    single = pages.groupBy(key).agg(F.count("*").alias("_n"), F.max(F.coalesce(body, F.lit(""))).alias("_single"))
    skipped = pages.where(F.col("status") == "skipped")
    counted = skipped.groupBy(key).agg(F.count("*").alias("_skipped"))
    named = collapsed_runs(skipped, [key], "label", "_named").join(counted, key)
    tail = F.concat(F.when(F.col("_skipped") == 1, "*No text on page ").otherwise("*No text on pages "), F.col("_named"), F.lit(".*"))
    whole = single.join(sections, key, "left").join(named, key, "left")
    return whole.select(key, F.when(F.col("_n") <= 1, F.col("_single")).otherwise(F.concat_ws("\n\n", "_sections", tail)).alias("transcript"))


def highlight_sections(groups: DataFrame, key: str, embed: Column) -> DataFrame:
    """(key, highlights) of (key, label, embed, quotes array): a heading for each page, a bullet for each quote."""
    bullets = F.array_join(F.transform("quotes", lambda q: F.concat(F.lit("- "), q)), "\n")
    head = F.concat(F.lit("### "), page_link(embed, F.col("embed"), F.concat(F.lit("Page "), F.col("label").cast("string"))), F.lit("\n\n"), bullets)
    return ordered(groups.where(F.size("quotes") > 0), [key], [F.col("label")], head, "\n\n", "highlights")


def managed(embed: Column, digest: Column, highlights: Column, transcript: Column, fence: str = T.FENCE_END) -> Column:
    """A note's managed block: the digest alone, or highlights and transcript."""
    top = F.concat(F.lit(f"{OWNERSHIP}\n\n![["), embed, F.lit("]]\n"))
    with_digest = F.concat(top, F.lit("\n## Digest\n"), digest, F.lit(f"\n{fence}"))
    quotes = F.when(highlights == "", "").otherwise(F.concat(F.lit("\n## Highlights\n\n"), highlights, F.lit("\n")))
    said = F.when(transcript == "", "").otherwise(F.concat(F.lit("\n## Transcript\n"), transcript))
    return F.when(digest != "", with_digest).otherwise(F.concat(top, quotes, said, F.lit(f"\n{fence}")))


def note(block: Column, existing: Column) -> Column:
    """The block between an old note's front matter and its own text."""
    return F.when(existing.isNull(), F.concat(block, F.lit("\n"))).otherwise(F.concat(T.front_matter(existing), block, T.free_area(existing)))


def with_transcript(content: Column, transcript: Column, fence: str = T.FENCE_END) -> Column:
    """The note with its transcript replaced, added or removed; null where nothing is to be written (no block, a digest, or nothing to put)."""
    head = "\n## Transcript\n"
    at, end = F.instr(content, head), F.instr(content, f"\n{fence}")
    before = F.substring(content, F.lit(1), F.when(at > 0, at - 1).otherwise(end - 1))
    rest = F.substring(content, end, F.length(content))
    put = F.when(transcript == "", F.concat(before, rest)).otherwise(F.concat(before, F.lit(head), transcript, rest))
    refuses = F.coalesce(T.managed_block(content, fence).contains("\n## Digest\n"), F.lit(True)) | ((at == 0) & (transcript == ""))
    return F.when(~refuses & (end > 0), put)


def highlight_entry(sentence: Column, marked: Column, locator: Column, block_id: Column) -> Column:
    return F.concat(T.escaped(T.marked_sentence(sentence, marked)), locator, F.lit("\n^"), block_id)


def note_entry(text: Column, title: Column, locator: Column, block_id: Column, region: Column, prefix: str = "> ") -> Column:
    """A callout: title and locator, the text's lines with the id on the last, then the region block."""
    lines = F.when(text == "", F.array(F.lit(NOT_TRANSCRIBED))).otherwise(F.transform(F.split(text, "\n"), T.escaped))
    heading = F.rtrim(F.concat(F.lit("[!handwritten] "), F.when(title == "", F.regexp_replace(locator, "^ · ", "")).otherwise(F.concat(title, locator))))
    last = F.concat(F.element_at(lines, -1), F.lit(" ^"), block_id)
    entry = F.concat(F.array(heading), F.slice(lines, F.lit(1), F.size(lines) - 1), F.array(last))
    whole = F.when(region.isNull(), entry).otherwise(F.concat(entry, F.split(T.region_block(region), "\n")))
    return F.array_join(F.transform(whole, lambda x: F.concat(F.lit(prefix), x)), "\n")


def digests(entries: DataFrame, key: str, order: list[str], heading: str, body: str) -> DataFrame:
    """(key, digest): entries in order, a heading only where it differs from the one before."""
    from pyspark.sql import Window as W

    w = W.partitionBy(key).orderBy(*order)
    new = ~F.col(heading).eqNullSafe(F.lag(heading).over(w)) | (F.row_number().over(w) == 1)
    text = F.when(F.col("_new"), F.concat(F.col(heading), F.lit("\n\n"), F.col(body))).otherwise(F.col(body))
    joined = ordered(entries.withColumn("_new", new), [key], [F.col(c) for c in order], text, "\n\n", "digest")
    return joined.withColumn("digest", F.concat(F.lit("\n"), F.col("digest")))
