"""Repairing quotes against the text they come from, and headings against chapter names.

A quote's longest words propose windows of the source (an inverted-index join); the alignment, which is quadratic, runs on those windows only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annolake.functions import text as T
from annolake.functions.python import aligned, fitting_alignment

SLACK, WINDOWS = 24, 24


def candidate_windows(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """(quote_id, quote, window, from): at most ``WINDOWS`` stretches of the source around occurrences of the quote's anchor words, in the order of the words.
    quotes: quote_id, doc_id, text; sources: doc_id, body."""
    q = quotes.withColumn("quote", T.folded(F.col("text"))).where(F.col("quote").isNotNull())
    anchors = q.select("quote_id", "doc_id", "quote", F.posexplode(T.anchor_words(F.col("quote"))).alias("rank", "word"))
    s = sources.withColumn("source", T.folded(F.col("body"))).where(F.col("source").isNotNull())
    joined = anchors.join(s.select("doc_id", "source"), "doc_id").where(F.contains("source", F.col("word")))
    # occurrences: lengths of the pieces between them, summed
    pieces = F.transform(F.split("source", F.concat(F.lit(r"\Q"), F.col("word"), F.lit(r"\E"))), lambda p: F.length(p))
    placed = joined.select("quote_id", "quote", "source", "rank", "word", F.posexplode(pieces).alias("k", "n"))
    sums = F.sum(F.col("n") + F.length("word")).over(W.partitionBy("quote_id", "rank").orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow))
    at = placed.withColumn("at", sums - F.length("word")).withColumn("_last", F.max("k").over(W.partitionBy("quote_id", "rank"))).where(F.col("k") < F.col("_last"))
    start = F.greatest(F.lit(0), F.col("at") - (F.instr("quote", F.col("word")) - 1) - SLACK)
    spots = at.withColumn("from", start.cast("int")).withColumn("_b", F.floor(F.col("from") / SLACK))
    distinct = spots.withColumn("_n", F.row_number().over(W.partitionBy("quote_id", "_b").orderBy("rank", "k"))).where(F.col("_n") == 1)
    few = distinct.withColumn("_n", F.row_number().over(W.partitionBy("quote_id").orderBy("rank", "k"))).where(F.col("_n") <= WINDOWS)
    return few.select("quote_id", "quote", F.substring("source", F.col("from") + 1, F.length("quote") + 2 * SLACK).alias("window"), "from")


def best_alignments(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """(quote_id, distance, start, end): the nearest stretch of the source, if its distance is within the quote's error budget."""
    scored = candidate_windows(quotes, sources).withColumn("a", aligned("quote", "window"))
    best = scored.groupBy("quote_id").agg(F.min(F.struct(F.col("a.distance").alias("distance"), (F.col("from") + F.col("a.start")).alias("start"), (F.col("from") + F.col("a.end")).alias("end"))).alias("b"), F.first("quote").alias("quote"))
    return best.where(F.col("b.distance") <= T.error_budget(F.length("quote"))).select("quote_id", "b.distance", "b.start", "b.end")


def corrected(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """(quote_id, sentence): the source's own wording of each quote, the quote's where none is near enough."""
    found = best_alignments(quotes, sources)
    whole = quotes.join(found, "quote_id", "left").join(sources, "doc_id", "left")
    repaired = F.substring("body", F.col("start") + 1, F.col("end") - F.col("start"))
    return whole.select("quote_id", F.when(F.col("start").isNotNull() & (repaired != ""), repaired).otherwise(F.col("text")).alias("sentence"))


def correct_quote(sentence: str, marked: list[str], source: str) -> tuple[str, list[str]] | None:
    """One sentence and its marked runs in the source's wording; None where a run has no place in it or nothing is near enough."""
    low, wide = sentence.lower(), source.lower()
    if not sentence.strip() or len(low) != len(sentence) or len(wide) != len(source):
        return None
    distance, start, end, places = fitting_alignment(low, wide)
    if distance > max(2, int(len(sentence) * 0.15)) or start == end:
        return None
    runs = []
    for run in marked:
        at = sentence.find(run)
        if at < 0 or not run or places[at + len(run)] <= places[at]:
            return None
        runs.append(source[places[at] : places[at + len(run)]])
    return source[start:end], runs


def chapter_names(headings: DataFrame, chapters: DataFrame) -> DataFrame:
    """(heading_id, chapter): the one chapter name nearest to a heading within its budget; null where two different ones are equally near.
    headings: heading_id, doc_id, title; chapters: doc_id, chapter (a book's own, so pairs stay within a book)."""
    pairs = headings.join(chapters.distinct(), "doc_id").withColumn("a", aligned(T.folded(F.col("title")), T.folded(F.col("chapter"))))
    near = pairs.where(F.col("a.distance") <= T.error_budget(F.length("title")))
    first = near.withColumn("r", F.rank().over(W.partitionBy("heading_id").orderBy("a.distance"))).where(F.col("r") == 1)
    named = first.groupBy("heading_id").agg(F.when(F.count_distinct("chapter") == 1, F.first("chapter")).alias("chapter"))
    return headings.select("heading_id").join(named, "heading_id", "left")
