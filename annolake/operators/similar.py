"""Lines that are alike within a limit of edit distance, and lists of lines without those that are like one before.

Of two texts within distance d of each other, cut the longer one into d + 1 segments: one of them stands in the shorter, moved by no more than the edits before and after it allow. So candidates come from an equi-join of segments
with the substrings that can meet them; what differs too much is never paired. The substrings grow with the cube of the length, so this is the way of texts up to ``SHORT``; longer ones are paired by group and
length, which suits lines of a page. Equal texts are one, so a text that many rows share is compared once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.functions import text as T
from annolake.functions.python import nfc
from annolake.operators.shared import Rounds

#: Fixed: from which share of equal characters two readings are of one line.
SAME_LINE = 0.6
#: Characters up to which texts are found by segments, and the width of a band of lengths beyond.
SHORT, BAND = 32, 16


def shape_of(line: Column) -> Column:
    """A line as text rather than as bytes, whatever marks it is composed of."""
    return T.line_shape(nfc(line))


def _limit(length: Column, least: float) -> Column:
    """The most edits that leave a text of that length alike; a little more rather than less, as the distance itself is tested later."""
    return F.floor(length * (1 - least) + 1e-6).cast("int")


def _start(length: Column, parts: Column, i: Column) -> Column:
    """Where the i-th of so many segments of a length begins, from 0: the shorter ones first."""
    short, rest = F.floor(length / parts), length % parts
    return (i * short + F.greatest(F.lit(0), i - (parts - rest))).cast("int")


def same_line(a: Column, b: Column, least: float = SAME_LINE) -> Column:
    """If two texts are equal or alike; null if one is."""
    longest = F.greatest(F.length(a), F.length(b))
    # with its limit the distance needs only a band of the table, and is -1 beyond
    away = F.call_function("levenshtein", a, b, _limit(longest, least) + 1)
    return F.when(a == b, True).otherwise((away >= 0) & (1 - away / longest >= least))


def alike(texts: DataFrame, group: str, text: str, least: float = SAME_LINE, short: int = SHORT) -> DataFrame:
    """(group, a, b): pairs a < b of different texts of a group with 1 - distance / longer length of at least ``least``, which is 0.5 or more. Empty texts are like no other. ``short``: the length of the longer
    one up to which segments find a pair."""
    if not 0.5 <= least <= 1:
        raise ValueError("segments find texts that are alike by half or more")
    t = texts.select(F.col(group).alias("_g"), F.col(text).alias("_t")).where("_t <> ''").distinct().withColumn("_n", F.length("_t"))
    n, i = F.col("_n"), F.col("_i")
    segments = t.where(n <= short).withColumn("_parts", _limit(n, least) + 1).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    begin, end = _start(n, F.col("_parts"), i), _start(n, F.col("_parts"), i + 1)
    longer = segments.select("_g", F.col("_t").alias("_long"), n.alias("_m"), "_i", F.substring("_t", begin + 1, end - begin).alias("_s"))
    # the shorter text against every length that it can be alike with
    wide = t.where(n <= short).withColumn("_m", F.explode(F.sequence(n, F.least(F.lit(short), F.floor(n / least + 1e-6).cast("int"))))).withColumn("_d", _limit(F.col("_m"), least)).where(F.col("_m") - n <= F.col("_d"))
    wide = wide.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_d"))))
    begin, end = _start(F.col("_m"), F.col("_d") + 1, i), _start(F.col("_m"), F.col("_d") + 1, i + 1)
    size, gap = end - begin, F.col("_m") - n
    low = F.greatest(F.lit(0), begin - i, begin - gap - (F.col("_d") - i))
    high = F.least(n - size, begin + i, begin - gap + (F.col("_d") - i))
    wide = wide.select("_g", "_t", "_m", "_i", size.alias("_size"), low.alias("_low"), high.alias("_high")).where("_low <= _high")
    probes = wide.select("_g", "_t", "_m", "_i", F.explode(F.array_distinct(F.transform(F.sequence("_low", "_high"), lambda p: F.substring(F.col("_t"), p + 1, F.col("_size"))))).alias("_s"))
    pairs = probes.join(longer, ["_g", "_m", "_i", "_s"]).where(F.col("_t") != F.col("_long"))
    pairs = pairs.select("_g", F.least("_t", "_long").alias("a"), F.greatest("_t", "_long").alias("b")).distinct()
    bands = F.sequence(F.floor((n - _limit(n, least)) / BAND).cast("int"), F.floor(n / BAND).cast("int"))
    long = t.where(n > short).select("_g", F.col("_t").alias("_long"), n.alias("_m"), F.explode(bands).alias("_band"))
    met = t.withColumn("_band", F.floor(n / BAND).cast("int")).join(long, ["_g", "_band"]).where(n.between(F.col("_m") - _limit(F.col("_m"), least), F.col("_m")) & ((n < F.col("_m")) | (F.col("_t") < F.col("_long"))))
    pairs = pairs.unionByName(met.select("_g", F.least("_t", "_long").alias("a"), F.greatest("_t", "_long").alias("b")))
    return pairs.where(same_line(F.col("a"), F.col("b"), least)).select(F.col("_g").alias(group), "a", "b")


def without_repeats(lines: DataFrame, page: str = "page_id", least: float = SAME_LINE, short: int = 0) -> DataFrame:
    """The lines (page, ord, text, given) of a page that stay when each, in order, is dropped if it is like a line that stays before it; lines that are ``given`` stay whatever they are like, and go before all others. An
    empty line is like an empty one.

    The lines that stay are the first independent set of the graph of alike lines, and are found in rounds: a line with no line before it that is alike and undecided stays, and those after it that are like it
    go. A round decides at least the first undecided line of every page, and mostly far more. ``short`` as of `alike`: the lines of a page are few enough to be paired by length, which costs less than their segments."""
    rounds = Rounds(lines.sparkSession, "repeats")
    own = rounds.write(lines.select(page, "ord", "text", "given", shape_of(F.col("text")).alias("_s")).withColumn("_at", F.struct((~F.col("given")).cast("int").alias("late"), "ord")))
    pairs = alike(own, page, "_s", least, short)
    both = pairs.select(page, F.col("a").alias("_s"), F.col("b").alias("_other")).unionByName(pairs.select(page, F.col("b").alias("_s"), F.col("a").alias("_other")))
    # of lines with one shape only the first can stay; so the graph is one of shapes, each at the place of its first line
    first = rounds.write(own.groupBy(page, "_s").agg(F.min("_at").alias("_at")))
    at = first.select(page, F.col("_s").alias("_other"), F.col("_at").alias("_before"))
    edges = rounds.write(both.join(first, [page, "_s"]).join(at, [page, "_other"]).where(F.col("_before") < F.col("_at")).select(page, "_s", "_other"))
    state = rounds.write(first.select(page, "_s", F.when(F.col("_at.late") == 0, F.lit(True)).alias("stays")))
    while not state.where("stays IS NULL").isEmpty():
        told = edges.join(state.select(page, F.col("_s").alias("_other"), F.col("stays").alias("_other_stays")), [page, "_other"])
        seen = told.groupBy(page, "_s").agg(F.coalesce(F.bool_or("_other_stays"), F.lit(False)).alias("_gone"), F.count(F.when(F.col("_other_stays").isNull(), 1)).alias("_open"))
        new = state.join(seen, [page, "_s"], "left")
        stays = F.when(F.col("stays").isNotNull(), F.col("stays")).when(F.col("_gone"), False).when(F.coalesce("_open", F.lit(0)) == 0, True)
        state = rounds.write(new.select(page, "_s", stays.alias("stays")))
    kept = own.join(state.where("stays"), [page, "_s"]).join(first.select(page, "_s", F.col("_at").alias("_first")), [page, "_s"])
    out = Rounds(lines.sparkSession, "kept-lines")
    result = out.write(kept.where(F.col("given") | (F.col("_at") == F.col("_first"))).select(page, "ord", "text", "given"))
    rounds.forget(0)
    return result
