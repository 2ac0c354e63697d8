"""Tags, folders and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annolake.functions.text import file_name, in_folder
from annolake.operators.shared import Rounds


def routed(rows: DataFrame, mapping: DataFrame, tag: str = "tag") -> DataFrame:
    """Left join of tag to folder; the planner broadcasts the mapping where its size allows."""
    return rows.join(mapping, tag, "left")


def mapped(rows: DataFrame, mapping: DataFrame, tag: str = "tag") -> DataFrame:
    """Rows whose tag has a folder."""
    return rows.distinct().join(mapping.select(tag), tag, "left_semi")


def tag_changes(before: Column, now: Column) -> Column:
    """struct<action, old, new, orphaned>: one tag gone and one new is a renaming; otherwise every tag that is gone is orphaned."""
    gone, new = F.array_sort(F.array_except(before, now)), F.array_sort(F.array_except(now, before))
    rename = (F.size(gone) == 1) & (F.size(new) == 1)
    return F.struct(
        F.when(rename, "rename").when(F.size(gone) + F.size(new) == 0, "same").otherwise("diff").alias("action"), F.when(rename, gone[0]).alias("old"), F.when(rename, new[0]).alias("new"),
        F.when(rename, F.array().cast("array<string>")).otherwise(gone).alias("orphaned"),
    )


def inherited_tags(entries: DataFrame) -> DataFrame:
    """(id, tags): the distinct tags of all folders above an item, nearest first. The walk ends at the root, at `trash`, at an unknown parent, at
    what is no folder, and where it would come round again. entries: id, parent, type, tags.

    By pointer doubling: after n rounds a folder knows the tags of the 2^n folders above it, so any depth takes few joins; a ring of folders ends with its number."""
    rounds = Rounds(entries.sparkSession, "folders")
    none = F.array().cast("array<string>")
    folders = entries.where(F.col("type") == "CollectionType").select("id", "parent", F.array_distinct(F.coalesce("tags", none)).alias("own"))
    real = folders.select(F.col("id").alias("up"), F.col("own").alias("got"))
    inside = F.col("parent").isNotNull() & ~F.col("parent").isin("", "trash")
    known = folders.select("id", F.when(inside, F.col("parent")).alias("up")).join(real, "up", "left")
    known = rounds.write(known.select("id", F.when(F.col("got").isNotNull(), F.col("up")).alias("up"), F.coalesce("got", none).alias("got")))
    steps, most = 1, known.count()
    while steps < most and not known.where(F.col("up").isNotNull()).isEmpty():
        above = known.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("got").alias("more"))
        known = rounds.write(known.join(above, "up", "left").select("id", F.col("next").alias("up"), F.array_distinct(F.concat("got", F.coalesce("more", none))).alias("got")))
        rounds.forget()
        steps *= 2
    told = folders.join(known.select("id", "got"), "id").select(F.col("id").alias("at"), F.array_distinct(F.concat("own", "got")).alias("tags"))
    items = entries.select("id", F.when(inside, F.col("parent")).alias("at"))
    return items.join(told, "at", "left").select("id", F.coalesce("tags", none).alias("tags"))


def free_paths(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """(key, path): for each note of (key, folder, base, tag, doc_id), in order of their keys, the first of its candidate names that neither an existing note nor one
    before it has: plain, with its tag, with the first of its id, then numbered from 2. No two notes get one path, and none gets a taken one."""
    rounds, left, used, out = Rounds(wanted.sparkSession, "paths"), wanted.select("key", "folder", "base", "tag", "doc_id"), taken.select("path").distinct(), None
    while True:
        tried = rounds.write(_proposed(left, used).withColumn("_first", F.row_number().over(W.partitionBy("path").orderBy("key")) == 1))
        done = tried.where("_first").select("key", "path")
        out = done if out is None else out.unionByName(done)
        rest = tried.where("NOT _first")
        if rest.isEmpty():
            return out
        left, used = rest.select(*left.columns), used.unionByName(done.select("path"))


def _proposed(wanted: DataFrame, used: DataFrame) -> DataFrame:
    """The notes with a path each that is free, told apart from others of the same folder and name."""
    stem = in_folder(F.col("folder"), F.col("base"))
    named = lambda suffix: F.concat(stem, suffix, F.lit(".md"))
    names = F.array(named(F.lit("")), named(F.concat(F.lit(" ("), file_name(F.col("tag")), F.lit(")"))), named(F.concat(F.lit(" ("), F.substring("doc_id", 1, 6), F.lit(")"))))
    tries = wanted.select("key", F.posexplode(names).alias("n", "path")).join(used.withColumn("_used", F.lit(True)), "path", "left")
    open_ = tries.groupBy("key").agg(*(F.max(F.when((F.col("n") == n) & F.col("_used").isNull(), F.col("path"))).alias(f"p{n}") for n in range(3)))
    rows = wanted.join(open_, "key").withColumn("stem", stem)
    given = F.lit(None).cast("string")
    for n in range(3):
        # of those that still need a name, the first to want this one
        asks = given.isNull() & F.col(f"p{n}").isNotNull()
        rows = rows.withColumn("_asks", asks).withColumn("_given", given)
        rows = rows.withColumn("_given", F.when(F.col("_asks") & (F.row_number().over(W.partitionBy(f"p{n}", "_asks").orderBy("key")) == 1), F.col(f"p{n}")).otherwise(F.col("_given")))
        given = F.col("_given")
    # the others by number: the r-th that no note has yet is r + 1 and as many more as there are taken ones with fewer than r free numbers in front
    taken = used.select(F.regexp_extract("path", r"^(.*) \(([2-9]|[1-9]\d{1,8})\)\.md$", 1).alias("stem"), F.regexp_extract("path", r" \(([2-9]|[1-9]\d{1,8})\)\.md$", 1).try_cast("int").alias("number"))
    taken = taken.where("number IS NOT NULL").distinct().withColumn("v", F.col("number") - 2 - (F.row_number().over(W.partitionBy("stem").orderBy("number")) - 1))
    late = rows.where("_given IS NULL").select("key", "stem", (F.row_number().over(W.partitionBy("stem").orderBy("key")) - 1).alias("v"))
    both = taken.select(F.lit(None).cast(wanted.schema["key"].dataType).alias("key"), "stem", "v", F.lit(0).alias("kind")).unionByName(late.withColumn("kind", F.lit(1)))
    before = W.partitionBy("stem").orderBy("v", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    numbered = both.withColumn("number", F.col("v") + 2 + F.sum(1 - F.col("kind")).over(before)).where("kind = 1").select("key", "number")
    path = F.coalesce("_given", F.concat("stem", F.lit(" ("), F.col("number").cast("int").cast("string"), F.lit(").md")))
    return rows.join(numbered, "key", "left").select(*wanted.columns, path.alias("path"))
