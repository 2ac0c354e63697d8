"""Documents, pages and their rows of state: joins between them, comparisons, counts and the steps of a run.

entries: (id, parent, type, tags); rows of state: (sync_key, ord, doc_id, page_id, tag, status, entry_hash, block_hash, note_path, render_version, n_pages); ``ord`` is the order in
which rows came to be, ``page_id`` is null for a whole document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annolake.functions import text as T
from annolake.operators.incremental import RENDER_VERSION, is_stale
from annolake.operators.routing import inherited_tags

#: Tags that may be mapped without a licence, and what a routing list says.
FREE_TAGS, CHOOSE, MISSING = 1, "", " (missing)"


def tag_names(tags: Column) -> Column:
    """Names from a JSON array of names or of objects with a name; missing tags are none."""
    named = F.transform(F.from_json(tags, "array<variant>"), lambda t: F.when(F.schema_of_variant(t) == "STRING", F.try_variant_get(t, "$", "string")).otherwise(F.try_variant_get(t, "$.name", "string")))
    return F.coalesce(named, F.array().cast("array<string>"))


def with_parents(entries: DataFrame) -> DataFrame:
    """Every entry with the type and tags of its parent, null where there is none."""
    parents = entries.select(F.col("id").alias("parent"), F.col("type").alias("parent_type"), F.col("tags").alias("parent_tags"))
    return entries.join(parents, "parent", "left")


def all_tags(entries: DataFrame) -> DataFrame:
    """(id, tags): an entry's own tags, then those it inherits, each once."""
    none = F.array().cast("array<string>")
    inherited = inherited_tags(entries).select("id", F.col("tags").alias("_inherited"))
    return entries.join(inherited, "id", "left").select("id", F.array_distinct(F.concat(F.coalesce("tags", none), F.coalesce("_inherited", none))).alias("tags"))


def live_page_tags(page_tags: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_id, tags): the tags of pages that still exist, in order. page_tags: (doc_id, page_id, ord, tag)."""
    live = page_tags.join(pages.select("doc_id", "page_id").distinct(), ["doc_id", "page_id"], "left_semi")
    return live.groupBy("doc_id", "page_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "tag"))), lambda s: s["tag"]).alias("tags"))


def unreconciled(documents: DataFrame, rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """(doc_id): documents whose mapped tags are not the tags of their active rows. documents: (doc_id, tags array)."""
    now = documents.select("doc_id", F.explode("tags").alias("tag")).distinct().join(mapping.select("tag"), "tag", "left_semi").withColumn("_now", F.lit(1))
    then = rows.where(F.col("page_id").isNull() & (F.col("status") == "active")).join(documents.select("doc_id"), "doc_id", "left_semi").select("doc_id", "tag").distinct().withColumn("_then", F.lit(1))
    return now.join(then, ["doc_id", "tag"], "full_outer").where(F.col("_now").isNull() | F.col("_then").isNull()).select("doc_id").distinct()


def edited(rows: DataFrame, notes: DataFrame) -> DataFrame:
    """(sync_key, edited): whether somebody changed what a run had written. Without a hash, a note or a fence there is nothing to compare. notes: (path, content)."""
    found = rows.join(notes.select(F.col("path").alias("note_path"), T.managed_block(F.col("content")).alias("_block")), "note_path", "left")
    differs = (F.col("status") == "active") & F.col("block_hash").isNotNull() & F.col("_block").isNotNull() & (T.fnv1a(F.col("_block")) != F.col("block_hash"))
    return found.select("sync_key", F.coalesce(differs, F.lit(False)).alias("edited"))


def reusable_transcripts(rows: DataFrame, notes: DataFrame, documents: DataFrame, pages: DataFrame) -> DataFrame:
    """(sync_key, transcript): of active rows of documents that did not change, whose render is out of date and none of whose pages has typed text or placed layers. documents: (doc_id,
    hash); pages: (doc_id, typed boolean, placed boolean)."""
    stale = rows.where((F.col("status") == "active") & is_stale(F.col("render_version")))
    same = stale.join(documents.select("doc_id", F.col("hash").alias("entry_hash")), ["doc_id", "entry_hash"], "left_semi")
    plain = same.join(pages.where(F.col("typed") | F.col("placed")).select("doc_id").distinct(), "doc_id", "left_anti")
    told = plain.join(notes.select(F.col("path").alias("note_path"), T.transcript_of(F.col("content")).alias("transcript")), "note_path")
    return told.where(F.col("transcript").isNotNull()).select("sync_key", "transcript")


def stored_hashes(rows: DataFrame) -> DataFrame:
    """(doc_id, entry_hash): of each document's rows the hash of the first."""
    return rows.groupBy("doc_id").agg(F.min_by("entry_hash", "ord").alias("entry_hash"))


def bumped(rows: DataFrame, documents: DataFrame, edited_keys: DataFrame) -> DataFrame:
    """The rows with their documents' new hashes, except those that were skipped because they had been edited. documents: (doc_id, hash)."""
    kept = edited_keys.select("sync_key").distinct().withColumn("_kept", F.lit(True))
    both = rows.join(documents.select("doc_id", "hash"), "doc_id", "left").join(kept, "sync_key", "left")
    return both.withColumn("entry_hash", F.when(F.col("_kept").isNull(), F.coalesce("hash", "entry_hash")).otherwise(F.col("entry_hash"))).select(*rows.columns)


def relaid(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, before, now): documents with another number of source pages than their active rows were written from. documents: (doc_id, n_pages)."""
    then = rows.where((F.col("status") == "active") & F.col("n_pages").isNotNull()).select("doc_id", F.col("n_pages").alias("before")).distinct()
    return then.join(documents.select("doc_id", F.col("n_pages").alias("now")), "doc_id").where(F.col("before") != F.col("now"))


def rows_by_document(rows: DataFrame) -> DataFrame:
    """(doc_id, sync_keys): each document's active rows in order."""
    active = rows.where(F.col("status") == "active")
    return active.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "sync_key"))), lambda s: s["sync_key"]).alias("sync_keys"))


def transcription_steps(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """(sync_key, steps) of active rows: all live pages of a document, one for a page that still exists, none for one that is gone. pages: (doc_id, page_id)."""
    active = rows.where(F.col("status") == "active")
    whole = pages.groupBy("doc_id").agg(F.count("*").alias("_all"))
    here = pages.select("doc_id", "page_id").distinct().withColumn("_here", F.lit(1))
    both = active.join(whole, "doc_id", "left").join(here, ["doc_id", "page_id"], "left")
    return both.select("sync_key", F.when(F.col("page_id").isNull(), F.coalesce("_all", F.lit(0))).otherwise(F.coalesce("_here", F.lit(0))).cast("long").alias("steps"))


def workload(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """(steps): all that a run over the active rows will do."""
    return transcription_steps(rows, pages).agg(F.coalesce(F.sum("steps"), F.lit(0)).alias("steps"))


def active_count(status: Column) -> Column:
    """How many rows of a group can be transcribed again."""
    return F.count_if(status == "active")


def item_count(lists: Column) -> Column:
    """How many items the lists of a group hold."""
    return F.coalesce(F.sum(F.size(lists)), F.lit(0)).cast("long")


def download_total(sizes: Column) -> Column:
    return F.coalesce(F.sum(sizes), F.lit(0))


#: What went only half well, in the order in which it is said: the last is read first.
PARTIAL = (
    ("failed_ocr", "{} synced without a transcript", ("note", "notes")), ("edited", "{} not updated because of edits", ("note was", "notes were")),
    ("skipped", "{} skipped", ("document was", "documents were")), ("relaid", "{} been laid out again since the notes were written", ("book has", "books have")),
    ("shrunk", "{} fewer highlights than before", ("note has", "notes have")),
)


def partial_outcomes(results: DataFrame, key: str) -> DataFrame:
    """(key, position, kind, message) of (key, failed_ocr, edited, skipped, relaid, shrunk): a message for each count that is not zero."""
    def said(i: int, kind: str, told: str, words: tuple[str, str]) -> Column:
        n = F.col(kind)
        before, after = told.split("{}")
        message = F.concat(F.lit(before), n.cast("string"), F.lit(" "), F.when(n == 1, words[0]).otherwise(words[1]), F.lit(after))
        return F.struct(F.lit(i).alias("position"), F.lit(kind).alias("kind"), F.when(n > 0, message).alias("message"))

    every = F.array(*(said(i, *p) for i, p in enumerate(PARTIAL)))
    return results.select(key, F.inline(F.filter(every, lambda s: s["message"].isNotNull())))


def render_warnings(pages: DataFrame) -> DataFrame:
    """(page_id, kind) of (page_id, layers array<struct<placement, visible>>): one warning for a page with layers that could not be placed, one for one with hidden layers."""
    unplaced = F.exists("layers", lambda x: x["placement"].isNotNull() & (x["placement"] != "applied"))
    hidden = F.exists("layers", lambda x: F.coalesce(~x["visible"], F.lit(False)))
    return pages.select("page_id", F.explode(F.array_compact(F.array(F.when(unplaced, "unplaced"), F.when(hidden, "hidden")))).alias("kind"))


def has_typed_text(runs: Column) -> Column:
    """Whether a page has a run of text that is neither deleted nor empty."""
    return F.coalesce(F.exists(runs, lambda r: (r["deleted"] == 0) & (r["text"] != "")), F.lit(False))


def is_annotated(highlights: Column, layers: Column) -> Column:
    """Whether a page has a highlight or a stroke."""
    return (F.coalesce(F.size(highlights), F.lit(0)) > 0) | F.coalesce(F.exists(layers, lambda x: F.size(x["strokes"]) > 0), F.lit(False))


def distinct_images(layers: DataFrame) -> DataFrame:
    """(page_id, images): the images of all layers of a page, each once, in order. layers: (page_id, ord, images array)."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("ord", "images"))), lambda s: s["images"])
    return layers.groupBy("page_id").agg(F.array_distinct(F.flatten(listed)).alias("images"))


def paint_order(strokes: DataFrame) -> DataFrame:
    """Marks with their place in a page's drawing: highlights, then markers, then ink, each in order. strokes: (page_id, ord, is_highlight, is_marker)."""
    rank = F.when(F.col("is_highlight"), 0).when(F.col("is_marker"), 1).otherwise(2)
    return strokes.withColumn("position", F.row_number().over(W.partitionBy("page_id").orderBy(rank, "ord")) - 1)


def routing_list(mapping: DataFrame, discovered: DataFrame, folders: DataFrame, tier: str) -> DataFrame:
    """(kind, tag, folder, missing) of mapping (tag, folder), discovered (tag) and folders (path): mapped tags with their folder, which may be missing, then the others, which can be
    mapped unless the licence allows no more."""
    here = folders.select(F.col("path").alias("folder")).distinct().withColumn("_here", F.lit(True))
    mapped = mapping.join(here, "folder", "left").select(F.lit("mapped").alias("kind"), "tag", "folder", F.col("_here").isNull().alias("missing"))
    count = mapping.agg(F.count("*").alias("_n"))
    capped = (F.col("_n") >= FREE_TAGS) & F.lit(tier == "free")
    others = discovered.select("tag").distinct().join(mapping.select("tag"), "tag", "left_anti").join(count, how="cross")  # one row
    free = others.select(F.when(capped, "capped").otherwise("mappable").alias("kind"), "tag", F.lit(None).cast("string").alias("folder"), F.lit(False).alias("missing"))
    return mapped.unionByName(free)


def numbered_headings(headings: DataFrame, lines: DataFrame) -> DataFrame:
    """The headings, each with the number that the first line of its page has before it, where that line is nothing but the number and the title. headings: (doc_id, page_index, ord,
    title); lines: (doc_id, page_index, ord, text)."""
    number = T.heading_number(F.col("text"), F.col("title"))
    pairs = headings.select("doc_id", "page_index", "title").distinct().join(lines.select("doc_id", "page_index", F.col("ord").alias("_line"), "text"), ["doc_id", "page_index"])
    first = pairs.withColumn("_number", number).where(F.col("_number").isNotNull()).groupBy("doc_id", "page_index", "title").agg(F.min_by("_number", "_line").alias("_number"))
    both = headings.join(first, ["doc_id", "page_index", "title"], "left")
    return both.withColumn("title", F.concat_ws(" ", "_number", "title")).select(*headings.columns)


def retry_delay(header: Column, attempt: Column, now: Column) -> Column:
    """Milliseconds to wait: what the answer asks for, in seconds or as a date, else twice as long at each attempt. ``now`` in milliseconds."""
    seconds = header.try_cast("double")
    date = F.unix_millis(F.try_to_timestamp(F.regexp_replace(header, "^[A-Za-z]+, ", ""), F.lit("dd MMM yyyy HH:mm:ss z")))
    return F.coalesce(F.when(seconds >= 0, (seconds * 1000).cast("long")), F.when(date.isNotNull(), F.greatest(date - now, F.lit(0))), (1000 * F.pow(F.lit(2.0), attempt - 1)).cast("long"))


def on_day(iso: Column) -> Column:
    """The day of a written time."""
    return F.substring(iso, 1, 10)


def stale_rows(rows: DataFrame, version: int = RENDER_VERSION) -> DataFrame:
    """Active rows whose render is out of date."""
    return rows.where((F.col("status") == "active") & is_stale(F.col("render_version"), version))


def source_error(content: Column, n_pages: Column) -> Column:
    """What is wrong with a document's source before anything is drawn on it, else null: an empty or pageless one is a failure of its document and no empty note."""
    return F.when(F.coalesce(F.length(content), F.lit(0)) == 0, "the source is empty").when(F.coalesce(n_pages, F.lit(0)) == 0, "the source has no pages")


def guarded(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents (doc_id, content, n_pages) with a usable source, (doc_id, error) of the others)."""
    error = source_error(F.col("content"), F.col("n_pages"))
    return documents.where(error.isNull()), documents.where(error.isNotNull()).select("doc_id", error.alias("error"))


def source_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, source_pages): which pages of the source a document's pages (doc_id, source_index, appended) show, each once, in order; pages that were added on the device show none."""
    own = F.when(~F.coalesce("appended", F.lit(False)), F.col("source_index"))
    return pages.groupBy("doc_id").agg(F.array_sort(F.collect_set(own)).alias("source_pages"))
