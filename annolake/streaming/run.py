"""The whole incremental run: from what changed on the device to notes in the vault.

Three levels are compared by hash, and each only where the one above differs: the root and the mapping of tags to folders; the documents, of which the device source reads the buckets that differ; the
pages of those that are opened. Besides, documents are opened whose rows of state ask for it: orphaned ones, out of date renders, missing notes, tags whose folder is another now, and tags that are not
reconciled; and those that the last run could not read or found edited.

A run is decided once, in a plan with every path, which is written before anything else is done; then the pages that it names are fetched, notes are moved and written, and the rows of state are committed last. A
run that was stopped is finished by that plan, so no note is written twice under two names, and only then the device is looked at again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annolake.functions import text as T
from annolake.operators.incremental import RENDER_VERSION, is_stale, nothing_to_do
from annolake.operators.moves import move_notes, move_plan
from annolake.operators.rendering import managed, note, transcripts
from annolake.operators.routing import free_paths, inherited_tags, tag_changes
from annolake.operators.shared import Rounds
from annolake.sources.device import fetched, generations, listings, read_entries, root_of
from annolake.sources.vault import OWN, Store, opened, publish, vault_paths, write_files
from annolake.streaming.ledger import Ledger

ROWS = (
    "sync_key string, doc_id string, page_id string, tag string, entry_hash string, page_hash string, note_path string, status string, render_version int, block_hash string, n_pages int"
)
PLAN = (
    "sync_key string, old_key string, doc_id string, page_id string, tag string, action string, name string, page_number int, folder string, note_path string, old_path string, entry_hash string, page_hash string, n_pages int"
)
#: What is done with a unit that is written.
WRITING = ("write", "rewrite", "move")


@dataclass(frozen=True)
class Run:
    """What a run did: its plan, the pages that it read, and warnings (doc_id, warning); `forget` deletes the tables."""

    number: int
    generation: int
    plan: DataFrame | None = None
    read: DataFrame | None = None
    warnings: DataFrame | None = None
    tables: list[Rounds] = field(default_factory=list)

    def forget(self) -> None:
        for rounds in self.tables:
            rounds.forget(0)


def _key(page: Column) -> Column:
    return T.sync_key(F.col("doc_id"), page, F.col("tag"))


def fingerprint(mapping: DataFrame) -> str:
    """One line for the tags and folders of the settings."""
    pairs = mapping.groupBy().agg(F.map_from_entries(F.collect_set(F.struct("tag", "folder"))).alias("m"))
    return pairs.select(T.mapping_fingerprint(F.col("m"))).first()[0]


def asking(rows: DataFrame, paths: DataFrame, mapping: DataFrame, render_version: int = RENDER_VERSION) -> DataFrame:
    """(doc_id): documents that are opened for their rows' sake, whatever their hash."""
    here = rows.join(paths.select(F.col("path").alias("note_path"), F.lit(True).alias("_here")), "note_path", "left").join(mapping, "tag", "left")
    active = F.col("status") == "active"
    lost = active & F.col("_here").isNull()
    elsewhere = active & F.col("folder").isNotNull() & ~T.is_in_folder(F.col("note_path"), F.col("folder"))
    unmapped = active & F.col("folder").isNull()
    return here.where(~active | lost | elsewhere | unmapped | is_stale(F.col("render_version"), render_version)).select("doc_id").distinct()


def with_tags(documents: DataFrame, entries: DataFrame) -> DataFrame:
    """The documents with their own and their folders' tags in ``tags``."""
    folders = entries.where(F.col("type") == "CollectionType").select(F.col("doc_id").alias("id"), "parent", "type", "tags")
    if folders.isEmpty():
        return documents.withColumn("tags", F.array_distinct(F.coalesce("tags", F.array().cast("array<string>"))))
    items = folders.unionByName(documents.select(F.col("doc_id").alias("id"), "parent", "type", "tags"))
    got = inherited_tags(items).select(F.col("id").alias("doc_id"), F.col("tags").alias("_more"))
    none = F.array().cast("array<string>")
    return documents.join(got, "doc_id", "left").withColumn("tags", F.array_distinct(F.concat(F.coalesce("tags", none), F.coalesce("_more", none)))).drop("_more")


def units_of(documents: DataFrame, pages: DataFrame, mapping: DataFrame) -> DataFrame:
    """The notes that opened documents ask for: one for each mapped tag of the document, and one for each mapped tag of a page. documents: (doc_id, hash, name, tags); pages as of `device.listings`."""
    counted = pages.where("page_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").cast("int").alias("n_pages"))
    whole = documents.join(counted, "doc_id", "left").select(
        "doc_id", F.lit(None).cast("string").alias("page_id"), F.explode("tags").alias("tag"), "name", F.lit(None).cast("int").alias("page_number"), F.col("hash").alias("entry_hash"), F.col("hash").alias("page_hash"),
        F.coalesce("n_pages", F.lit(0)).alias("n_pages"),
    )
    numbered = pages.where("page_id IS NOT NULL").select("doc_id", "page_id", "page_hash", F.explode(F.array_distinct("page_tags")).alias("tag"), (F.col("ord") + 1).alias("page_number"))
    single = numbered.join(documents.select("doc_id", "name", F.col("hash").alias("entry_hash")), "doc_id").withColumn("n_pages", F.lit(1))
    single = single.withColumn("page_hash", F.coalesce("page_hash", "entry_hash"))
    return whole.unionByName(single.select(*whole.columns)).join(mapping, "tag").withColumn("sync_key", _key(F.col("page_id")))


def decided(units: DataFrame, rows: DataFrame, notes: DataFrame, opened_: DataFrame, render_version: int = RENDER_VERSION) -> DataFrame:
    """Each unit and each row of opened documents with an action. rows: those of opened and vanished documents; notes: (path, block) of their notes; opened_: (doc_id) of the documents that could be read."""
    old = rows.join(notes.select(F.col("path").alias("note_path"), F.lit(True).alias("_here"), "block"), "note_path", "left")
    edited = (F.col("status") == "active") & F.coalesce(T.fnv1a(F.col("block")) != F.col("block_hash"), F.lit(False))
    old = old.withColumn("_edited", edited).withColumn("_here", F.coalesce("_here", F.lit(False)))
    # one tag gone and one new of the same thing is a renaming
    own = ("doc_id", F.coalesce("page_id", F.lit("")).alias("_page"))
    active = old.where("status = 'active'").join(opened_.select("doc_id"), "doc_id", "left_semi")
    before = active.groupBy(*own).agg(F.collect_set("tag").alias("_before"))
    now = units.groupBy(*own).agg(F.collect_set("tag").alias("_now"))
    none = F.array().cast("array<string>")
    change = before.join(now, ["doc_id", "_page"], "full_outer").select("doc_id", "_page", tag_changes(F.coalesce("_before", none), F.coalesce("_now", none)).alias("_c"))
    renamed = change.where("_c.action = 'rename'").select("doc_id", "_page", F.col("_c.old").alias("_old"), F.col("_c.new").alias("tag"))
    page = F.when(F.col("_page") != "", F.col("_page"))
    told = renamed.select("doc_id", "_page", "tag", T.sync_key(F.col("doc_id"), page, F.col("_old")).alias("_renamed"))
    asked = units.withColumn("_page", F.coalesce("page_id", F.lit(""))).join(told, ["doc_id", "_page", "tag"], "left").withColumn("old_key", F.coalesce("_renamed", "sync_key"))
    s = old.select(F.col("sync_key").alias("old_key"), *(F.col(c).alias(f"s_{c}") for c in ("doc_id", "page_id", "tag", "status", "entry_hash", "page_hash", "note_path", "render_version", "n_pages", "_edited", "_here")))
    both = asked.join(s, "old_key", "full_outer")
    known, unit = F.col("s_status").isNotNull(), F.col("sync_key").isNotNull()
    fresh = (F.col("s_status") == "active") & (F.col("page_hash") == F.col("s_page_hash")) & ~is_stale(F.col("s_render_version"), render_version) & F.col("s__here")
    same = F.col("_renamed").isNull() & T.is_in_folder(F.col("s_note_path"), F.col("folder"))
    action = (
        F.when(~unit & (F.col("s_status") == "active"), "orphan").when(~unit, "keep").when(known & F.col("s__edited"), "edited").when(F.col("page_id").isNotNull() & same & fresh, "skip")
        .when(~known, "write").when(~same, "move").otherwise("rewrite")
    )
    return both.select(
        F.coalesce("sync_key", "old_key").alias("sync_key"), "old_key", F.coalesce("doc_id", "s_doc_id").alias("doc_id"), F.when(unit, F.col("page_id")).otherwise(F.col("s_page_id")).alias("page_id"),
        F.coalesce("tag", "s_tag").alias("tag"), action.alias("action"), "name", "page_number", "folder", F.when(same, F.col("s_note_path")).alias("note_path"), F.col("s_note_path").alias("old_path"),
        F.coalesce("entry_hash", "s_entry_hash").alias("entry_hash"), F.coalesce("page_hash", "s_page_hash").alias("page_hash"), F.coalesce("n_pages", "s_n_pages").alias("n_pages"),
    )


def _planned(spark: SparkSession, device: str, vault: str, ledger: Ledger, mapping: DataFrame, number: int, render_version: int, tables: Rounds) -> dict | None:
    """Writes the plan of a run; what it will have reached, or nothing if there is nothing to do."""
    before, store = ledger.latest(), Store(device)
    generation = max(generations(store), default=0)
    top, marks = root_of(store, generation), fingerprint(mapping)
    rows, paths = ledger.read(before), tables.write(vault_paths(spark, vault))  # the vault is listed once
    since = before.meta.get("generation", 0)
    if nothing_to_do(top["root"], before.meta.get("root"), marks, before.meta.get("mappings", ""), rows, paths, render_version):
        return None
    if root_of(store, since)["buckets"] not in (None, top["buckets"]):
        since = 0
    changed = tables.write(read_entries(spark, device, generation, since))
    entries = read_entries(spark, device, generation)
    documents = entries.where("type = 'DocumentType'")
    asks = asking(rows, paths, mapping, render_version)
    if before.number >= 0:  # what the last run could not read, or left alone because it had been edited, is asked for until that is over
        last = f"{ledger.path}/plans/{before.number}"
        asks = asks.unionByName(spark.read.parquet(f"{last}/pages").where("unreadable").select("doc_id")).unionByName(spark.read.schema(PLAN).parquet(f"{last}/units").where("action = 'edited'").select("doc_id"))
    if marks == before.meta.get("mappings") and changed.where("type = 'CollectionType'").isEmpty():
        wanted = changed.where("type = 'DocumentType' AND NOT gone").select("doc_id").unionByName(asks).distinct()
        found = tables.write(with_tags(documents.join(wanted, "doc_id", "left_semi"), entries))
    else:  # a tag can have come to any document, or gone from it
        tagged = tables.write(with_tags(documents, entries))
        now = tagged.select("doc_id", F.explode("tags").alias("tag")).join(mapping.select("tag"), "tag", "left_semi").withColumn("_now", F.lit(True))
        then = rows.where("page_id IS NULL AND status = 'active'").select("doc_id", "tag").withColumn("_then", F.lit(True))
        loose = now.join(then, ["doc_id", "tag"], "full_outer").where("_now IS NULL OR _then IS NULL").select("doc_id")
        wanted = changed.where("type = 'DocumentType' AND NOT gone").select("doc_id").unionByName(asks).unionByName(loose).distinct()
        found = tagged.join(wanted, "doc_id", "left_semi")
    listed = tables.write(listings(found, device))
    unreadable = listed.where("unreadable").select("doc_id").distinct()
    found = tables.write(found.join(unreadable, "doc_id", "left_anti").select("doc_id", "hash", "name", "tags"))
    units = tables.write(units_of(found, listed, mapping))
    lost = changed.where("gone AND type = 'DocumentType'").select("doc_id")
    own = tables.write(rows.join(found.select("doc_id").unionByName(lost), "doc_id", "left_semi"))
    held = opened(own.where("status = 'active'").select(F.col("note_path").alias("path")).distinct(), vault).where("content IS NOT NULL")
    notes = tables.write(held.select("path", T.managed_block(F.col("content").cast("string")).alias("block")))
    plan = tables.write(decided(units, own, notes, found, render_version))
    nameless = plan.where(F.col("action").isin(*WRITING) & F.col("note_path").isNull())
    asked = nameless.select(F.col("sync_key").alias("key"), T.without_end_slashes(F.col("folder")).alias("folder"), T.base_name(F.col("name"), F.col("page_number")).alias("base"), "tag", "doc_id")
    whole = plan
    if not asked.isEmpty():
        given = free_paths(asked, paths).select(F.col("key").alias("sync_key"), F.col("path").alias("_given"))
        whole = plan.join(given, "sync_key", "left").withColumn("note_path", F.coalesce("note_path", "_given")).drop("_given")
    whole = whole.withColumn("note_path", F.coalesce("note_path", "old_path"))
    base = f"{ledger.path}/plans/{number}"
    whole.select(*(f.split(" ")[0] for f in PLAN.split(", "))).write.mode("overwrite").parquet(f"{base}/units")
    listed.write.mode("overwrite").parquet(f"{base}/pages")
    meta = {"generation": generation, "root": top["root"], "mappings": marks, "run": uuid.uuid4().hex}
    ledger.put(f"plans/{number}/made", json.dumps(meta))
    return meta


def run(
    spark: SparkSession, device: str, vault: str, state: str, mapping: DataFrame, read: Callable[[DataFrame], DataFrame], attachments: str = T.DEFAULT_ATTACHMENTS, render_version: int = RENDER_VERSION, buckets: int = 64
) -> Run:
    """One run. ``mapping``: (tag, folder). ``read`` turns (doc_id, page_id, content) into (doc_id, page_id, status, text, attachment binary), as a recognition backend and a renderer do; status is ok, failed or skipped."""
    publish(spark, vault)
    ledger, tables = Ledger(spark, state, ROWS, "doc_id", buckets), Rounds(spark, "run")
    before = ledger.latest()
    number = before.number + 1
    if ledger.exists(f"plans/{number}/made"):  # of a run that was stopped
        meta = json.loads(ledger.text(f"plans/{number}/made"))
    else:
        meta = _planned(spark, device, vault, ledger, mapping, number, render_version, tables)
        if meta is None:
            return Run(before.number, before.meta["generation"], tables=[tables])
    units = spark.read.schema(PLAN).parquet(f"{ledger.path}/plans/{number}/units")
    listed = spark.read.parquet(f"{ledger.path}/plans/{number}/pages")
    written = units.where(F.col("action").isin(*WRITING))
    moving = written.where("action = 'move'").select(F.col("old_path").alias("src"), F.col("note_path").alias("dst"))
    if not moving.isEmpty():
        moves = f"{ledger.path}/plans/{number}/moves"
        if not ledger.exists(f"plans/{number}/moves/_SUCCESS"):
            move_plan(moving, vault_paths(spark, vault)).write.mode("overwrite").parquet(moves)
        move_notes(spark.read.parquet(moves), vault, meta["run"])
    # every page once, for all the units that show it
    pages = listed.where("page_id IS NOT NULL").select("doc_id", "page_id", "ord", "page_hash")
    shown = written.where("page_id IS NOT NULL").select("sync_key", "doc_id", "page_id").join(pages, ["doc_id", "page_id"])
    shown = shown.unionByName(written.where("page_id IS NULL").select("sync_key", "doc_id").join(pages, "doc_id").select(*shown.columns))
    needed = tables.write(shown.select("doc_id", "page_id", "page_hash").distinct())
    told = tables.write(read(fetched(needed, device, "blobs", "page_hash")))
    labelled = shown.join(told, ["doc_id", "page_id"]).join(written.select("sync_key", "doc_id", F.col("page_id").alias("_own"), "page_number"), ["sync_key", "doc_id"])
    label = F.coalesce("page_number", F.col("ord") + 1)
    embed = T.attachment_path(F.lit(attachments), F.col("doc_id"), F.col("_own"))
    sheets = labelled.select("sync_key", "doc_id", label.alias("label"), F.when(F.col("_own").isNull(), F.col("ord") + 1).otherwise(1).alias("embed"), "status", "text", embed.alias("path"), "attachment", "ord")
    # a page's heading links into the unit's attachment
    texts = transcripts(sheets, "sync_key", F.col("path"))
    files = F.aggregate(F.sort_array(F.collect_list(F.struct("ord", "attachment"))), F.lit("").cast("binary"), lambda a, x: F.concat(a, F.coalesce(x["attachment"], F.lit("").cast("binary"))))
    bound = sheets.dropDuplicates(["path", "ord"]).groupBy("path").agg(files.alias("content"))
    nothing = F.lit("")
    blocks = written.join(texts, "sync_key", "left").withColumn("_block", managed(T.attachment_path(F.lit(attachments), F.col("doc_id"), F.col("page_id")), nothing, nothing, F.coalesce("transcript", nothing)))
    whole = opened(blocks.select("sync_key", "note_path", "_block"), vault, "note_path", "_old")
    notes = tables.write(whole.select("sync_key", F.col("note_path").alias("path"), note(F.col("_block"), F.col("_old").cast("string")).cast("binary").alias("content"), T.fnv1a(F.col("_block")).alias("block_hash")))
    write_files(notes.select("path", "content").unionByName(bound), vault)
    rows = units.join(notes.select("sync_key", "block_hash"), "sync_key", "left")
    _commit(ledger, before, number, rows, meta, render_version)
    Store(vault).delete(f"{OWN}/moves-{meta['run']}")
    return Run(number, meta["generation"], units, needed, listed.where("unreadable").select("doc_id", F.lit("could not be read").alias("warning")), [tables])


def _commit(ledger: Ledger, before, number: int, plan: DataFrame, meta: dict, render_version: int) -> None:
    """The rows of all documents of the plan, in place of what they had; rows that were left alone because they had been edited keep their hash."""
    touched = [r[0] for r in plan.select(ledger.bucket().cast("int").alias("b")).distinct().collect()]  # at most the number of buckets
    old = ledger.read(before, touched)
    kept = old.select("sync_key", *(F.col(c).alias(f"s_{c}") for c in ("tag", "entry_hash", "page_hash", "note_path", "status", "render_version", "block_hash", "n_pages")))
    # a row that was renamed goes; one that was edited stays as it is under its own key
    key = F.when(F.col("action") == "edited", F.col("old_key")).otherwise(F.col("sync_key"))
    rows = plan.withColumn("sync_key", key).join(kept, "sync_key", "left")
    wrote, still = F.col("action").isin(*WRITING), F.col("action").isin("edited", "keep", "orphan")
    stay = lambda c: F.coalesce(f"s_{c}", c)
    tag = F.when(F.col("action") == "edited", F.col("s_tag")).otherwise(F.col("tag"))
    new = rows.select(
        "sync_key", "doc_id", "page_id", tag.alias("tag"), F.when(still, stay("entry_hash")).otherwise(F.col("entry_hash")).alias("entry_hash"), F.when(still, stay("page_hash")).otherwise(F.col("page_hash")).alias("page_hash"),
        F.when(wrote, F.col("note_path")).otherwise(stay("note_path")).alias("note_path"), F.when(F.col("action") == "orphan", "orphaned").when(still, F.col("s_status")).otherwise("active").alias("status"),
        F.when(wrote, F.lit(render_version)).otherwise(F.col("s_render_version")).alias("render_version"), F.when(wrote, F.col("block_hash")).otherwise(F.col("s_block_hash")).alias("block_hash"),
        F.when(still, stay("n_pages")).otherwise(F.col("n_pages")).alias("n_pages"),
    )
    gone = plan.select(F.col("old_key").alias("sync_key")).unionByName(plan.select("sync_key"))
    ledger.commit(number, before, old.join(gone.where("sync_key IS NOT NULL").distinct(), "sync_key", "left_anti").unionByName(new), touched, meta)
    if before.number >= 0:
        ledger.delete(f"plans/{before.number - 1}")
