"""Transcribing all notes again: a backfill that can be stopped between any two notes and goes on behind the last one.

The work is fixed when it begins: the active rows of state, in order, in chunks. A chunk's pages are fetched and read, the notes' transcripts are replaced and nothing else of them, the new block hashes are appended to a
journal, and only then the next chunk begins. Whoever starts again skips what the journal has; a note that was written but not journaled is written again, with the same content. In the end the state takes the
journal's hashes over, so the next run does not take them for somebody's edits. A stop is asked for between chunks."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annolake.functions import text as T
from annolake.operators.rendering import transcripts, with_transcript
from annolake.sources.device import fetched, listings, read_entries
from annolake.sources.vault import opened, publish, write_files
from annolake.streaming.ledger import Ledger
from annolake.streaming.progress import Ticker
from annolake.streaming.run import ROWS

JOURNAL = "sync_key string, updated boolean, block_hash string"
#: Notes of a chunk.
CHUNK = 1000


def _work(spark: SparkSession, device: str, ledger: Ledger, base: str, chunk: int) -> None:
    """Writes down what is to be done: (sync_key, doc_id, page_id, note_path, part) of the active rows whose document can be read, and the pages that they show."""
    rows = ledger.read(ledger.latest()).where("status = 'active'").select("sync_key", "doc_id", "page_id", "note_path")
    documents = read_entries(spark, device).where("type = 'DocumentType'").select("doc_id", "hash").join(rows.select("doc_id").distinct(), "doc_id", "left_semi")
    listings(documents, device).where("page_id IS NOT NULL").select("doc_id", "page_id", "ord", "page_hash").write.mode("overwrite").parquet(f"{ledger.path}/{base}/pages")
    pages = spark.read.parquet(f"{ledger.path}/{base}/pages")
    there = rows.join(pages.select("doc_id", "page_id"), ["doc_id", "page_id"], "left_semi").select(*rows.columns).unionByName(rows.where("page_id IS NULL").join(pages.select("doc_id").distinct(), "doc_id", "left_semi").select(*rows.columns))
    # numbered by range: sorted parts and their sizes, so that no task sees all rows
    ranged = there.repartitionByRange("sync_key").sortWithinPartitions("sync_key").withColumn("_p", F.spark_partition_id())
    ranged.write.mode("overwrite").parquet(f"{ledger.path}/{base}/ranged")
    ranged = spark.read.parquet(f"{ledger.path}/{base}/ranged")
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # one row a partition
    at = F.row_number().over(W.partitionBy("_p").orderBy("sync_key")) - 1 + F.col("_before")
    numbered = ranged.join(sizes, "_p").withColumn("part", F.floor(at / chunk).cast("int"))
    numbered.select("sync_key", "doc_id", "page_id", "note_path", "part").write.mode("overwrite").partitionBy("part").parquet(f"{ledger.path}/{base}/rows")
    n = numbered.agg(F.max("part")).first()[0]
    ledger.put(f"{base}/made", json.dumps({"parts": 0 if n is None else n + 1}))


def transcribe_again(
    spark: SparkSession, device: str, vault: str, state: str, read: Callable[[DataFrame], DataFrame], name: str, chunk: int = CHUNK, stop: Callable[[], bool] = lambda: False, buckets: int | None = None,
    report: Callable[[int, int], None] = lambda done, total: None,
) -> tuple[int, bool]:
    """How many notes got a new transcript, in all starts of the backfill of that name together, and whether it was stopped. ``read`` as of `run.run`. A note whose block has no transcript to replace, a digest, or that is gone is left alone. ``report`` gets how many of the
    pages are done, and of how many, after each chunk; what an earlier start did counts as done."""
    publish(spark, vault)
    ledger = Ledger(spark, state, ROWS, "doc_id", buckets)
    before, base = ledger.latest(), f"backfills/{name}"
    if not ledger.exists(f"{base}/made"):
        _work(spark, device, ledger, base, chunk)
    parts = json.loads(ledger.text(f"{base}/made"))["parts"]
    rows, pages = spark.read.parquet(f"{ledger.path}/{base}/rows") if parts else None, spark.read.parquet(f"{ledger.path}/{base}/pages")
    steps = _steps(rows, pages) if parts else {}
    stopped, ticker = False, Ticker(sum(steps.values()), report)
    for part in range(parts):
        if ledger.exists(f"{base}/journal/part={part}/_SUCCESS"):
            ticker.finish(steps.get(part, 0))
            continue
        if stop():
            stopped = True
            break
        own = rows.where(F.col("part") == part)
        ticker.watched(_chunk(own, pages, device, vault, read).join(_shown(own, pages).groupBy("sync_key").agg(F.count("*").alias("_steps")), "sync_key", "left"), F.col("_steps")).select(*(f.split(" ")[0] for f in JOURNAL.split(", "))).write.mode("overwrite").parquet(f"{ledger.path}/{base}/journal/part={part}")
        ticker.finish(steps.get(part, 0))
    done = [p for p in range(parts) if ledger.exists(f"{base}/journal/part={p}/_SUCCESS")]
    journal = spark.read.schema(JOURNAL).parquet(*(f"{ledger.path}/{base}/journal/part={p}" for p in done)) if done else spark.createDataFrame([], JOURNAL)
    if not ledger.exists(f"{base}/over"):
        _take_over(ledger, before, journal.where("updated"))  # also of a stopped backfill: its notes were rewritten
        if not stopped:
            ledger.put(f"{base}/over", "")
    return journal.where("updated").count(), stopped


def _shown(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """The pages of each row: all of its document's, or its own."""
    shown = rows.where("page_id IS NOT NULL").join(pages, ["doc_id", "page_id"]).select("sync_key", "doc_id", "page_id", "ord", "page_hash", F.lit(True).alias("single"))
    return shown.unionByName(rows.where("page_id IS NULL").select("sync_key", "doc_id").join(pages, "doc_id").select("sync_key", "doc_id", "page_id", "ord", "page_hash", F.lit(False).alias("single")))


def _steps(rows: DataFrame, pages: DataFrame) -> dict[int, int]:
    """Pages of each chunk: one number a chunk."""
    counted = _shown(rows, pages).groupBy("sync_key").agg(F.count("*").alias("n")).join(rows.select("sync_key", "part"), "sync_key")
    return {r["part"]: r["n"] for r in counted.groupBy("part").agg(F.sum("n").alias("n")).collect()}


def _chunk(rows: DataFrame, pages: DataFrame, device: str, vault: str, read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rewrites a chunk's transcripts; its rows of the journal."""
    shown = _shown(rows, pages)
    told = read(fetched(shown.select("doc_id", "page_id", "page_hash").distinct(), device, "blobs", "page_hash"))
    old = opened(rows.select("sync_key", "note_path"), vault, "note_path", "_old").withColumn("old", F.col("_old").cast("string")).drop("_old").where("old IS NOT NULL")
    # headings link into the note's own embed, which only the note knows; without one the text stands alone
    sheets = shown.join(told, ["doc_id", "page_id"]).join(old.select("sync_key", T.embed_of(F.col("old")).alias("path")), "sync_key")
    linked = transcripts(sheets.where("path IS NOT NULL").select("sync_key", (F.col("ord") + 1).alias("label"), F.when(F.col("single"), 1).otherwise(F.col("ord") + 1).alias("embed"), "status", "text", "path"), "sync_key", F.col("path"))
    plain = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("status") == "ok", F.struct("ord", "text")))), lambda x: x["text"]), "\n\n")
    bare = sheets.where("path IS NULL").groupBy("sync_key").agg(plain.alias("transcript"))
    new = old.join(linked.unionByName(bare), "sync_key").withColumn("content", with_transcript(F.col("old"), F.col("transcript")))
    made = new.select("sync_key", "note_path", "content", T.fnv1a(T.managed_block(F.col("content"))).alias("block_hash"))
    write_files(made.where("content IS NOT NULL"), vault, "note_path")
    # what was written is what the journal tells, not what a second reading of the pages might give
    now = opened(made.select("sync_key", "note_path", F.col("content").isNotNull().alias("updated")), vault, "note_path", "_now")
    return now.select("sync_key", "updated", T.fnv1a(T.managed_block(F.col("_now").cast("string"))).alias("block_hash"))


def _take_over(ledger: Ledger, before, journal: DataFrame) -> None:
    old = ledger.read(before)
    touched = [r[0] for r in old.join(journal.select("sync_key"), "sync_key", "left_semi").select(ledger.bucket().cast("int").alias("b")).distinct().collect()]  # at most the number of buckets
    if touched:
        new = ledger.read(before, touched).join(journal.select("sync_key", F.col("block_hash").alias("_new")), "sync_key", "left").withColumn("block_hash", F.coalesce("_new", "block_hash"))
        ledger.commit(before.number + 1, before, new, touched, before.meta)
        if ledger.exists(f"plans/{before.number}"):  # of which the next run reads what it left open
            ledger.fs.rename(ledger.Path(f"{ledger.path}/plans/{before.number}"), ledger.Path(f"{ledger.path}/plans/{before.number + 1}"))
