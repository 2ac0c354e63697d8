"""Queries on whole runs: conversations as documents on a device, whose turns are pages, synchronised into a vault of notes; and moves of notes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from annolake.operators.moves import move_notes, move_plan
from annolake.operators.shared import Rounds, shared_folder
from annolake.plans.catalogue import query, table
from annolake.sources import device as D
from annolake.sources import vault as V
from annolake.streaming import progress as P
from annolake.streaming import run as R


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _put(spark, turns, root):
    """The turns (conv_id, turn, role, text) as a generation of documents: all tagged by a kind of conversation, and answers as single pages."""
    content = F.coalesce("text", F.lit("")).cast("binary")
    pages = turns.select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("string").alias("page_id"), "turn", F.sha2(content, 256).alias("hash"), content.alias("content"), (F.col("role") == "assistant").alias("answer"))
    D.put_files(pages.select("hash", "content").dropDuplicates(["hash"]), root, "blobs")
    line = F.to_json(F.struct("page_id", F.col("turn").cast("int").alias("ord"), "hash", F.when(F.col("answer"), F.array(F.lit("answer"))).otherwise(F.array().cast("array<string>")).alias("tags")))
    listed = pages.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    listed = listed.withColumn("hash", F.sha2(F.concat_ws("\n", "doc_id", "text"), 256))
    D.put_files(listed.select("hash", F.col("text").cast("binary").alias("content")), root, "documents")
    tag = F.when(F.col("doc_id").cast("long") % 2 == 0, "even").otherwise("odd")
    entries = listed.select("doc_id", "hash", F.concat(F.lit("Talk "), "doc_id").alias("name"), F.lit("DocumentType").alias("type"), F.lit("").alias("parent"), F.array(tag).alias("tags"))
    D.put_generation(entries, root)


def _read(pages):
    text = F.col("content").cast("string")
    return pages.select("doc_id", "page_id", F.when(F.col("content").isNull(), "skipped").otherwise("ok").alias("status"), F.coalesce(text, F.lit("")).alias("text"), F.col("content").alias("attachment"))


@query(
    "two_runs",
    """
    WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
    units AS (SELECT conv_id, NULL::BIGINT AS page, CASE WHEN conv_id % 2 = 0 THEN 'even' END AS tag FROM t GROUP BY conv_id UNION ALL SELECT conv_id, turn, 'answer' FROM t WHERE role = 'assistant'),
    kept AS (SELECT *, conv_id % 7 = 0 AS changed, conv_id % 11 = 0 AS gone FROM units WHERE tag IS NOT NULL),
    lasts AS (SELECT DISTINCT conv_id, last FROM t),
    acts AS (
      SELECT k.conv_id, page, CASE WHEN gone THEN 'orphan' WHEN NOT changed THEN NULL WHEN page IS NULL OR page = last THEN 'rewrite' ELSE 'skip' END AS action FROM kept k JOIN lasts USING (conv_id)
    )
    SELECT conv_id::VARCHAR AS doc_id, count(*) FILTER (action = 'rewrite') AS n_written, count(*) FILTER (action = 'skip') AS n_skipped, count(*) FILTER (action = 'orphan') AS n_orphaned,
           CASE WHEN any_value(conv_id % 11 = 0) THEN 0 WHEN any_value(conv_id % 2 = 0) THEN (SELECT count(DISTINCT turn) FROM t x WHERE x.conv_id = a.conv_id)
                ELSE count(*) FILTER (action = 'rewrite') END::BIGINT AS n_read
    FROM acts a WHERE action IS NOT NULL GROUP BY conv_id
    """,
)
def two_runs(spark, sf_dir):
    """Two runs: all talks, then the same device with the last turn of every seventh talk changed and every eleventh talk gone. What the second one did and which pages it read."""
    device, vault, state, out = _folder(spark, "device"), _folder(spark, "vault"), _folder(spark, "state"), Rounds(spark, "two-runs")
    mapping = spark.createDataFrame([("even", "Talks"), ("answer", "Answers")], "tag string, folder string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    _put(spark, turns, device)
    R.run(spark, device, vault, state, mapping, _read).forget()
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    later = turns.join(last, "conv_id").where(F.col("conv_id") % 11 != 0)
    later = later.withColumn("text", F.when((F.col("conv_id") % 7 == 0) & (F.col("turn") == F.col("_last")), F.concat(F.coalesce("text", F.lit("")), F.lit(" (changed)"))).otherwise(F.col("text")))
    _put(spark, later.drop("_last"), device)
    done = R.run(spark, device, vault, state, mapping, _read)
    n = lambda action: F.count(F.when(F.col("action") == action, 1)).alias
    acts = done.plan.groupBy("doc_id").agg(n("rewrite")("n_written"), n("skip")("n_skipped"), n("orphan")("n_orphaned"))
    read = done.read.groupBy("doc_id").agg(F.count("*").alias("n_read"))
    result = out.write(acts.join(read, "doc_id", "left").withColumn("n_read", F.coalesce("n_read", F.lit(0).cast("long"))))
    done.forget()
    for root in (device, vault, state):
        V.Store(root).delete("")
    return result


_NOTES = "SELECT c_custkey, c_nationkey, 'Notes/' || c_nationkey || '/' || c_name || '.md' AS path, c_name || ' ' || c_mktsegment AS content FROM customer"


@query(
    "note_moves",
    f"""
    WITH n AS ({_NOTES}),
    m AS (SELECT *, lead(path) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS next, first_value(path) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS first FROM n)
    SELECT CASE WHEN next IS NOT NULL THEN next WHEN c_nationkey % 2 = 0 THEN first ELSE 'Notes/' || c_nationkey || '/free.md' END AS path, sha256(content) AS sha256 FROM m
    """,
)
def note_moves(spark, sf_dir):
    """Every customer's note takes the path of the next one of its nation; the last takes the first one's path in every second nation (a ring) and a free one in the others (a chain)."""
    from pyspark.sql import Window as W

    root, out = _folder(spark, "vault"), Rounds(spark, "note-moves")
    path = F.concat(F.lit("Notes/"), "c_nationkey", F.lit("/"), "c_name", F.lit(".md"))
    notes = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", path.alias("path"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("content"))
    V.write_files(V.dealt(notes, "path"), root)
    w = W.partitionBy("c_nationkey").orderBy("c_custkey")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    end = F.when(F.col("c_nationkey") % 2 == 0, F.first("path").over(whole)).otherwise(F.concat(F.lit("Notes/"), "c_nationkey", F.lit("/free.md")))
    moves = notes.select(F.col("path").alias("src"), F.coalesce(F.lead("path").over(w), end).alias("dst"))
    move_notes(move_plan(moves, V.vault_paths(spark, root)), root, "all")
    result = out.write(V.read_vault(spark, root).select("path", F.sha2("content", 256).alias("sha256")))
    V.Store(root).delete("")
    return result


@query("entries_between", "SELECT o_orderkey::VARCHAR AS doc_id, o_orderkey % 13 = 0 AS gone FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 13 = 0")
def entries_between(spark, sf_dir):
    """Orders as documents of two generations, of which every fifth is changed and every thirteenth gone in the second: what the device source reads between them."""
    root, out = _folder(spark, "device"), Rounds(spark, "entries")
    k = F.col("o_orderkey")

    def entries(mark):
        return table(spark, sf_dir, "orders").select(k.cast("string").alias("doc_id"), F.concat("o_orderpriority", mark).alias("hash"), "o_orderstatus", k).select(
            "doc_id", "hash", F.col("o_orderstatus").alias("name"), F.lit("DocumentType").alias("type"), F.lit("").alias("parent"), F.array("hash").alias("tags"), "o_orderkey"
        )

    D.put_generation(entries(F.lit("")), root)
    D.put_generation(entries(F.when(k % 5 == 0, F.lit("!")).otherwise(F.lit(""))).where(k % 13 != 0), root)
    result = out.write(D.read_entries(spark, root, since=1).select("doc_id", "gone"))
    V.Store(root).delete("")
    return result


@query(
    "progress",
    """
    WITH u AS (SELECT o_custkey AS run, o_orderkey AS line, floor(o_totalprice)::BIGINT % 4 AS pages, floor(o_totalprice)::BIGINT % 3 AS steps FROM orders),
    e AS (SELECT run, line, 0 AS k, steps, 0 AS own FROM u UNION ALL SELECT run, line, k, steps, k FROM (SELECT *, unnest(range(1, pages + 1)) AS k FROM u) WHERE k <= steps UNION ALL SELECT run, line, 9, steps, steps FROM u),
    b AS (SELECT e.*, coalesce((SELECT sum(steps) FROM u WHERE u.run = e.run AND u.line < e.line), 0) + own AS done, (SELECT sum(steps) FROM u WHERE u.run = e.run) AS total FROM e)
    SELECT run, count(*) AS n_shown, max(done)::BIGINT AS done, max(total)::BIGINT AS total, md5(string_agg(done::BIGINT::VARCHAR, ',' ORDER BY line, k)) AS done_md5 FROM b WHERE total > 0 GROUP BY run
    """,
)
def progress(spark, sf_dir):
    """Customers as runs whose orders are units of some steps and some pages, more or fewer than the steps: what is shown as done after each event."""
    q = F.floor("o_totalprice").cast("int")
    kinds = F.concat(F.array(F.lit("start")), F.array_repeat(F.lit("page"), q % 4), F.array(F.lit("finish")))
    events = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), "o_orderkey", (q % 3).alias("steps"), F.posexplode(kinds).alias("k", "kind"))
    shown = P.progress(events.withColumn("ord", F.struct("o_orderkey", "k")))
    told = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "done"))), lambda x: x["done"].cast("string")), ",")
    return shown.groupBy("run").agg(F.count("*").alias("n_shown"), F.max("done").alias("done"), F.max("total").alias("total"), F.md5(told).alias("done_md5"))
