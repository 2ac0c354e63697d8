"""Queries on documents, pages and their rows of state."""

from __future__ import annotations

from pyspark.sql import functions as F

from annolake.functions import text as T
from annolake.operators import units as U
from annolake.plans.catalogue import query, table


def _k():
    return F.col("o_orderkey")


#: Orders as rows of state, and the same in SQL.
_ROWS = """rows AS (SELECT o_orderkey::VARCHAR AS sync_key, o_orderkey AS k, o_custkey::VARCHAR AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 8)::VARCHAR END AS page_id, o_orderpriority AS tag,
    CASE WHEN o_orderkey % 7 = 0 THEN 'orphaned' ELSE 'active' END AS status, 'h' || (o_orderkey % 5) AS entry_hash, CASE WHEN o_orderkey % 4 = 0 THEN 29 ELSE 30 END AS version, (o_orderkey % 4)::INT AS n_pages FROM orders),
    docs AS (SELECT c_custkey::VARCHAR AS doc_id, 'h' || (c_custkey % 5) AS hash, (c_custkey % 4)::INT AS n_pages FROM customer WHERE c_custkey % 11 <> 0),
    pages_ AS (SELECT c_custkey::VARCHAR AS doc_id, p::VARCHAR AS page_id FROM customer, range(6) t(p) WHERE p < c_custkey % 6)"""


def _rows(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        _k().cast("string").alias("sync_key"), _k().alias("ord"), F.col("o_custkey").cast("string").alias("doc_id"), F.when(_k() % 3 == 0, (_k() % 8).cast("string")).alias("page_id"), F.col("o_orderpriority").alias("tag"),
        F.when(_k() % 7 == 0, "orphaned").otherwise("active").alias("status"), F.concat(F.lit("h"), (_k() % 5).cast("string")).alias("entry_hash"), F.when(_k() % 4 == 0, 29).otherwise(30).alias("render_version"),
        (_k() % 4).cast("int").alias("n_pages"), F.concat(F.lit("n/"), _k().cast("string")).alias("note_path"),
    )


def _documents(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").where(k % 11 != 0).select(k.cast("string").alias("doc_id"), F.concat(F.lit("h"), (k % 5).cast("string")).alias("hash"), (k % 4).cast("int").alias("n_pages"))


def _pages(spark, sf_dir):
    k = F.col("c_custkey")
    pages = F.filter(F.sequence(F.lit(0), F.lit(5)), lambda p: p < k % 6)
    return table(spark, sf_dir, "customer").select(k.cast("string").alias("doc_id"), F.explode(F.transform(pages, lambda p: p.cast("string"))).alias("page_id"))


@query(
    "live_page_tags",
    f"""
    WITH {_ROWS} SELECT doc_id, page_id, array_to_string(list(tag ORDER BY k, tag), ',') AS tags FROM rows WHERE page_id IS NOT NULL AND (doc_id, page_id) IN (SELECT doc_id, page_id FROM pages_) GROUP BY doc_id, page_id
    """,
)
def live_page_tags(spark, sf_dir):
    tags = _rows(spark, sf_dir).where("page_id IS NOT NULL")
    return U.live_page_tags(tags, _pages(spark, sf_dir)).select("doc_id", "page_id", F.array_join("tags", ",").alias("tags"))


@query(
    "unreconciled",
    """
    WITH d AS (SELECT c_custkey AS doc_id, unnest([c_mktsegment, '1-URGENT', '2-HIGH']) AS tag FROM customer), m AS (SELECT unnest(['1-URGENT', '2-HIGH', '5-LOW']) AS tag),
    now AS (SELECT DISTINCT doc_id, tag FROM d WHERE tag IN (SELECT tag FROM m)), r AS (SELECT DISTINCT o_custkey AS doc_id, o_orderpriority AS tag FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 7 <> 0),
    x AS ((SELECT * FROM now EXCEPT SELECT * FROM r) UNION (SELECT * FROM r EXCEPT SELECT * FROM now))
    SELECT DISTINCT doc_id::VARCHAR AS doc_id FROM x WHERE doc_id IN (SELECT c_custkey FROM customer)
    """,
)
def unreconciled(spark, sf_dir):
    documents = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("doc_id"), F.array("c_mktsegment", F.lit("1-URGENT"), F.lit("2-HIGH")).alias("tags"))
    return U.unreconciled(documents, _rows(spark, sf_dir), spark.createDataFrame([("1-URGENT",), ("2-HIGH",), ("5-LOW",)], "tag string"))


def _notes(spark, sf_dir):
    """Notes of rows: every sixth is missing, every ninth without a fence, every fourth with another text than was written."""
    text = F.concat(F.lit("top\n\n## Transcript\nsaid "), F.when(_k() % 4 == 0, "otherwise").otherwise("so"), F.lit("\n"))
    return table(spark, sf_dir, "orders").where(_k() % 6 != 0).select(F.concat(F.lit("n/"), _k().cast("string")).alias("path"), F.concat(text, F.when(_k() % 9 == 0, "").otherwise(T.FENCE_END), F.lit("\nmine")).alias("content"))


@query("edited_notes", f"WITH {_ROWS} SELECT sync_key, status = 'active' AND k % 5 <> 0 AND k % 6 <> 0 AND k % 9 <> 0 AND k % 4 = 0 AS edited FROM rows")
def edited_notes(spark, sf_dir):
    written = T.fnv1a(F.lit(f"top\n\n## Transcript\nsaid so\n{T.FENCE_END}"))
    return U.edited(_rows(spark, sf_dir).withColumn("block_hash", F.when(F.col("ord") % 5 != 0, written)), _notes(spark, sf_dir))


@query(
    "reusable_transcripts",
    f"""
    WITH {_ROWS} SELECT sync_key, 'said otherwise' AS transcript FROM rows JOIN docs USING (doc_id) WHERE status = 'active' AND version < 30 AND entry_hash = hash AND doc_id::BIGINT % 6 < 4 AND k % 6 <> 0 AND k % 9 <> 0
    """,
)
def reusable_transcripts(spark, sf_dir):
    pages = _pages(spark, sf_dir).select("doc_id", (F.col("page_id") == "4").alias("typed"), (F.col("page_id") == "3").alias("placed"))
    return U.reusable_transcripts(_rows(spark, sf_dir), _notes(spark, sf_dir), _documents(spark, sf_dir), pages)


@query("stored_hashes", f"WITH {_ROWS} SELECT doc_id, arg_min(entry_hash, k) AS entry_hash FROM rows GROUP BY doc_id")
def stored_hashes(spark, sf_dir):
    return U.stored_hashes(_rows(spark, sf_dir))


@query("bumped_hashes", f"WITH {_ROWS} SELECT sync_key, CASE WHEN k % 10 <> 0 AND hash IS NOT NULL THEN hash ELSE entry_hash END AS entry_hash FROM rows LEFT JOIN docs USING (doc_id)")
def bumped_hashes(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return U.bumped(rows, _documents(spark, sf_dir), rows.where("ord % 10 = 0")).select("sync_key", "entry_hash")


@query("relaid_documents", f"WITH {_ROWS} SELECT DISTINCT doc_id, rows.n_pages AS before, docs.n_pages AS now FROM rows JOIN docs USING (doc_id) WHERE status = 'active' AND rows.n_pages <> docs.n_pages")
def relaid_documents(spark, sf_dir):
    return U.relaid(_rows(spark, sf_dir), _documents(spark, sf_dir))


@query("rows_by_document", f"WITH {_ROWS} SELECT doc_id, array_to_string(list(sync_key ORDER BY k), ',') AS sync_keys FROM rows WHERE status = 'active' GROUP BY doc_id")
def rows_by_document(spark, sf_dir):
    return U.rows_by_document(_rows(spark, sf_dir)).select("doc_id", F.array_join("sync_keys", ",").alias("sync_keys"))


_STEPS = "s AS (SELECT sync_key, CASE WHEN page_id IS NULL THEN doc_id::BIGINT % 6 WHEN page_id::BIGINT < doc_id::BIGINT % 6 THEN 1 ELSE 0 END AS steps FROM rows WHERE status = 'active')"


@query("transcription_steps", f"WITH {_ROWS}, {_STEPS} SELECT * FROM s")
def transcription_steps(spark, sf_dir):
    return U.transcription_steps(_rows(spark, sf_dir), _pages(spark, sf_dir))


@query("workload", f"WITH {_ROWS}, {_STEPS} SELECT sum(steps)::BIGINT AS steps FROM s")
def workload(spark, sf_dir):
    return U.workload(_rows(spark, sf_dir), _pages(spark, sf_dir))


@query("state_counts", f"WITH {_ROWS} SELECT doc_id, count(*) FILTER (WHERE status = 'active') AS n_active, sum(length(tag) % 4)::BIGINT AS n_items, sum(n_pages)::BIGINT AS n_bytes FROM rows GROUP BY doc_id")
def state_counts(spark, sf_dir):
    items = F.when(F.length("tag") % 4 == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.length("tag") % 4))
    rows = _rows(spark, sf_dir).withColumn("items", items)
    return rows.groupBy("doc_id").agg(U.active_count(F.col("status")).alias("n_active"), U.item_count(F.col("items")).alias("n_items"), U.download_total(F.col("n_pages")).alias("n_bytes"))


@query(
    "partial_outcomes",
    """
    WITH r AS (SELECT c_custkey AS k, c_custkey % 3 AS a, c_custkey % 2 AS b, c_custkey % 5 AS c, c_custkey % 4 AS d, c_custkey % 7 AS e FROM customer)
    SELECT k AS c_custkey, 0 AS position, 'failed_ocr' AS kind, a || CASE WHEN a = 1 THEN ' note' ELSE ' notes' END || ' synced without a transcript' AS message FROM r WHERE a > 0
    UNION ALL SELECT k, 1, 'edited', b || CASE WHEN b = 1 THEN ' note was' ELSE ' notes were' END || ' not updated because of edits' FROM r WHERE b > 0
    UNION ALL SELECT k, 2, 'skipped', c || CASE WHEN c = 1 THEN ' document was' ELSE ' documents were' END || ' skipped' FROM r WHERE c > 0
    UNION ALL SELECT k, 3, 'relaid', d || CASE WHEN d = 1 THEN ' book has' ELSE ' books have' END || ' been laid out again since the notes were written' FROM r WHERE d > 0
    UNION ALL SELECT k, 4, 'shrunk', e || CASE WHEN e = 1 THEN ' note has' ELSE ' notes have' END || ' fewer highlights than before' FROM r WHERE e > 0
    """,
)
def partial_outcomes(spark, sf_dir):
    k = F.col("c_custkey")
    counts = table(spark, sf_dir, "customer").select(k, *((k % n).alias(kind) for (kind, *_), n in zip(U.PARTIAL, (3, 2, 5, 4, 7), strict=True)))
    return U.partial_outcomes(counts, "c_custkey")


@query(
    "page_warnings",
    """
    SELECT o_orderkey AS page_id, 'unplaced' AS kind FROM orders WHERE o_orderkey % 5 = 1 UNION ALL SELECT o_orderkey, 'hidden' FROM orders WHERE o_orderkey % 3 = 0
    """,
)
def page_warnings(spark, sf_dir):
    layer = lambda placement, visible: F.struct(placement.alias("placement"), visible.alias("visible"))
    layers = F.array(layer(F.when(_k() % 5 == 0, "applied").when(_k() % 5 == 1, "lost"), _k() % 3 != 0), layer(F.lit(None).cast("string"), F.lit(None).cast("boolean")))
    return U.render_warnings(table(spark, sf_dir, "orders").select(_k().alias("page_id"), layers.alias("layers")))


@query("page_predicates", "SELECT o_orderkey, o_orderkey % 5 > 1 AND o_orderkey % 2 = 0 AS typed, o_orderkey % 3 = 0 OR o_orderkey % 4 = 1 AS annotated FROM orders")
def page_predicates(spark, sf_dir):
    run = F.struct(F.when(_k() % 5 > 1, "text").otherwise("").alias("text"), (_k() % 2).alias("deleted"))
    runs = F.when(_k() % 5 > 0, F.array(run))
    layers = F.when(_k() % 4 > 0, F.array(F.struct(F.when(_k() % 4 == 1, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("strokes"))))
    highlights = F.when(_k() % 3 == 0, F.array(F.lit("h")))
    return table(spark, sf_dir, "orders").select(_k(), U.has_typed_text(runs).alias("typed"), U.is_annotated(highlights, layers).alias("annotated"))


@query(
    "page_images",
    """
    WITH x AS (SELECT l_orderkey, l_linenumber * 1000000 + l_suppkey AS n, 'i' || l_suppkey % 4 AS image FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber * 1000000 + l_suppkey + 0.5, 'i' || l_suppkey % 3 FROM lineitem), f AS (SELECT l_orderkey, image, min(n) AS n FROM x GROUP BY 1, 2)
    SELECT l_orderkey AS page_id, array_to_string(list(image ORDER BY n, image), ',') AS images FROM f GROUP BY 1
    """,
)
def page_images(spark, sf_dir):
    name = lambda n: F.concat(F.lit("i"), (F.col("l_suppkey") % n).cast("string"))
    layers = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), (F.col("l_linenumber") * 1000000 + F.col("l_suppkey")).alias("ord"), F.array(name(4), name(3)).alias("images"))
    return U.distinct_images(layers).select("page_id", F.array_join("images", ",").alias("images"))


@query(
    "paint_order",
    "SELECT user_id AS page_id, event_id AS ord, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'click' THEN 0 WHEN event_id % 3 = 0 THEN 1 ELSE 2 END, event_id) - 1 AS position FROM events",
)
def paint_order(spark, sf_dir):
    strokes = table(spark, sf_dir, "events").select(F.col("user_id").alias("page_id"), F.col("event_id").alias("ord"), (F.col("event_type") == "click").alias("is_highlight"), (F.col("event_id") % 3 == 0).alias("is_marker"))
    return U.paint_order(strokes).select("page_id", "ord", F.col("position").cast("long").alias("position"))


@query(
    "routing_list",
    """
    WITH d AS (SELECT DISTINCT unnest(string_split(p_type, ' ')) AS tag FROM part), m AS (SELECT DISTINCT string_split(p_type, ' ')[1] AS tag FROM part WHERE p_partkey % 50 = 0)
    SELECT 'mapped' AS kind, tag, 'F/' || tag AS folder, tag < 'M' AS missing FROM m UNION ALL SELECT 'capped', tag, NULL, false FROM d WHERE tag NOT IN (SELECT tag FROM m)
    """,
)
def routing_list(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    discovered = p.select(F.explode(F.split("p_type", " ")).alias("tag"))
    mapping = p.where("p_partkey % 50 = 0").select(F.split("p_type", " ")[0].alias("tag")).distinct().withColumn("folder", F.concat(F.lit("F/"), "tag"))
    return U.routing_list(mapping, discovered, mapping.where("tag >= 'M'").select(F.col("folder").alias("path")), "free")


@query(
    "numbered_headings",
    """
    SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 4 = 0 THEN (o_orderkey % 9 + 1) || '.' || (o_orderkey % 3) || ' ' || 'Title ' || o_orderpriority ELSE 'Title ' || o_orderpriority END AS title FROM orders
    """,
)
def numbered_headings(spark, sf_dir):
    title = F.concat(F.lit("Title "), "o_orderpriority")
    number = F.concat((_k() % 9 + 1).cast("string"), F.lit("."), (_k() % 3).cast("string"))
    o = table(spark, sf_dir, "orders")
    headings = o.select(F.col("o_custkey").alias("doc_id"), _k().alias("page_index"), _k().alias("ord"), title.alias("title"))
    text = F.when(_k() % 4 == 0, F.concat(number, F.lit(" "), title)).when(_k() % 4 == 1, F.concat(number, F.lit(" "), title, F.lit(" and more"))).otherwise(title)
    lines = o.select(F.col("o_custkey").alias("doc_id"), _k().alias("page_index"), F.lit(1).alias("ord"), text.alias("text"))
    return U.numbered_headings(headings, lines).select("ord", "title")


@query(
    "small_expressions",
    """
    SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN (o_orderkey % 100) * 1000 WHEN o_orderkey % 4 = 1 THEN 60000 ELSE 1000 * 2 ** (o_orderkey % 3) END::BIGINT AS delay, strftime(o_orderdate, '%Y-%m-%d') AS day,
           CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN 'a,' || o_orderstatus ELSE o_orderstatus || ',b' END AS names FROM orders
    """,
)
def small_expressions(spark, sf_dir):
    header = F.when(_k() % 4 == 0, (_k() % 100).cast("string")).when(_k() % 4 == 1, "Fri, 01 Mar 2024 00:01:00 GMT").when(_k() % 4 == 2, "soon")
    tags = F.when(_k() % 3 == 1, F.concat(F.lit('["a", "'), "o_orderstatus", F.lit('"]'))).when(_k() % 3 == 2, F.concat(F.lit('[{"name": "'), "o_orderstatus", F.lit('", "timestamp": 1}, {"name": "b"}]')))
    return table(spark, sf_dir, "orders").select(
        _k(), U.retry_delay(header, (_k() % 3 + 1).cast("int"), F.lit(1709251200000)).alias("delay"), U.on_day(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("day"),
        F.array_join(U.tag_names(tags), ",").alias("names"),
    )


@query(
    "entry_tags",
    """
    WITH RECURSIVE e AS (SELECT c_custkey AS id, CASE WHEN c_custkey >= 4 THEN c_custkey // 4 END AS parent, c_custkey % 6 <> 5 AS folder, c_mktsegment AS tag FROM customer),
    up AS (SELECT id, parent AS at, [tag] AS tags, 0 AS depth FROM e UNION ALL SELECT up.id, e.parent, list_append(tags, tag), depth + 1 FROM up JOIN e ON e.id = up.at WHERE e.folder)
    SELECT u.id::VARCHAR AS id, p.tag AS parent_tag, array_to_string(list_sort(list_distinct(arg_max(tags, depth))), ',') AS tags FROM up u JOIN e ON e.id = u.id LEFT JOIN e p ON p.id = e.parent GROUP BY u.id, p.tag
    """,
)
def entry_tags(spark, sf_dir):
    k = F.col("c_custkey")
    parent = F.floor(k / 4).cast("long")
    entries = table(spark, sf_dir, "customer").select(
        k.cast("string").alias("id"), F.when(parent > 0, parent.cast("string")).otherwise("").alias("parent"), F.when(k % 6 == 5, "DocumentType").otherwise("CollectionType").alias("type"), F.array("c_mktsegment").alias("tags")
    )
    tags = U.all_tags(entries).select("id", F.array_join(F.sort_array("tags"), ",").alias("tags"))
    return U.with_parents(entries).select("id", F.col("parent_tags")[0].alias("parent_tag")).join(tags, "id")


@query(
    "source_guard",
    """
    SELECT doc_id::VARCHAR AS doc_id, CASE WHEN length(coalesce(text, '')) = 0 THEN 'the source is empty' ELSE 'the source has no pages' END AS error FROM documents WHERE length(coalesce(text, '')) = 0 OR NOT contains(text, chr(10))
    """,
)
def source_guard(spark, sf_dir):
    """Documents as sources, whose line ends are their pages: those that nothing can be drawn on."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("content"), F.regexp_count("text", F.lit("\n")).alias("n_pages"))
    return U.guarded(d)[1]


@query(
    "source_pages",
    "SELECT l_orderkey AS doc_id, coalesce(array_to_string(list_sort(list(DISTINCT l_linenumber) FILTER (l_returnflag <> 'R')), ','), '') AS source_pages FROM lineitem GROUP BY l_orderkey",
)
def source_pages(spark, sf_dir):
    """Orders as documents whose lines show pages of the source, more than once; returned ones were added on the device."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("source_index"), (F.col("l_returnflag") == "R").alias("appended"))
    return U.source_pages(lines).select("doc_id", F.array_join("source_pages", ",").alias("source_pages"))
