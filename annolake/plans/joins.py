"""Queries on joins, sets, graphs and incremental runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from annolake.operators import incremental as I
from annolake.operators import nearest as N
from annolake.operators import routing as R
from annolake.plans.catalogue import query, shifted, table

_FOLDERS = {"AUTOMOBILE": "Cars", "BUILDING": "Sites/2024", "MACHINERY": "Tools"}


def _mapping(spark):
    return spark.createDataFrame(sorted(_FOLDERS.items()), "tag string, folder string")


@query("routing_join", "SELECT c_custkey, c_mktsegment AS tag, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Cars' WHEN 'BUILDING' THEN 'Sites/2024' WHEN 'MACHINERY' THEN 'Tools' END AS folder FROM customer")
def routing_join(spark, sf_dir):
    return R.routed(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("tag")), _mapping(spark)).select("c_custkey", "tag", "folder")


@query("mapped_tags", "SELECT DISTINCT c_nationkey, c_mktsegment AS tag FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY')")
def mapped_tags(spark, sf_dir):
    return R.mapped(table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_mktsegment").alias("tag")), _mapping(spark)).select("c_nationkey", "tag")


@query(
    "tag_diff_rename",
    """
    WITH s AS (SELECT o_custkey, coalesce(list_sort(list(DISTINCT o_orderpriority) FILTER (WHERE o_orderkey % 2 = 0)), []) AS old, coalesce(list_sort(list(DISTINCT o_orderpriority) FILTER (WHERE o_orderkey % 2 = 1)), []) AS now FROM orders GROUP BY o_custkey),
    d AS (SELECT o_custkey, list_sort(list_filter(old, lambda x: NOT list_contains(now, x))) AS gone, list_sort(list_filter(now, lambda x: NOT list_contains(old, x))) AS new FROM s)
    SELECT o_custkey, CASE WHEN len(gone) = 1 AND len(new) = 1 THEN 'rename' WHEN len(gone) + len(new) = 0 THEN 'same' ELSE 'diff' END AS action,
           CASE WHEN len(gone) = 1 AND len(new) = 1 THEN gone[1] END AS old_tag, CASE WHEN len(gone) = 1 AND len(new) = 1 THEN new[1] END AS new_tag,
           CASE WHEN len(gone) = 1 AND len(new) = 1 THEN '' ELSE array_to_string(gone, ',') END AS orphaned FROM d
    """,
)
def tag_diff_rename(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    sets = o.groupBy("o_custkey").agg(*(F.sort_array(F.collect_set(F.when(F.col("o_orderkey") % 2 == k, F.col("o_orderpriority")))).alias(n) for k, n in ((0, "old"), (1, "now"))))
    c = sets.select("o_custkey", R.tag_changes(F.col("old"), F.col("now")).alias("c"))
    return c.select("o_custkey", "c.action", F.col("c.old").alias("old_tag"), F.col("c.new").alias("new_tag"), F.array_join("c.orphaned", ",").alias("orphaned"))


@query(
    "folder_inheritance",
    """
    WITH RECURSIVE up AS (
      SELECT o_orderkey AS id, o_orderkey // 2 AS at, 0 AS depth, CAST([] AS VARCHAR[]) AS tags FROM orders
      UNION ALL
      SELECT up.id, o.o_orderkey // 2, depth + 1, CASE WHEN o_orderkey % 3 = 0 THEN list_append(tags, o_orderpriority) ELSE tags END FROM up JOIN orders o ON o.o_orderkey = up.at WHERE up.at > 0 AND o.o_orderkey % 7 <> 0)
    SELECT id, len(l) AS n_tags, array_to_string(list_sort(l), ',') AS tags FROM (SELECT id, list_distinct(arg_max(tags, depth)) AS l FROM up GROUP BY id)
    """,
)
def folder_inheritance(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    parent = F.floor(F.col("o_orderkey") / 2).cast("long")
    tags = F.when(F.col("o_orderkey") % 3 == 0, F.array("o_orderpriority")).otherwise(F.array().cast("array<string>"))
    kind = F.when(F.col("o_orderkey") % 7 == 0, "DocumentType").otherwise("CollectionType")
    entries = o.select(F.col("o_orderkey").cast("string").alias("id"), F.when(parent > 0, parent.cast("string")).otherwise("").alias("parent"), kind.alias("type"), tags.alias("tags"))
    done = R.inherited_tags(entries)
    return done.select(F.col("id").cast("long").alias("id"), F.size("tags").cast("long").alias("n_tags"), F.array_join(F.sort_array("tags"), ",").alias("tags"))


@query("tag_discovery", "SELECT DISTINCT unnest(string_split(p_type, ' ')) AS tag FROM part")
def tag_discovery(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.explode(F.split("p_type", " ")).alias("tag")).distinct()


def _units(spark, sf_dir, later: bool):
    """Orders as units of a run; in the later run every seventh is gone, every fifth changed and every eleventh in another folder."""
    o = table(spark, sf_dir, "orders")
    if later:
        o = o.where("o_orderkey % 7 <> 0")
    else:
        o = o.where("o_orderkey % 13 <> 0")
    text = F.concat_ws("|", "o_orderstatus", "o_orderpriority", F.when((F.col("o_orderkey") % 5 == 0) & F.lit(later), "changed").otherwise(""))
    folder = F.when((F.col("o_orderkey") % 11 == 0) & F.lit(later), "moved").otherwise(F.col("o_orderstatus"))
    n = (F.col("o_orderkey") % 4 + F.when(F.lit(later), F.col("o_orderkey") % 3).otherwise(F.lit(1))).cast("long")
    return o.select(
        F.col("o_orderkey").cast("string").alias("sync_key"), F.col("o_custkey").cast("string").alias("doc_id"), F.col("o_orderpriority").alias("tag"), folder.alias("folder"), F.crc32(text).alias("page_hash"), n.alias("n_items")
    )


_PLAN = """
    WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS folder, o_orderkey % 4 + 1 AS n, CASE WHEN o_orderkey % 17 = 0 THEN 29 ELSE 30 END AS version FROM orders WHERE o_orderkey % 13 <> 0),
    b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'moved' ELSE o_orderstatus END AS folder, o_orderkey % 4 + o_orderkey % 3 AS n, o_orderkey % 5 = 0 AS changed FROM orders WHERE o_orderkey % 7 <> 0),
    p AS (SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'orphan' WHEN a.k IS NULL THEN 'write' WHEN a.folder <> b.folder THEN 'move' WHEN changed OR version < 30 THEN 'rewrite' ELSE 'skip' END AS action,
                 coalesce(a.k IS NOT NULL AND b.n < a.n, false) AS shrunk FROM a FULL JOIN b ON a.k = b.k)
"""


@query("incremental_plan", _PLAN + "SELECT k::VARCHAR AS sync_key, action, shrunk FROM p")
def incremental_plan(spark, sf_dir):
    return I.planned(_units(spark, sf_dir, True), _state(spark, sf_dir)).select("sync_key", "action", "shrunk")


def _state(spark, sf_dir):
    version = F.when(F.col("sync_key").cast("long") % 17 == 0, 29).otherwise(30)
    return _units(spark, sf_dir, False).withColumn("status", F.lit("active")).withColumn("render_version", version)


@query("next_state", _PLAN + "SELECT CASE WHEN action = 'orphan' THEN 'orphaned' ELSE 'active' END AS status, count(*) AS n FROM p GROUP BY 1")
def next_state(spark, sf_dir):
    return I.next_state(I.planned(_units(spark, sf_dir, True), _state(spark, sf_dir))).groupBy("status").agg(F.count("*").alias("n"))


@query("orphan_scan", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_scan(spark, sf_dir):
    state = table(spark, sf_dir, "documents").select("doc_id", F.lit("active").alias("status"))
    return I.vanished(state, table(spark, sf_dir, "labels")).select("doc_id")


@query(
    "status_precedence",
    """
    SELECT o_custkey, CASE WHEN bool_or(s = 'unavailable') THEN 'unavailable' WHEN bool_or(s = 'failed') THEN 'failed' WHEN bool_or(s = 'ok') THEN 'ok' ELSE 'skipped' END AS worst,
           CASE WHEN bool_or(s = 'ok') THEN 'ok' WHEN bool_or(s = 'failed') THEN 'failed' ELSE 'skipped' END AS unit
    FROM (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'ok' WHEN 'P' THEN 'unavailable' ELSE 'skipped' END AS s FROM orders) GROUP BY o_custkey
    """,
)
def status_precedence(spark, sf_dir):
    s = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "ok").when(F.col("o_orderstatus") == "P", "unavailable").otherwise("skipped")
    return table(spark, sf_dir, "orders").select("o_custkey", s.alias("s")).groupBy("o_custkey").agg(I.worst_status(F.col("s")).alias("worst"), I.unit_status(F.col("s")).alias("unit"))


@query(
    "entitlement",
    """
    WITH c AS (SELECT c_custkey AS k, c_custkey % 50 AS v, c_custkey % 30 AS t, 1709251200000 AS now FROM customer),
    s AS (SELECT *, k % 5 <> 1 AS has_key, k % 10 = 0 AS revoked, k % 3 = 0 AND k % 33 <> 0 AS validated, k % 4 = 0 AS trial, now + (14 - t) * 86400000 AS ends FROM c)
    SELECT k AS c_custkey, CASE WHEN revoked THEN 'free' WHEN has_key AND validated THEN 'pro' WHEN trial AND now < ends THEN 'trial' ELSE 'free' END AS tier,
           CASE WHEN revoked THEN 'revoked' WHEN has_key AND validated THEN NULL WHEN trial AND now < ends THEN NULL WHEN trial THEN 'trial-ended' WHEN has_key THEN 'not-activated' ELSE 'never-bought' END AS reason,
           CASE WHEN NOT revoked AND has_key AND validated THEN v > 30 END AS stale, CASE WHEN NOT revoked AND NOT (has_key AND validated) AND trial AND now < ends THEN ends END AS ends_at,
           CASE WHEN NOT has_key OR revoked THEN 'none' WHEN k % 7 = 0 THEN 'activate' WHEN NOT validated OR v >= 7 THEN 'validate' ELSE 'none' END AS call FROM s
    """,
)
def entitlement(spark, sf_dir):
    state, now = _licences(F.col("c_custkey")), F.lit(1709251200000)
    told = table(spark, sf_dir, "customer").select("c_custkey", I.entitlement(state, now).alias("e"), I.next_call(state, now).alias("call"))
    return told.select("c_custkey", "e.tier", "e.reason", "e.stale", "e.ends_at", "call")


def _licences(k):
    """Licences in all states: some without a key, revoked, with a time that can't be read, on trial."""
    days = lambda n: F.concat(F.date_sub(F.to_date(F.lit("2024-03-01")), n.cast("int")).cast("string"), F.lit("T00:00:00Z"))
    return F.struct(
        F.when(k % 5 != 1, "key").alias("key"), F.when(k % 7 != 0, "activation").alias("activation_id"), F.when(k % 33 == 0, "never").when(k % 3 == 0, days(k % 50)).alias("validated_at"),
        F.when(k % 10 == 0, "2024-01-01T00:00:00Z").alias("revoked_at"), F.when(k % 4 == 0, days(k % 30)).alias("trial_started_at"), (k % 2 == 0).alias("ended_notice_shown"),
    )


@query(
    "licence_fold",
    """
    WITH o AS (SELECT c_custkey AS k, c_custkey % 6 AS n, 'now' AS now FROM customer)
    SELECT k AS c_custkey, CASE WHEN n <> 3 THEN CASE WHEN k % 7 <> 0 THEN 'activation' END END AS activation_id,
           CASE WHEN n = 0 THEN now WHEN k % 33 = 0 THEN 'never' WHEN k % 3 = 0 THEN strftime(DATE '2024-03-01' - (k % 50)::INT, '%Y-%m-%d') || 'T00:00:00Z' END AS validated_at,
           CASE WHEN n IN (1, 2) THEN now WHEN n = 0 THEN NULL WHEN k % 10 = 0 THEN '2024-01-01T00:00:00Z' END AS revoked_at, CASE WHEN n = 0 THEN false ELSE k % 2 = 0 END AS shown FROM o
    """,
)
def licence_fold(spark, sf_dir):
    k = F.col("c_custkey")
    outcome = F.element_at(F.array(*map(F.lit, ("valid", "unknown-key", "withdrawn", "unknown-activation", "activation-limit", "unreachable"))), (k % 6 + 1).cast("int"))
    after = table(spark, sf_dir, "customer").select("c_custkey", I.licence_after(_licences(k), outcome, F.lit("now")).alias("s"))
    return after.select("c_custkey", "s.activation_id", "s.validated_at", "s.revoked_at", F.col("s.ended_notice_shown").alias("shown"))


def _boxes(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *((F.floor(shifted(i) * 1000)).cast("long").alias(n) for i, n in enumerate(("x", "y"))), (F.col("vec_id") % 2).alias("side"))


@query(
    "nearest_anchor",
    """
    WITH b AS (SELECT vec_id, label, floor((embedding[1] + 1)::DOUBLE * 1000)::BIGINT AS x, floor((embedding[2] + 1)::DOUBLE * 1000)::BIGINT AS y, vec_id % 2 AS side FROM embeddings),
    d AS (SELECT l.vec_id, r.vec_id AS r_id, abs(l.x - r.x) AS dx, abs(l.x - r.x) + abs(l.y - r.y) AS d FROM b l JOIN b r ON l.label = r.label AND l.side = 1 AND r.side = 0),
    t AS (SELECT vec_id, arg_min(r_id, row(dx, r_id)) FILTER (WHERE dx <= 3) AS near, arg_min(r_id, row(d, r_id)) FILTER (WHERE d <= 60) AS middle, arg_min(r_id, row(d, r_id)) AS far FROM d GROUP BY vec_id)
    SELECT b.vec_id, coalesce(near, middle, far) AS anchor, CASE WHEN near IS NOT NULL THEN 'heading' WHEN middle IS NOT NULL THEN 'highlight' WHEN far IS NOT NULL THEN 'line' ELSE 'page' END AS kind
    FROM b LEFT JOIN t USING (vec_id) WHERE side = 1
    """,
)
def nearest_anchor(spark, sf_dir):
    """A line beside the note, else the nearest one. The highlight is the nearest line where that is near enough, so one search serves both tiers, and only for notes without a heading."""
    b = _boxes(spark, sf_dir)
    notes = b.where("side = 1").select("vec_id", "label", "x", "y")
    lines = b.where("side = 0").select("label", F.col("vec_id").alias("r_id"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    beside = N.nearest_step(notes, lines, ["label"], "x", "rx", "r_id", 3, "heading")
    found = N.nearest_in_plane(beside.where("heading IS NULL"), lines, ["label"], ["vec_id"], ("x", "y"), ("rx", "ry"), "r_id")
    # where no distance is known the SQL takes the label's first line
    first = lines.groupBy("label").agg(F.min("r_id").alias("first"))
    tiers = beside.join(found, "vec_id", "left").join(first, "label", "left")
    anchor = F.coalesce("heading", "value", "first")
    kind = F.when(F.col("heading").isNotNull(), "heading").when(F.col("away") <= 60, "highlight").when(anchor.isNotNull(), "line").otherwise("page")
    return tiers.select("vec_id", anchor.alias("anchor"), kind.alias("kind"))


@query(
    "interval_match",
    """
    SELECT l_orderkey, l_linenumber, arg_min(o_orderkey, row(abs(epoch_us(l_shipdate) - epoch_us(o_orderdate)), o_orderkey)) AS matched
    FROM lineitem JOIN orders ON o_orderstatus = l_linestatus AND l_suppkey % 50 = o_custkey % 50 AND l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 10 DAY GROUP BY 1, 2
    """,
)
def interval_match(spark, sf_dir):
    day = 86_400_000_000
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linestatus").alias("k"), (F.col("l_suppkey") % 50).alias("m"), us("l_shipdate").alias("at"))
    spans = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("k"), (F.col("o_custkey") % 50).alias("m"), us("o_orderdate").alias("a")).where("k IS NOT NULL AND m IS NOT NULL AND a IS NOT NULL")
    # all spans are of one length, so the nearest start is the latest one
    found = N.latest_start(lines.where("k IS NOT NULL AND m IS NOT NULL"), spans, ["k", "m"], "at", "a", "o_orderkey", 10 * day)
    return found.groupBy("l_orderkey", "l_linenumber").agg(F.min_by("o_orderkey", F.struct(F.abs(F.col("at") - F.col("a")), "o_orderkey")).alias("matched"))


@query(
    "uncovered",
    "SELECT e.event_id FROM events e WHERE e.event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events f WHERE f.user_id = e.user_id AND f.event_type = 'view' AND abs(f.value - e.value) < 20)",
)
def uncovered(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a = e.where("event_type = 'click'").select("event_id", "user_id", "value")
    b = e.where("event_type = 'view'").select(F.col("user_id").alias("user_id"), F.col("value").alias("v"))
    return N.uncovered(a, b, ["user_id"], F.abs(F.col("value") - F.col("v")) < 20).select("event_id")
