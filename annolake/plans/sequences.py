"""Queries on ordered rows: runs, intervals, sweeps, medians, modes."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annolake.operators import sequences as S
from annolake.plans.catalogue import query, table


def _intervals(spark, sf_dir):
    """Events as intervals of minutes: [minute, minute + value / 10]."""
    e = table(spark, sf_dir, "events")
    a = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000).cast("long")
    return e.select("event_id", "user_id", a.alias("a"), (a + F.floor(F.abs("value")).cast("long") * 30 + 1).alias("b"))


_IV = "iv AS (SELECT event_id, user_id, epoch_us(ts) // 60000000 AS a, epoch_us(ts) // 60000000 + floor(abs(value))::BIGINT * 30 + 1 AS b FROM events)"


@query(
    "run_collapse",
    """
    WITH k AS (SELECT DISTINCT o_custkey, o_orderkey // 8 AS page FROM orders),
    r AS (SELECT o_custkey, page, page - row_number() OVER (PARTITION BY o_custkey ORDER BY page) AS g FROM k),
    m AS (SELECT o_custkey, g, CASE WHEN count(*) >= 3 THEN min(page)::VARCHAR || '–' || max(page)::VARCHAR ELSE string_agg(page::VARCHAR, ', ' ORDER BY page) END AS part FROM r GROUP BY o_custkey, g)
    SELECT o_custkey, string_agg(part, ', ' ORDER BY g) AS pages FROM m GROUP BY o_custkey
    """,
)
def run_collapse(spark, sf_dir):
    pages = table(spark, sf_dir, "orders").select("o_custkey", F.floor(F.col("o_orderkey") / 8).cast("long").alias("page")).distinct()
    return S.collapsed_runs(pages, ["o_custkey"], "page")


@query(
    "change_point",
    "SELECT event_id, row_number() OVER w = 1 OR event_type IS DISTINCT FROM lag(event_type) OVER w AS changed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
)
def change_point(spark, sf_dir):
    return S.change_points(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type")).select("event_id", "changed")


@query(
    "interval_merge",
    f"""
    WITH {_IV}, m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY user_id ORDER BY a, b, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM iv),
    g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY a, b, event_id ROWS UNBOUNDED PRECEDING) AS k FROM m)
    SELECT user_id, min(a) AS a, max(b) AS b, count(*) AS n FROM g GROUP BY user_id, k
    """,
)
def interval_merge(spark, sf_dir):
    return S.merged_intervals(_intervals(spark, sf_dir), ["user_id"], "a", "b", ["event_id"])


@query(
    "running_max_gaps",
    f"""
    WITH {_IV}, m AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap_start FROM iv)
    SELECT user_id, gap_start, a AS gap_end FROM m WHERE a > gap_start
    """,
)
def running_max_gaps(spark, sf_dir):
    return S.running_gaps(_intervals(spark, sf_dir), ["user_id"], "a", "b", ["event_id"])


@query(
    "sweep_bands",
    f"""
    WITH {_IV}, e AS (SELECT user_id, a AS x, 1 AS d FROM iv UNION ALL SELECT user_id, b, -1 FROM iv), s AS (SELECT user_id, x, sum(d) AS d FROM e GROUP BY user_id, x),
    t AS (SELECT user_id, x AS seg_start, lead(x) OVER (PARTITION BY user_id ORDER BY x) AS seg_end, (sum(d) OVER (PARTITION BY user_id ORDER BY x))::BIGINT AS depth FROM s)
    SELECT * FROM t WHERE depth > 0 AND seg_end IS NOT NULL
    """,
)
def sweep_bands(spark, sf_dir):
    return S.sweep(_intervals(spark, sf_dir), ["user_id"], "a", "b")


@query("peak_bands")
def peak_bands(spark, sf_dir):
    """The widest deepest stretch of each cluster of intervals; checked against a loop in the tests."""
    return S.peak_bands(S.sweep(_intervals(spark, sf_dir), ["user_id"], "a", "b"), ["user_id"], 2)


@query(
    "rolling_median10",
    """
    WITH l AS (SELECT event_id, list_sort(list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) AS v FROM events)
    SELECT event_id, CASE WHEN len(v) = 10 THEN floor((v[5] + v[6]) / 2 + 0.5)::BIGINT END AS median FROM l
    """,
)
def rolling_median10(spark, sf_dir):
    return S.rolling_median(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "median")


@query(
    "line_spacing_p25",
    """
    WITH g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
    SELECT user_id, quantile_disc(gap, 0.25) AS spacing FROM g WHERE gap > 0 GROUP BY user_id
    """,
)
def line_spacing_p25(spark, sf_dir):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    gaps = table(spark, sf_dir, "events").select("user_id", (us - F.lag(us).over(W.partitionBy("user_id").orderBy("ts", "event_id"))).alias("gap")).where("gap > 0")
    return gaps.groupBy("user_id").agg(F.expr("cast(percentile_disc(0.25) WITHIN GROUP (ORDER BY gap) AS bigint)").alias("spacing"))


@query(
    "modal_bucket",
    """
    WITH c AS (SELECT l_suppkey, floor(l_quantity * 2 + 0.5) / 2 AS h, count(*) AS n FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, h) AS k FROM c)
    SELECT l_suppkey, h AS modal FROM r WHERE k = 1
    """,
)
def modal_bucket(spark, sf_dir):
    h = F.floor(F.col("l_quantity") * 2 + 0.5) / 2
    counts = table(spark, sf_dir, "lineitem").where("l_quantity > 0").groupBy("l_suppkey", h.cast("double").alias("h")).agg(F.count("*").alias("n"))
    return counts.groupBy("l_suppkey").agg(F.min_by("h", F.struct((-F.col("n")).alias("n"), "h")).alias("modal"))


@query(
    "highlight_groups",
    "SELECT user_id, count(*) AS n, md5(string_agg(event_type, '|' ORDER BY value, event_id)) AS quotes_md5 FROM events WHERE event_type <> 'view' GROUP BY user_id",
)
def highlight_groups(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type <> 'view'")
    listed = F.sort_array(F.collect_list(F.struct("value", "event_id", "event_type")))
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(listed, lambda s: s["event_type"]), "|")).alias("quotes_md5"))


@query(
    "section_rank",
    """
    WITH f AS (SELECT *, min(value) OVER (PARTITION BY user_id, event_type) AS top, first_value(event_id) OVER (PARTITION BY user_id, event_type ORDER BY value, event_id) AS lead_id FROM events)
    SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY top, lead_id, value, event_id) AS rank FROM f
    """,
)
def section_rank(spark, sf_dir):
    ranked = S.section_rank(table(spark, sf_dir, "events"), ["user_id"], "event_type", "value", ["event_id"])
    return ranked.select("event_id", F.col("rank").cast("long").alias("rank"))


@query("last_durations", "SELECT event_id, len(l) AS n, list_sum(l) AS total FROM (SELECT event_id, list_slice(v, greatest(len(v) - 9, 1), len(v)) AS l FROM (SELECT event_id, list_filter(list(CASE WHEN value > 60 THEN value END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), lambda x: x IS NOT NULL) AS v FROM events)) WHERE len(l) > 0")
def last_durations(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("v", F.when(F.col("value") > 60, F.col("value")))
    kept = S.last_values(e, ["user_id"], ["ts", "event_id"], "v").where(F.size("last") > 0)
    return kept.select("event_id", F.size("last").cast("long").alias("n"), F.aggregate("last", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("page_chunks", "SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 5 AS chunk, turn FROM conversations")
def page_chunks(spark, sf_dir):
    done = S.chunks(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], 5)
    return done.select("conv_id", F.col("chunk").cast("long").alias("chunk"), "turn")
