"""Queries on headings and the entries under them."""

from __future__ import annotations

from pyspark.sql import functions as F

from annolake.operators.sections import carry_forward
from annolake.plans.catalogue import query, table


@query(
    "heading_asof",
    """
    WITH h AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'signup'),
    c AS (
      SELECT e.user_id, e.event_id, e.value,
             last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (
               PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading_id
      FROM events e)
    SELECT user_id, heading_id, count(*) AS n_entries, min(event_id) AS first_entry, max(event_id) AS last_entry
    FROM c GROUP BY user_id, heading_id
    """,
)
def heading_asof(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    placed = carry_forward(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_id"), "heading_id")
    return placed.groupBy("user_id", "heading_id").agg(F.count("*").alias("n_entries"), F.min("event_id").alias("first_entry"), F.max("event_id").alias("last_entry"))
