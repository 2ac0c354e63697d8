"""Incremental runs over a stream of units: each micro-batch is planned against the state, written out, and only then made the state.

The state is a `ledger.Ledger`, so a batch touches only the buckets of its keys. Batches are numbered, and a batch that is already the state is not applied twice; a run with another number of buckets than the state
has is refused."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from annolake.operators.incremental import RENDER_VERSION, next_state, planned
from annolake.streaming.ledger import BUCKETS, Ledger

STATE = "sync_key string, doc_id string, tag string, folder string, page_hash long, status string, render_version int, n_items long"


def state(spark: SparkSession, path: str) -> DataFrame:
    """The latest committed state, empty before the first."""
    ledger = Ledger(spark, path, STATE, "sync_key", None)
    return ledger.read(ledger.latest())


def plan_of(batch: DataFrame, old: DataFrame, render_version: int = RENDER_VERSION) -> DataFrame:
    """What a batch asks for, of `incremental.planned`: the last unit of a key counts; one that is ``gone`` orphans its row."""
    latest = W.partitionBy("sync_key").orderBy(F.col("ord").desc())
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in batch.columns else F.lit(False)
    units = batch.withColumn("_gone", gone).withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")
    known = old.join(units.select("sync_key"), "sync_key", "left_semi")
    return planned(units.where("NOT _gone").drop("_gone"), known, render_version)


def sync_stream(units: DataFrame, path: str, checkpoint: str, write: Callable[[DataFrame, int], None] | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Runs over all that is there and stops. ``write`` gets each batch's plan before its state is committed."""
    def apply(batch: DataFrame, number: int) -> None:
        ledger = Ledger(batch.sparkSession, path, STATE, "sync_key", buckets)
        before = ledger.latest()
        if before.number >= number:
            return
        touched = [r[0] for r in batch.select(ledger.bucket().cast("int").alias("b")).distinct().collect()]  # at most ``buckets``
        old = ledger.read(before, touched)
        plan = plan_of(batch, old)
        if write is not None:
            write(plan, number)
        new = next_state(plan)
        whole = old.join(plan.select("sync_key"), "sync_key", "left_anti").select(*new.columns).unionByName(new)
        ledger.commit(number, before, whole, touched, {})

    return units.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
