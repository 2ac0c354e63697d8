"""Progress of a run: how many of the steps that were counted before are done. It only grows, and a unit contributes exactly its steps, whether its pages report or not."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def progress(events: DataFrame, run: str = "run") -> DataFrame:
    """(run, ord, done, total, unit_done, unit_total) of events (run, ord, kind start | step | page | finish, steps), one unit after another: what is shown after each. A page beyond its unit's steps shows nothing, and a run
    without steps nothing at all."""
    # every value is a running one of the run, or such a one since the unit's start: all windows have one order, so a task sorts its rows once
    ordered = W.partitionBy(run).orderBy("ord")
    w = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
    is_ = lambda kind: F.col("kind") == kind
    rows = events.withColumn("_p", F.count(F.when(is_("page"), 1)).over(w)).withColumn("_f", F.count(F.when(is_("finish"), 1)).over(w))
    began = F.last(F.when(is_("start"), F.struct("steps", "_p", "_f")), ignorenulls=True).over(w)
    rows = rows.withColumn("_began", began).withColumn("unit_total", F.coalesce("_began.steps", F.lit(0)))
    zero = F.lit(0).cast("long")
    rows = rows.withColumn("_pages", F.col("_p") - F.coalesce("_began._p", zero)).withColumn("_over", F.col("_f") > F.coalesce("_began._f", zero))
    rows = rows.withColumn("unit_done", F.when(F.col("_over"), F.col("unit_total")).otherwise(F.least("_pages", "unit_total")).cast("long"))
    before = F.when(is_("start"), zero).otherwise(F.coalesce(F.lag("unit_done").over(ordered), zero))
    rows = rows.withColumn("done", F.sum(F.col("unit_done") - before).over(w)).withColumn("total", F.sum(F.when(is_("start"), F.col("steps")).otherwise(0)).over(W.partitionBy(run)))
    shown = (F.col("total") > 0) & (~is_("page") | (F.col("_pages") <= F.col("unit_total")))
    return rows.where(shown).select(run, "ord", "done", "total", "unit_done", "unit_total")


class Ticker:
    """Counts steps as jobs do them. A job's rows tell by an observation how many steps they were: what an attempt that failed had counted is not in it, so a repeated task counts once."""

    def __init__(self, total: int, report: Callable[[int, int], None]):
        self.total, self.report, self.done, self.open = total, report, 0, []

    def watched(self, rows: DataFrame, steps: Column) -> DataFrame:
        """The rows, of which each is so many steps once it has been computed."""
        seen = Observation(f"progress-{uuid.uuid4().hex}")
        self.open.append(seen)
        return rows.observe(seen, F.coalesce(F.sum(steps), F.lit(0)).alias("done"))

    def finish(self, steps: int) -> None:
        """The jobs of a unit are over: what they told counts, and what they did not is credited, up to the unit's steps and no further."""
        told = sum(seen.get["done"] for seen in self.open)
        self.open.clear()
        for done in dict.fromkeys((min(told, steps), steps)):
            if self.total > 0:
                self.report(self.done + done, self.total)
        self.done += steps
