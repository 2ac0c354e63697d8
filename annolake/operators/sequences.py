"""Order-dependent operators that windows can state: islands, merged intervals, sweeps, running gaps, change points. Each shuffles once, by its partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def islands(rows: DataFrame, partition: list[str], index: str, out: str = "run") -> DataFrame:
    """Numbers runs of consecutive integers: in each run, index less rank is one number."""
    return rows.withColumn(out, F.col(index) - F.row_number().over(W.partitionBy(*partition).orderBy(index)))


def collapsed_runs(rows: DataFrame, partition: list[str], index: str, out: str = "pages") -> DataFrame:
    """Runs of three and more as first–last, shorter ones listed, joined by commas."""
    runs = islands(rows, partition, index, "_run").groupBy(*partition, "_run").agg(F.min(index).alias("_a"), F.max(index).alias("_b"))
    text = F.when(F.col("_b") - F.col("_a") >= 2, F.concat_ws("–", F.col("_a").cast("string"), F.col("_b").cast("string"))).otherwise(
        F.array_join(F.transform(F.sequence("_a", "_b"), lambda x: x.cast("string")), ", ")
    )
    listed = F.sort_array(F.collect_list(F.struct(F.col("_a").alias("a"), text.alias("t"))))
    return runs.groupBy(*partition).agg(F.array_join(F.transform(listed, lambda s: s["t"]), ", ").alias(out))


def change_points(rows: DataFrame, partition: list[str], order: list, value: Column, out: str = "changed") -> DataFrame:
    """Whether a value differs from the row before (null-safe); the first row of each partition does."""
    w = W.partitionBy(*partition).orderBy(*order)
    return rows.withColumn(out, (F.row_number().over(w) == 1) | ~value.eqNullSafe(F.lag(value).over(w)))


def merged_intervals(rows: DataFrame, partition: list[str], start: str, end: str, order: list | None = None) -> DataFrame:
    """Overlapping or touching intervals as one: (partition, start, end, n)."""
    w = W.partitionBy(*partition).orderBy(start, end, *(order or []))
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(F.col(start) <= reach, 0).otherwise(1))
    grouped = marked.withColumn("_group", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return grouped.groupBy(*partition, "_group").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_group")


def running_gaps(rows: DataFrame, partition: list[str], start: str, end: str, order: list | None = None) -> DataFrame:
    """Stretches that no earlier interval reaches: (partition, gap_start, gap_end)."""
    w = W.partitionBy(*partition).orderBy(start, end, *(order or [])).rowsBetween(W.unboundedPreceding, -1)
    reached = rows.withColumn("gap_start", F.max(end).over(w))
    return reached.where(F.col(start) > F.col("gap_start")).select(*partition, "gap_start", F.col(start).alias("gap_end"))


def sweep(rows: DataFrame, partition: list[str], start: str, end: str) -> DataFrame:
    """Segments between consecutive edges with the number of intervals over them: (partition, seg_start, seg_end, depth), depth over 0."""
    edges = rows.select(*partition, F.explode(F.array(F.struct(F.col(start).alias("x"), F.lit(1).alias("d")), F.struct(F.col(end).alias("x"), F.lit(-1).alias("d")))).alias("e"))
    steps = edges.groupBy(*partition, F.col("e.x").alias("x")).agg(F.sum("e.d").alias("d"))
    w = W.partitionBy(*partition).orderBy("x")
    deep = steps.withColumn("depth", F.sum("d").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("seg_end", F.lead("x").over(w))
    return deep.where((F.col("depth") > 0) & F.col("seg_end").isNotNull()).select(*partition, F.col("x").alias("seg_start"), "seg_end", "depth")


def peak_bands(segments: DataFrame, partition: list[str], least: int) -> DataFrame:
    """Of each cluster of touching segments the widest run at its greatest depth (the first of equal ones), if that is at least ``least``."""
    w = W.partitionBy(*partition).orderBy("seg_start")
    broken = F.coalesce((F.lag("seg_end").over(w) < F.col("seg_start")).cast("int"), F.lit(1))
    clustered = segments.withColumn("_b", broken).withColumn("_c", F.sum("_b").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    inside = W.partitionBy(*partition, "_c")
    top = clustered.withColumn("peak", F.max("depth").over(inside)).where(F.col("peak") >= least)
    v = inside.orderBy("seg_start")
    run = top.withColumn("_r", F.sum(F.when(F.col("depth") == F.col("peak"), 0).otherwise(1)).over(v.rowsBetween(W.unboundedPreceding, W.currentRow))).where(F.col("depth") == F.col("peak"))
    runs = run.groupBy(*partition, "_c", "_r").agg(F.min("seg_start").alias("start"), F.max("seg_end").alias("end"), F.first("peak").alias("peak"))
    best = F.min_by(F.struct("start", "end", "peak"), F.struct((F.col("start") - F.col("end")).alias("w"), F.col("start")))
    return runs.groupBy(*partition, "_c").agg(best.alias("_s")).select(*partition, F.col("_s.start").alias("start"), F.col("_s.end").alias("end"), F.col("_s.peak").alias("peak"))


def rolling_median(rows: DataFrame, partition: list[str], order: list, value: str, n: int = 10, out: str = "median") -> DataFrame:
    """Rounded median of the last n values (n even), null before there are n: percentiles take no frame, a sorted frame does."""
    frame = F.sort_array(F.collect_list(value).over(W.partitionBy(*partition).orderBy(*order).rowsBetween(-(n - 1), 0)))
    middle = (F.element_at(frame, n // 2) + F.element_at(frame, n // 2 + 1)) / 2
    return rows.withColumn(out, F.when(F.size(frame) == n, F.floor(middle + 0.5).cast("long")))


def section_rank(rows: DataFrame, partition: list[str], section: str, top: str, order: list[str], out: str = "rank") -> DataFrame:
    """Order of sections by their first entry, of entries by place inside a section."""
    first = F.min(F.struct(top, *order)).over(W.partitionBy(*partition, section))
    keyed = rows.withColumn("_first", first)
    return keyed.withColumn(out, F.row_number().over(W.partitionBy(*partition).orderBy("_first", top, *order))).drop("_first")


def last_values(rows: DataFrame, partition: list[str], order: list, value: str, n: int = 10, out: str = "last") -> DataFrame:
    """The latest n positive finite values up to each row, oldest first."""
    good = F.when((F.col(value) > 0) & ~F.isnan(value) & (F.col(value) != float("inf")), F.col(value))
    kept = F.collect_list(good).over(W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn(out, F.slice(kept, F.greatest(F.size(kept) - n + 1, F.lit(1)), n))


def chunks(rows: DataFrame, partition: list[str], order: list, size: int, out: str = "chunk") -> DataFrame:
    return rows.withColumn(out, F.floor((F.row_number().over(W.partitionBy(*partition).orderBy(*order)) - 1) / size).cast("int"))
