"""Connected components of a table of links, by rounds of joins: each node takes the smallest label among its own and its neighbours',
then the label of that label, until no label changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolake.llm.tables import Scratch


def components(links: DataFrame, left: str = "x", right: str = "y") -> DataFrame:
    """(node, label): the smallest node of each component that has a link. Only counts reach the driver; each round is a table in
    the shared folder, so a lost executor costs no earlier round."""
    scratch, old = Scratch(links.sparkSession), Scratch(links.sparkSession)
    # both ways in one pass, as what makes the links can cost much
    ways = F.inline(F.array(F.struct(F.col(left).alias("node"), F.col(right).alias("to")), F.struct(F.col(right).alias("node"), F.col(left).alias("to"))))
    both = scratch.write(links.where(F.col(left) != F.col(right)).select(ways).distinct(), "links")
    labels = old.write(both.groupBy("node").agg(F.least(F.col("node"), F.min("to")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "to"), "to").groupBy("node").agg(F.min("label").alias("near"))
        least = labels.join(near, "node", "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("next"))
        of = labels.select(F.col("node").alias("next"), F.col("label").alias("jump"))
        new = Scratch(links.sparkSession)
        moved = new.write(least.join(of, "next", "left").select("node", "label", F.least("next", F.coalesce("jump", "next")).alias("next")), "labels")
        changed = moved.where(F.col("next") != F.col("label")).limit(1).count()
        labels = moved.select("node", F.col("next").alias("label"))
        old.clear()
        if not changed:
            scratch.clear()
            return labels
        old = new
