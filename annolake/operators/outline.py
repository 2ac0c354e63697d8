"""Positions in an outline by taking leaves off and list ranking, so a tree of any depth takes at most as many joins as its number of nodes has binary digits, and a bushy one few."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annolake.operators.shared import Rounds

#: Leaves are taken off until so small a share of the nodes is left: a walk passes on what it goes around as often as its length has binary digits.
CORE = 1 / 64


def preorder(nodes: DataFrame) -> DataFrame:
    """(id, depth, position) of (id, up, ord): roots (``up`` null) and children in their order, each node before those below it, positions from 1. What hangs on no root is left out.

    While at least half of the nodes are leaves, all leaves go at once; each remembers how far it stands behind the sibling that stays before it, or behind its parent. What stays learns how many went before it and at its
    end, and is walked around. Then the leaves come back, the last ones first. So the rounds on leaves pass on no more than twice the nodes in all, and only what is no bushy tree is walked around as a whole."""
    rounds, out = Rounds(nodes.sparkSession, "outline"), Rounds(nodes.sparkSession, "outline-order")
    zero, root = F.lit(0).cast("long"), F.col("up").isNull()
    siblings = W.partitionBy("up", F.when(root, F.col("id"))).orderBy("ord", "id")  # a root, which stays in any case, by itself
    so_far = siblings.rowsBetween(W.unboundedPreceding, W.currentRow)
    # before, inner: how many nodes went that stood between a node and the one that stays before it, and at the end of those below it
    left = rounds.write(nodes.select("id", "up", "ord", zero.alias("before"), zero.alias("inner")))
    below = left.where(~root).groupBy(F.col("up").alias("id")).agg(F.lit(True).alias("_has"), zero.alias("_end"))
    taken, most = [], None
    while True:
        known = left.join(below, "id", "left").withColumn("inner", F.col("inner") + F.coalesce("_end", zero)).withColumn("leaf", ~root & ~F.coalesce("_has", F.lit(False)))
        known = known.withColumn("size", F.when(F.col("leaf"), F.col("before") + 1 + F.col("inner")).otherwise(zero)).withColumn("sum", F.sum("size").over(so_far))
        prior = F.last(F.when(~F.col("leaf"), F.struct("id", "sum")), True).over(siblings.rowsBetween(W.unboundedPreceding, -1))
        known = rounds.write(known.select("id", "up", "ord", "before", "inner", "leaf", "size", "sum", prior.alias("prior")))
        count, leaves = known.agg(F.count("*"), F.count_if("leaf")).first()
        most = most or count
        if 2 * leaves < count or count <= most * CORE:
            break
        gone = F.col("sum") - F.coalesce("prior.sum", zero)
        taken.append(known.where("leaf").select("id", F.coalesce("prior.id", "up").alias("by"), F.col("prior").isNotNull().alias("sibling"), (gone - F.col("inner")).alias("off"), "inner"))
        below = known.where(~root).groupBy(F.col("up").alias("id")).agg(F.bool_or(~F.col("leaf")).alias("_has"), (F.sum("size") - F.coalesce(F.max(F.when(~F.col("leaf"), F.col("sum"))), zero)).alias("_end"))
        left = known.where("NOT leaf").select("id", "up", "ord", (F.col("before") + gone).alias("before"), "inner")
    kept = len(rounds.paths)
    placed = _walked(known, rounds, kept)
    for leaf in reversed(taken):
        back = leaf.join(placed.select(F.col("id").alias("by"), "depth", "position", "end"), "by")
        at = F.col("off") + F.when(F.col("sibling"), F.col("end")).otherwise(F.col("position"))
        back = back.select("id", (F.col("depth") + (~F.col("sibling")).cast("int")).alias("depth"), at.alias("position"), (at + F.col("inner")).alias("end"))
        placed = placed.unionByName(back) if leaf is taken[0] else rounds.write(placed.unionByName(back))
    result = out.write(placed.select("id", "depth", "position"))
    rounds.forget(0)
    return result


def _walked(nodes: DataFrame, rounds: Rounds, kept: int) -> DataFrame:
    """(id, depth, position, end) of nodes (id, up, ord, before, inner), ``end``: the position of the last node below one. Of the tables of ``rounds`` the first ``kept`` stay.

    A walk around the tree enters each node and leaves it; each of these steps knows the next one. By pointer doubling a step learns how many nodes are passed from it on, and how far the walk goes up from it; the
    end that it comes to tells whether it began below a root."""
    siblings = W.partitionBy("up").orderBy("ord", "id")
    known = rounds.write(nodes.select("id", "up", "before", "inner", F.lead("id").over(siblings).alias("after"), (F.row_number().over(siblings) == 1).alias("_first")))
    first = known.where("_first AND up IS NOT NULL").select(F.col("up").alias("id"), F.col("id").alias("child"))
    both = known.join(first, "id", "left")
    zero, one, enter = F.lit(0).cast("long"), F.lit(1).cast("long"), F.col("before") + 1
    entering = both.select(
        "id", F.lit(0).alias("side"), F.coalesce("child", "id").alias("to"), F.when(F.col("child").isNull(), 1).otherwise(0).alias("to_side"), enter.alias("own"), enter.alias("n"), one.alias("rise"), F.lit(False).alias("ends")
    )
    last = F.col("after").isNull() & F.col("up").isNull()
    leaving = both.select(
        "id", F.lit(1).alias("side"), F.coalesce("after", "up").alias("to"), F.when(F.col("after").isNull(), 1).otherwise(0).alias("to_side"), F.col("inner").alias("own"), F.col("inner").alias("n"), (-one).alias("rise"), last.alias("ends")
    )
    walk = rounds.write(entering.unionByName(leaving))
    for _ in range(walk.count().bit_length()):  # a walk around one tree is as long as all its steps, so none of the rounds can be saved
        open_ = walk.where("to IS NOT NULL")
        beyond = walk.select(F.col("id").alias("to"), F.col("side").alias("to_side"), F.col("to").alias("_to"), F.col("to_side").alias("_side"), F.col("n").alias("_n"), F.col("rise").alias("_rise"), F.col("ends").alias("_ends"))
        far = open_.join(beyond, ["to", "to_side"], "left").select(
            "id", "side", F.col("_to").alias("to"), F.col("_side").alias("to_side"), "own", (F.col("n") + F.coalesce("_n", zero)).alias("n"), (F.col("rise") + F.coalesce("_rise", zero)).alias("rise"), F.coalesce("_ends", F.lit(False)).alias("ends")
        )
        walk = rounds.write(walk.where("to IS NULL").unionByName(far))
        rounds.forget(1, kept)
    done = walk.where("to IS NULL AND ends")
    total = done.where("side = 0").agg(F.max("n").alias("total"))  # one number
    passed = done.crossJoin(total).select("id", "side", (1 - F.col("rise")).cast("int").alias("depth"), (F.col("total") - F.col("n") + F.col("own")).alias("at"))
    # entered at its position, left at the last one below it
    left = passed.where("side = 1").select("id", F.col("at").alias("end"))
    return rounds.write(passed.where("side = 0").select("id", "depth", F.col("at").alias("position")).join(left, "id"))
