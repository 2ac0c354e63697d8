"""Moves of a batch of notes: every note's new path may be another's old one.

Paths and moves form chains, which end at a free path, and rings. Pointer doubling tells each move how many moves must come first; a chain is cut every ``CUT`` moves and a ring at its
smallest path, and the first move of a piece goes by a temporary name. So pieces are independent: first all firsts go to their temporary names, then each piece moves note after note into the one hole that it
has, then the temporary names go to their places. A piece that is started again finds its hole and goes on behind it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolake.operators.shared import Rounds
from annolake.sources.vault import OWN, Store, checked, dealt

CUT = 512


def _ranked(edges: DataFrame, rounds: Rounds) -> DataFrame:
    """(src, dst, rank, end, low): of each move how many follow until its chain ends and the free path there, both null on a ring, and the smallest path from it on."""
    nothing = F.lit(None).cast("string")
    known = rounds.write(edges.select("src", "dst", F.col("dst").alias("up"), F.lit(0).cast("long").alias("rank"), nothing.alias("end"), F.least("src", "dst").alias("low")))
    steps, most = 1, known.count()
    while steps <= 2 * most and not (open_ := known.where("up IS NOT NULL")).isEmpty():
        above = known.select(F.col("src").alias("up"), F.col("up").alias("_next"), F.col("rank").alias("_rank"), F.col("end").alias("_end"), F.col("low").alias("_low"), F.lit(True).alias("_there"))
        there, far = F.col("_there").isNotNull(), open_.join(above, "up", "left")
        rank, end = F.when(there, F.col("rank") + F.col("_rank") + 1).otherwise(F.col("rank")), F.when(there, F.col("_end")).otherwise(F.col("up"))
        far = far.select("src", "dst", F.col("_next").alias("up"), rank.alias("rank"), end.alias("end"), F.least("low", F.coalesce("_low", "low")).alias("low"))
        known = rounds.write(known.where("up IS NULL").unionByName(far))
        rounds.forget()
        steps *= 2
    return known.select("src", "dst", F.when(F.col("up").isNull(), F.col("rank")).alias("rank"), "end", "low")


def move_plan(moves: DataFrame, existing: DataFrame, cut: int = CUT) -> DataFrame:
    """(chain, piece, step, src, dst, via) of moves (src, dst) among existing notes (path): a piece's moves in the order of ``step``; ``via``: if it goes by a temporary name. A move from a path
    without a note, or to its own path, is none. Two moves from or to one path, and one to a note that stays, are refused. The plan is a written table, dealt by pieces."""
    rounds, out = Rounds(moves.sparkSession, "moves"), Rounds(moves.sparkSession, "move-plan")
    existing = out.write(existing.select("path").distinct())
    real = rounds.write(moves.where("src <> dst").join(existing.select(F.col("path").alias("src")), "src", "left_semi").select("src", "dst"))
    for side in ("src", "dst"):
        if twice := real.groupBy(side).count().where("count > 1").head(1):
            raise ValueError(f"two moves with {side} {twice[0][0]!r}")
    stays = real.join(existing.select(F.col("path").alias("dst")), "dst", "left_semi").join(real.select(F.col("src").alias("dst")), "dst", "left_anti").head(1)
    if stays:
        raise ValueError(f"a note that stays is at {stays[0]['dst']!r}")
    ranked = out.write(_ranked(real, rounds))
    # a ring is opened at its smallest path: the note there is taken out first, and the others follow each other into its place
    rings = ranked.where("end IS NULL")
    opened = rings.where("src <> low").select("src", F.when(F.col("dst") == F.col("low"), F.lit("")).otherwise(F.col("dst")).alias("dst"))
    inside = out.write(_ranked(opened, rounds)).select("src", F.col("rank").alias("_rank"))
    turned = rings.join(inside, "src", "left").select("src", "dst", F.coalesce(F.col("_rank") + 1, F.lit(0).cast("long")).alias("step"), F.col("low").alias("chain"), F.lit(True).alias("ring"))
    every = ranked.where("end IS NOT NULL").select("src", "dst", F.col("rank").alias("step"), F.col("end").alias("chain"), F.lit(False).alias("ring")).unionByName(turned)
    # of a ring the first goes by a temporary name, and of either the first of each later piece
    via = (F.col("step") % cut == 0) & (F.col("ring") | (F.col("step") > 0))
    plan = out.write(every.select("chain", F.floor(F.col("step") / cut).cast("long").alias("piece"), "step", "src", "dst", via.alias("via")))
    rounds.forget(0)
    out.forget()
    return dealt(plan, "chain", "piece")


def move_notes(plan: DataFrame, root: str, run: str) -> None:
    """Carries out a plan of `move_plan`. ``run`` names it: one that was stopped goes on where it was, and one that is done is not done again."""
    own = f"{OWN}/moves-{checked(run)}"

    def renamed(out: bool):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, n = Store(root), 0
            for batch in batches:
                for src, dst in zip(batch.column("src").to_pylist(), batch.column("dst").to_pylist(), strict=True):
                    name = f"{own}/{hashlib.sha256(src.encode()).hexdigest()}"
                    a, b = (checked(src), name) if out else (name, checked(dst))
                    if store.exists(a):
                        if store.exists(b):
                            raise ValueError(f"something is at {b!r}")
                        store.move(a, b)
                        n += 1
            yield pa.record_batch({"n": [n]})

        return rows

    def piece(rows: pa.Table) -> pa.Table:
        store, chain = Store(root), [r for r in rows.sort_by("step").to_pylist() if not r["via"]]
        if chain:
            places = [checked(chain[0]["dst"]), *(checked(r["src"]) for r in chain)]
            hole = next((i for i, p in enumerate(places) if not store.exists(p)), None)
            if hole is None:
                raise ValueError(f"something is at {places[0]!r}")
            for i in range(hole, len(chain)):
                store.move(places[i + 1], places[i])
        return pa.table({"n": [len(chain)]})

    apart = plan.where("via").select("src", "dst")
    pieces = plan.select("chain", "piece", "step", "src", "dst", "via").groupBy("chain", "piece").applyInArrow(piece, "n long")
    steps = apart.mapInArrow(renamed(True), "n long"), pieces, apart.mapInArrow(renamed(False), "n long")
    store = Store(root)
    for i, step in enumerate(steps):
        if not store.exists(f"{own}/done-{i}"):  # a step that is over must not be looked at again: its paths have other notes now
            step.agg(F.sum("n")).collect()
            store.put(f"{own}/done-{i}", b"")
