"""Text recognition as a pluggable operator, its registry, and the gates in front of a run."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = "page_id string, status string, text string"
Recognise = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


class Registry:
    """Backends by name: the last one registered under a name counts, listings keep the order of first registration."""

    def __init__(self) -> None:
        self._own: dict[str, tuple[Recognise, bool]] = {}

    def register(self, name: str, recognise: Recognise, metered: bool = False) -> None:
        self._own[name] = (recognise, metered)

    def get(self, name: str) -> Recognise | None:
        return self._own[name][0] if name in self._own else None

    def names(self) -> list[str]:
        return list(self._own)

    def others(self, built_in: set[str]) -> bool:
        return any(n not in built_in for n in self._own)


def _constant(status: str) -> Recognise:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"page_id": frame.page_id, "status": status, "text": ""})

    return run


off, unavailable = _constant("skipped"), _constant("unavailable")


def per_page(read: Callable[[bytes], str]) -> Recognise:
    """A backend from a function of one page; a page that fails is a failed page and no failed task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for page, content in zip(frame.page_id, frame.content, strict=True):
                try:
                    rows.append((page, "ok", read(content)))
                except Exception:  # noqa: BLE001  whatever a backend raises
                    rows.append((page, "failed", ""))
            yield pd.DataFrame(rows, columns=["page_id", "status", "text"])

    return run


def recognised(pages: DataFrame, recognise: Recognise) -> DataFrame:
    """(page_id, status, text) of (page_id, content): pages without content are not sent and come back skipped, by key, so results and pages
    cannot come apart."""
    sent = pages.where(F.col("content").isNotNull()).select("page_id", "content").mapInPandas(recognise, RESULT)
    return pages.select("page_id").join(sent, "page_id", "left").select("page_id", F.coalesce("status", F.lit("skipped")).alias("status"), F.coalesce("text", F.lit("")).alias("text"))


def background_blocked(enabled: Column, running: Column, connected: Column, consented: Column) -> Column:
    """The first reason not to run in the background, else null."""
    return F.coalesce(
        F.when(~enabled, "auto-sync-off"), F.when(running, "already-running"), F.when(~connected, "not-connected"), F.when(~consented, "no-background-consent"),
    )


def spend_blocked(metered: Column, consented: Column) -> Column:
    """The reason why a backend that costs money does not run unasked, else null."""
    return F.when(metered & ~consented, "no-consent-to-spend")


def preflight(connected: Column, running: Column) -> Column:
    return connected & ~running


#: Platform and the memory in GB that machines for the local model are sold with at least; they report up to 1 GB less.
MEMORY_FLOORS = {"darwin": 18, "win32": 24}


def model_block(platform: Column, arch: Column, memory_bytes: Column) -> Column:
    """struct<kind, floor_gb, actual_gb> of why a machine cannot run the local model, else null."""
    gib = 1 << 30
    floor = F.create_map(*(F.lit(x) for pair in MEMORY_FLOORS.items() for x in pair))[platform]
    none = F.lit(None).cast("int")
    wrong = floor.isNull() | (arch != "arm64")
    actual = F.floor(memory_bytes / gib + 0.5).cast("int")
    return F.when(wrong, F.struct(F.lit("architecture").alias("kind"), none.alias("floor_gb"), none.alias("actual_gb"))).when(
        memory_bytes < (floor - 1).cast("long") * gib, F.struct(F.lit("memory").alias("kind"), floor.alias("floor_gb"), actual.alias("actual_gb"))
    )


def model_state(s: Column, model_bytes: int, projector_bytes: int, stale_ms: int = 60_000) -> Column:
    """State of a local model from a snapshot struct, the first rule that holds: a mark of corruption, an unfinished download, files missing, not yet verified, of the
    wrong size, or without their engine."""
    fresh = s["lock_held_at_ms"].isNotNull() & (s["now_ms"] - s["lock_held_at_ms"] < stale_ms)
    return (
        F.when(s["corrupt"], "corrupt").when(s["part_present"], F.when(fresh, "downloading").otherwise("partial"))
        .when(s["model_bytes"].isNull() | s["mmproj_bytes"].isNull(), "absent").when(~s["verified_present"], "verifying")
        .when((s["model_bytes"] != model_bytes) | (s["mmproj_bytes"] != projector_bytes), "absent").when(~s["runtime_present"], "removed").otherwise("ready")
    )


def is_gated(requires_licence: Column, tier: Column) -> Column:
    """A backend that needs a licence, for somebody without one."""
    return requires_licence & (tier == "free")


def gated_fallback(label: Column, vision: Column, silent: Column) -> Column:
    """struct<use, notice> of what stands in for a backend without its licence; a silent run says nothing."""
    told = F.concat(label, F.lit(" needs a licence"), F.when(vision, " — using the local reader for this run.").otherwise("."))
    return F.struct(F.when(vision, "vision").otherwise("unavailable").alias("use"), F.when(~silent, told).alias("notice"))


def unconfigured_fallback(label: Column, vision: Column, silent: Column) -> Column:
    """The same for a backend that lacks its key: never one that costs money, and without a local reader no notice either."""
    told = F.concat(F.lit("No API key set for "), label, F.lit(" — using the local reader for this run."))
    return F.struct(F.when(vision, "vision").otherwise("unavailable").alias("use"), F.when(vision & ~silent, told).alias("notice"))


def cleanup_plan(directories: DataFrame, pinned: str) -> DataFrame:
    """(name, action) of (name, complete, has_part): a complete other version is offered, an unfinished one is deleted without asking; the rest is kept."""
    action = F.when(F.col("name") == pinned, "keep").when(F.col("complete"), "offer").when(F.col("has_part"), "delete").otherwise("keep")
    return directories.select("name", action.alias("action"))


def inserted_lines(lines: DataFrame, extra: DataFrame, page: str = "page_id") -> DataFrame:
    """(page_id, ord, text): lines by ``center`` (larger is higher) with extra ones put before the first line whose centre is lower. lines: (page_id, ord,
    center, text); extra: (page_id, ord, center, text)."""
    from pyspark.sql import Window as W

    # by centre, extra ones before lines of the same: the first line, by its place, of those that have gone before is the spot
    both = extra.select(page, "center", F.lit(0).alias("own"), F.col("ord").alias("n"), "text").unionByName(lines.select(page, "center", F.lit(1).alias("own"), F.col("ord").alias("n"), "text"))
    lower = W.partitionBy(page).orderBy("center", "own").rowsBetween(W.unboundedPreceding, -1)
    spot = both.withColumn("at", F.min(F.when(F.col("own") == 1, F.col("n"))).over(lower)).where("own = 0")
    put = spot.select(page, F.coalesce("at", F.lit(2**31 - 1)).alias("at"), "own", (-F.col("center")).alias("c"), "n", "text")
    whole = lines.select(page, F.col("ord").alias("at"), F.lit(1).alias("own"), F.lit(0.0).alias("c"), F.col("ord").alias("n"), "text").unionByName(put)
    return whole.select(page, (F.row_number().over(W.partitionBy(page).orderBy("at", "own", "c", "n")) - 1).alias("ord"), "text")
