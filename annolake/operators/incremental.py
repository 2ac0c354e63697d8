"""Incremental runs over a keyed state table: what changed, what to do about it, and the next state.

state: sync_key, doc_id, page_id, tag, folder, entry_hash, page_hash, status, render_version, n_items; current: the same units as they are now.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RENDER_VERSION = 30


def is_stale(version: Column, current: int = RENDER_VERSION) -> Column:
    return F.coalesce(version, F.lit(0)) < current


def planned(current: DataFrame, state: DataFrame, render_version: int = RENDER_VERSION) -> DataFrame:
    """One row for each unit of either side with an action: write (new), move (known, other folder), rewrite (changed or stale), skip (unchanged), orphan (its
    document is gone); a unit that is orphaned already stays."""
    s = state.select(*(F.col(c).alias(f"s_{c}") for c in state.columns))
    both = current.join(s, current["sync_key"] == s["s_sync_key"], "full_outer")
    known, here = F.col("s_sync_key").isNotNull() & (F.col("s_status") == "active"), F.col("sync_key").isNotNull()
    changed = ~F.col("page_hash").eqNullSafe(F.col("s_page_hash"))
    action = (
        F.when(~here & (F.col("s_status") == "active"), "orphan").when(~here, "keep").when(~known, "write")
        .when(~F.col("folder").eqNullSafe(F.col("s_folder")), "move").when(changed | is_stale(F.col("s_render_version"), render_version), "rewrite").otherwise("skip")
    )
    return both.select(
        F.coalesce("sync_key", "s_sync_key").alias("sync_key"), F.coalesce("doc_id", "s_doc_id").alias("doc_id"), action.alias("action"),
        F.coalesce(here & known & (F.col("n_items") < F.col("s_n_items")), F.lit(False)).alias("shrunk"), *(F.coalesce(c, f"s_{c}").alias(c) for c in ("tag", "folder", "page_hash")),
        F.col("n_items"), F.col("s_n_items"),
    )


def next_state(plan: DataFrame, render_version: int = RENDER_VERSION) -> DataFrame:
    gone = F.col("action").isin("orphan", "keep")
    return plan.select(
        "sync_key", "doc_id", "tag", "folder", "page_hash", F.when(gone, "orphaned").otherwise("active").alias("status"), F.when(~gone, F.lit(render_version)).alias("render_version"),
        F.coalesce("n_items", "s_n_items").alias("n_items"),
    )


def nothing_to_do(root: str | None, old_root: str | None, fingerprint: str, old_fingerprint: str, state: DataFrame, notes: DataFrame, render_version: int = RENDER_VERSION) -> bool:
    """The first gate: same root, same mapping, no stale render, no note missing. Two existence tests, each of which stops at the first row."""
    if root is None or root != old_root or fingerprint != old_fingerprint:
        return False
    active = state.where(F.col("status") == "active")
    if not active.where(is_stale(F.col("render_version"), render_version)).isEmpty():
        return False
    return missing_notes(active, notes).isEmpty()


def missing_notes(state: DataFrame, notes: DataFrame) -> DataFrame:
    return state.where(F.col("status") == "active").join(notes.select(F.col("path").alias("note_path")), "note_path", "left_anti")


def vanished(state: DataFrame, live: DataFrame) -> DataFrame:
    """Active rows whose document is gone."""
    return state.where(F.col("status") == "active").join(live.select("doc_id").distinct(), "doc_id", "left_anti")


def invalidated(state: DataFrame) -> DataFrame:
    return state.withColumn("render_version", F.when(F.col("status") != "active", F.col("render_version")))


def interval_due(last: Column, hours: Column, now: Column) -> Column:
    """Whether the interval is over; a time that is missing or can't be read is long ago."""
    then = F.unix_millis(F.try_to_timestamp(last))
    return F.coalesce(now - then >= hours * 3_600_000, F.lit(True))


#: Days of a trial, between two checks of a licence, and that an unchecked one is carried.
TRIAL_DAYS, CHECK_DAYS, CARRY_DAYS = 14, 7, 30
_DAY = 86_400_000


def _ms(iso: Column) -> Column:
    """Milliseconds of a written time; null if it can't be read."""
    return F.unix_millis(F.try_to_timestamp(iso))


def entitlement(s: Column, now: Column) -> Column:
    """struct<tier, reason, since, ends_at, stale> of a licence struct<key, activation_id, validated_at, revoked_at, trial_started_at> at a time in milliseconds. A time
    that can't be read counts as missing; a key that was never confirmed unlocks nothing."""
    since, trial = _ms(s["validated_at"]), _ms(s["trial_started_at"])
    ends = trial + TRIAL_DAYS * _DAY
    none, no = F.lit(None).cast("string"), F.lit(None).cast("boolean")

    def told(tier: str, reason: str | None = None, since: Column = none, ends_at: Column = F.lit(None).cast("bigint"), stale: Column = no) -> Column:
        return F.struct(F.lit(tier).alias("tier"), F.lit(reason).cast("string").alias("reason"), since.alias("since"), ends_at.alias("ends_at"), stale.alias("stale"))

    return (
        F.when(s["revoked_at"].isNotNull(), told("free", "revoked"))
        .when(s["key"].isNotNull() & since.isNotNull(), told("pro", since=s["validated_at"], stale=now - since > CARRY_DAYS * _DAY))
        .when(now < ends, told("trial", ends_at=ends)).when(ends.isNotNull(), told("free", "trial-ended"))
        .when(s["key"].isNotNull(), told("free", "not-activated")).otherwise(told("free", "never-bought"))
    )


def next_call(s: Column, now: Column) -> Column:
    """none, activate (a key without an activation) or validate (never done, or a week ago)."""
    last = _ms(s["validated_at"])
    return (
        F.when(s["key"].isNull() | s["revoked_at"].isNotNull(), "none").when(s["activation_id"].isNull(), "activate")
        .when(last.isNull() | (now - last >= CHECK_DAYS * _DAY), "validate").otherwise("none")
    )


def licence_after(s: Column, outcome: Column, now: Column) -> Column:
    """The licence struct (with ended_notice_shown) after an answer: valid, unknown-key, withdrawn, unknown-activation, activation-limit or unreachable; the last two change nothing."""
    valid, gone = outcome == "valid", outcome.isin("unknown-key", "withdrawn")
    return F.struct(
        s["key"].alias("key"), F.when(outcome != "unknown-activation", s["activation_id"]).alias("activation_id"), F.when(valid, now).otherwise(s["validated_at"]).alias("validated_at"),
        F.when(gone, now).when(~valid, s["revoked_at"]).alias("revoked_at"), s["trial_started_at"].alias("trial_started_at"),
        F.when(valid, False).otherwise(s["ended_notice_shown"]).alias("ended_notice_shown"),
    )


def licence_activated(s: Column, activation: Column, now: Column) -> Column:
    """The licence struct after an activation."""
    return F.struct(
        s["key"].alias("key"), activation.alias("activation_id"), now.alias("validated_at"), F.lit(None).cast("string").alias("revoked_at"), s["trial_started_at"].alias("trial_started_at"),
        F.lit(False).alias("ended_notice_shown"),
    )


def worst_status(status: Column) -> Column:
    """Of a group: unavailable before failed before ok, else skipped."""
    return F.when(F.bool_or(status == "unavailable"), "unavailable").when(F.bool_or(status == "failed"), "failed").when(F.bool_or(status == "ok"), "ok").otherwise("skipped")


def unit_status(status: Column) -> Column:
    """Of a unit's pages: ok if any is, else failed if any is, else skipped."""
    return F.when(F.bool_or(status == "ok"), "ok").when(F.bool_or(status == "failed"), "failed").otherwise("skipped")


def resume_plan(part: Column, total: Column) -> Column:
    return F.when(part <= 0, "fresh").when(part < total, "resume").when(part == total, "complete").otherwise("fresh")


def range_plan(status: Column, offset: Column) -> Column:
    return F.when(status == 206, "append").when(status == 200, "restart").otherwise("error")


def first_reason(*conditions: tuple[Column, str]) -> Column:
    """The name of the first condition that holds, else null."""
    return F.coalesce(*(F.when(c, F.lit(name)) for c, name in conditions))
