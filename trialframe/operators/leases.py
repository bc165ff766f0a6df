"""Leases: who works on what, and until when.

A lease ends ``ttl`` after its last beat; at that very instant it is expired.
A beat at or after the end opens a new lease.  Lease tables are append-only
events; the state at any time is computed, never updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialframe.functions.clock import expires_at
from trialframe.operators.ordered import MAX_GROUP_ROWS, ordered_groups

# Kinds of lease event.
CLAIM, REFRESH, RELEASE = "claim", "refresh", "release"


def claim_rows(candidates: DataFrame, contracts: DataFrame) -> DataFrame:
    """Claim rows for candidates: ``expires_at`` is claimed_at plus the ttl."""
    ttl = contracts.select(F.col("name").alias("project"), "claim_ttl_seconds")
    rows = candidates.join(ttl, "project", "left")
    end = expires_at(F.col("claimed_at"), F.col("claim_ttl_seconds"))
    return rows.withColumn("expires_at", end).drop("claim_ttl_seconds")


def live_claims(claims: DataFrame, as_of: Column) -> DataFrame:
    """Claims live at ``as_of``.  A missing expiry counts as expired."""
    return claims.where(F.col("expires_at") > as_of)


def _beat() -> Column:
    return F.struct("ts", "event_id", "expires")


def _starts(previous: Column) -> Column:
    return previous.isNull() | (F.col("ts") >= previous["expires"])


def lease_sessions(
    beats: DataFrame, keys: list[str], max_group_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Lease intervals per key from beats (keys, ts, beat_id, ttl_seconds).

    The end is set by the last beat and its own ttl.
    """
    rows = beats.select(
        *keys, "ts", "beat_id",
        expires_at(F.col("ts"), F.col("ttl_seconds")).alias("expires"),
    )
    beat = F.struct("ts", "beat_id", "expires")
    numbered = (
        ordered_groups(rows, keys, ["ts", "beat_id"], max_group_rows)
        .running("_previous", "max", beat)
        .with_columns(_start=_starts(F.col("_previous")).cast("long"))
        .running("_lease", "sum", F.col("_start"), include_current=True)
        .result()
    )
    return (
        numbered.groupBy(*keys, "_lease")
        .agg(
            F.min("ts").alias("lease_start"),
            F.max(beat)["expires"].alias("lease_end"),
            F.count("*").alias("beats"),
        )
        .drop("_lease")
    )


def _played(events: DataFrame, max_group_rows: int) -> DataFrame:
    """Events with ``_valid`` (had an effect) and the number of their lease."""
    at = F.struct("ts", "event_id")
    kind = F.col("kind")
    rows = events.select(
        "project", "fingerprint", "agent_id", "kind", "ts", "event_id",
        expires_at(F.col("ts"), F.col("ttl_seconds")).alias("expires"),
    )
    claim = F.struct("ts", "event_id", "agent_id")
    owned = F.col("_claim.agent_id") == F.col("agent_id")
    claimed_at = F.struct(
        F.col("_claim.ts").alias("ts"), F.col("_claim.event_id").alias("event_id")
    )
    released = F.coalesce(F.col("_release") > claimed_at, F.lit(False))
    is_beat = F.col("_valid") & (kind != RELEASE)
    opens = F.col("_valid") & (
        (kind == CLAIM) | ((kind == REFRESH) & _starts(F.col("_previous")))
    )
    return (
        ordered_groups(
            rows, ["project", "fingerprint"], ["ts", "event_id"], max_group_rows
        )
        .running("_claim", "max", F.when(kind == CLAIM, claim), include_current=True)
        .with_columns(_owned=F.coalesce(owned, F.lit(False)))
        .running("_release", "max", F.when(F.col("_owned") & (kind == RELEASE), at))
        .with_columns(_valid=F.col("_owned") & ((kind == CLAIM) | ~released))
        .running("_previous", "max", F.when(is_beat, _beat()))
        .with_columns(_start=opens.cast("long"))
        .running("_lease", "sum", F.col("_start"), include_current=True)
        .result()
    )


def event_effects(
    events: DataFrame, max_group_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Whether each event had an effect: the owner's, on an unreleased claim."""
    return _played(events, max_group_rows).select(
        "project", "fingerprint", "event_id", F.col("_valid").alias("effective")
    )


def lease_states(
    events: DataFrame, as_of: Column, max_group_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Leases from claim, refresh and release events, with their state.

    ``events``: project, fingerprint, agent_id, kind, ts, event_id,
    ttl_seconds.  Claims in the table are accepted ones.  Only the agent of
    the latest claim can refresh or release; events of others, and beats after
    a release, have no effect.  State at ``as_of``: released, expired or open.
    """
    kind = F.col("kind")
    known = events.where(F.col("ts") <= as_of)
    ended = F.when(kind == RELEASE, F.col("ts"))
    leases = (
        _played(known, max_group_rows)
        .where("_valid")
        .groupBy("project", "fingerprint", "_lease")
        .agg(
            F.first("agent_id").alias("agent_id"),
            F.min(F.when(kind != RELEASE, F.col("ts"))).alias("lease_start"),
            F.max(F.when(kind != RELEASE, _beat()))["expires"].alias("expires_at"),
            F.min(ended).alias("_released_at"),
            F.count_if(kind != RELEASE).alias("beats"),
        )
    )
    in_time = F.col("_released_at") < F.col("expires_at")
    released_at = F.when(in_time, F.col("_released_at"))
    return leases.select(
        "project", "fingerprint", "agent_id", "lease_start",
        F.coalesce(released_at, F.col("expires_at")).alias("lease_end"),
        "beats",
        F.when(released_at.isNotNull(), "released")
        .when(F.col("expires_at") <= as_of, "expired")
        .otherwise("open")
        .alias("state"),
    )
