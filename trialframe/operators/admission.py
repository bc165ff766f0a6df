"""Admission: which proposed configs are new, finished or being worked on.

Results may be far larger than the candidates.  They are first reduced to the
keys the candidates ask for.  Those keys are written to a small table, so the
planner knows their size before it starts on the results: when they fit its
broadcast threshold, two result columns are scanned and nothing large is
shuffled; otherwise both sides are shuffled on the key and hot keys are split
at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialframe.operators.ordered import MAX_GROUP_ROWS, ordered_groups
from trialframe.session import durable

KEY = ["project", "fingerprint"]
ACCEPTED, COMPLETED, CLAIMED = "accepted", "completed", "claimed"


def asked_keys(candidates: DataFrame) -> DataFrame:
    """The distinct candidate keys, as a table of known size."""
    return durable(candidates.select(*KEY).distinct())


def _finished(results: DataFrame, asked: DataFrame) -> DataFrame:
    return results.select(*KEY).join(asked, KEY, "left_semi").distinct()


def finished_keys(candidates: DataFrame, results: DataFrame) -> DataFrame:
    """Candidate keys with any stored result, failed and discarded included."""
    return _finished(results, asked_keys(candidates))


def novel_candidates(candidates: DataFrame, results: DataFrame) -> DataFrame:
    """Candidates without any finished result."""
    return candidates.join(finished_keys(candidates, results), KEY, "left_anti")


def completed_candidates(candidates: DataFrame, results: DataFrame) -> DataFrame:
    """Candidates that already have a result (existence by key)."""
    return candidates.join(finished_keys(candidates, results), KEY, "left_semi")


def admit(
    candidates: DataFrame,
    results: DataFrame,
    claims: DataFrame,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Decide each candidate: accepted, completed or claimed.

    ``candidates``: project, fingerprint, ts, candidate_id; ``claims``:
    project, fingerprint, claimed_at, expires_at.  A claim blocks a candidate
    when claimed_at <= ts < expires_at.  Of the unblocked candidates of one
    key the earliest wins, the others are claimed.

    Claims and candidates are read as one ordered sequence per key, where the
    running maximum of expires_at tells whether a claim is live: no pairs of
    candidates and claims are formed.
    """
    asked = asked_keys(candidates)
    # Written: what follows is read more than once, the results are not.
    done = durable(_finished(results, asked)).withColumn("_done", F.lit(True))
    asking = candidates.join(done, KEY, "left").select(
        *KEY, "ts", F.lit(1).alias("_kind"), "candidate_id",
        F.coalesce("_done", F.lit(False)).alias("_done"),
        F.lit(None).cast(claims.schema["expires_at"].dataType).alias("_expires"),
    )
    id_type = candidates.schema["candidate_id"].dataType
    holding = claims.join(asked, KEY, "left_semi").select(
        *KEY, F.col("claimed_at").alias("ts"), F.lit(0).alias("_kind"),
        F.lit(None).cast(id_type).alias("candidate_id"),
        F.lit(False).alias("_done"), F.col("expires_at").alias("_expires"),
    )
    candidate = F.col("_kind") == 1
    leased = F.coalesce(F.col("_until") > F.col("ts"), F.lit(False))
    free = candidate & ~F.col("_done") & ~leased
    decided = (
        ordered_groups(
            asking.unionByName(holding), KEY, ["ts", "_kind", "candidate_id"],
            max_group_rows,
        )
        .running("_until", "max", F.col("_expires"))
        .with_columns(_leased=leased, _free=free)
        .running("_taken", "max", F.when(F.col("_free"), F.lit(1)))
        .result()
    )
    reason = (
        F.when(F.col("_done"), COMPLETED)
        .when(F.col("_leased") | F.col("_taken").isNotNull(), CLAIMED)
        .otherwise(ACCEPTED)
    )
    return decided.where(candidate).select(
        *KEY, "ts", "candidate_id",
        (reason == ACCEPTED).alias("accepted"), reason.alias("reason"),
    )


def shard_of(fingerprint: Column, groups: Column) -> Column:
    """The search group that owns a fingerprint: disjoint and stable."""
    hashed = F.conv(F.substring(fingerprint, 1, 8), 16, 10).cast("bigint")
    return F.element_at(groups, (F.pmod(hashed, F.size(groups)) + 1).cast("int"))


def assign_shards(candidates: DataFrame, contracts: DataFrame) -> DataFrame:
    """Give each candidate its shard from its project's search groups."""
    groups = contracts.select(F.col("name").alias("project"), "search_groups")
    return (
        candidates.join(groups, "project", "left")
        .withColumn("search_group", shard_of(F.col("fingerprint"), F.col("search_groups")))
        .drop("search_groups")
    )
