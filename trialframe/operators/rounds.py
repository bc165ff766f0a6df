"""Whole rounds: from proposals to a leaderboard."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.functions.fingerprints import has_changes, text_fingerprint
from trialframe.functions.logs import log_metric
from trialframe.functions.text import new_run_id
from trialframe.operators.admission import admit
from trialframe.operators.decisions import (
    as_results, code_results, decision_error, keep_discard_replay, union_results,
)
from trialframe.operators.evaluation import (
    Evaluate, artifact_rows, config_results, evaluate_configs, with_history,
    with_reduced_history,
)
from trialframe.operators.leaderboard import leaderboard_snapshot
from trialframe.operators.ordered import MAX_GROUP_ROWS
from trialframe.session import durable


def config_round(
    candidates: DataFrame,
    results: DataFrame,
    claims: DataFrame,
    contracts: DataFrame,
    evaluate: Evaluate,
    reduce: Callable[[DataFrame], DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """One round: admit → evaluate → add results → leaderboard.

    The user's function sees the project's best rows, or with ``reduce`` what
    that makes of all results, failed and discarded ones and all fields included.

    Only accepted candidates reach the user's function: the cheap checks come
    before the Python stage.  Evaluated rows are written once, since their run
    ids and times must not change when a lost executor recomputes them.
    """
    spark = candidates.sparkSession
    keys = ["project", "fingerprint", "ts", "candidate_id"]
    admitted = admit(candidates, results, claims)
    accepted = admitted.where("accepted").select(*keys)
    asked = candidates.join(accepted, keys, "left_semi")
    if reduce is None:
        best = leaderboard_snapshot(results, contracts, ("fingerprint", "run_id", "metric_value"))
        asked = with_history(asked, best)
    else:
        asked = with_reduced_history(asked, results, reduce)
    tasks = spark.sparkContext.defaultParallelism
    evaluated = durable(
        evaluate_configs(asked, evaluate, tasks).withColumn("run_id", new_run_id())
    )
    fresh = config_results(evaluated, contracts)
    everything = union_results(results, fresh)
    return {
        "admission": admitted,
        "results": fresh,
        "artifacts": artifact_rows(evaluated),
        "snapshot": leaderboard_snapshot(everything, contracts),
    }


def code_round(
    runs: DataFrame,
    results: DataFrame,
    claims: DataFrame,
    contracts: DataFrame,
    max_group_rows: int = MAX_GROUP_ROWS,
    diffs_of: Callable[[DataFrame], DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """One round of code runs whose logs are at hand.

    ``runs``: project, run_id, agent_id, diff, log, timed_out, claimed_at,
    completed_at, base_commit, new_commit and optional columns of the result
    schema.  Empty diffs are left out.  Diffs and logs are read once, to get
    fingerprint and metric; they do not travel through admission and ranking,
    and the diff of an accepted run joins its result row again by run id.
    ``diffs_of`` gives the diffs of the runs ``(project, run_id)`` with these
    two columns, where they can be had without reading all of ``runs`` again.
    """
    terms = contracts.select(
        F.col("name").alias("project"), "objective",
        F.col("metric").alias("metric_name"), "metric_pattern",
    )
    timed_out = F.coalesce(F.col("timed_out"), F.lit(False))
    shared = [c for c in ("objective", "metric_name") if c in runs.columns]
    keyed = (
        runs.drop(*shared)
        .where(has_changes(F.col("diff")))
        .join(terms, "project", "inner")
        .withColumns(
            {
                "fingerprint": text_fingerprint(F.col("diff")),
                "metric": F.when(
                    ~timed_out, log_metric(F.col("log"), F.col("metric_pattern"))
                ),
                "timed_out": timed_out,
            }
        )
    )
    narrow = durable(keyed.drop("diff", "log", "metric_pattern"))
    asked = narrow.select(
        "project", "fingerprint", F.col("claimed_at").alias("ts"),
        F.col("run_id").alias("candidate_id"),
    )
    admitted = admit(asked, results, claims, max_group_rows)
    accepted = admitted.where("accepted").select(
        "project", F.col("candidate_id").alias("run_id")
    )
    ran = durable(narrow.join(accepted, ["project", "run_id"], "left_semi"))

    history = ["project", "objective", "completed_at", "run_id", "metric_value"]
    earlier = results.select(*history, "status", F.lit(False).alias("is_code"))
    arrived = ran.withColumn("metric_value", F.col("metric")).select(
        *history, F.lit(None).cast("string").alias("status"), F.lit(True).alias("is_code")
    )
    decided = keep_discard_replay(earlier.unionByName(arrived)).select(
        "project", "run_id", F.col("decision").alias("status")
    )
    error = decision_error(F.col("timed_out"), F.col("metric"))
    rows = code_results(
        ran.join(decided, ["project", "run_id"]).withColumn("error", error)
    )
    # Diffs of all runs are not shuffled, only of those that ran.
    keys = ran.select("project", "run_id").distinct()
    if diffs_of is None:
        diffs = runs.join(keys, ["project", "run_id"], "left_semi").select("project", "run_id", "diff")
    else:
        diffs = diffs_of(keys)
    fresh = rows.drop("diff").join(diffs, ["project", "run_id"], "left")
    return {
        "admission": admitted,
        "results": as_results(fresh),
        "snapshot": leaderboard_snapshot(
            union_results(as_results(results), rows), contracts
        ),
    }
