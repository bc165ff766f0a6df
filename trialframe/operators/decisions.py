"""Code runs: classification, keep/discard replay, best so far, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialframe.functions.objective import (
    better, cost, is_rankable, metric_of, stored_metric,
)
from trialframe.operators.ordered import running_in_buckets, time_bucket
from trialframe.schemas import COMPLETED, DISCARD, FAILED, KEEP, RESULT_SCHEMA

# Stored error texts and the reasons given to the caller.
TIMEOUT = "timeout"
NO_METRIC_STORED = "metric not found in log"
NO_METRIC_REASON = "metric_not_found"

#: Seconds of history that a task plays of a project at once.
BUCKET_SECONDS = 3_600


def decide(
    objective: Column, timed_out: Column, metric: Column, best: Column
) -> Column:
    """Status of a code run; a timeout outranks a printed metric."""
    return (
        F.when(timed_out, FAILED)
        .when(metric.isNull(), FAILED)
        .when(best.isNull() | better(objective, metric, best), KEEP)
        .otherwise(DISCARD)
    )


def decision_error(timed_out: Column, metric: Column) -> Column:
    """Stored error of a code run; NULL for keep and discard."""
    return F.when(timed_out, TIMEOUT).when(metric.isNull(), NO_METRIC_STORED)


def classify_runs(runs: DataFrame) -> DataFrame:
    """Add status and error to (objective, timed_out, metric, best_metric)."""
    timed_out, metric = F.coalesce("timed_out", F.lit(False)), F.col("metric")
    return runs.withColumns(
        {
            "status": decide(
                F.col("objective"), timed_out, metric, F.col("best_metric")
            ),
            "error": decision_error(timed_out, metric),
        }
    )


def code_results(classified: DataFrame) -> DataFrame:
    """Result rows of code runs: failed rows without, others with a metric.

    A kept run records ``new_commit``; any other keeps the base commit.  Only
    keep and discard rows carry new_commit at all.
    """
    ran = F.col("status") != FAILED
    rows = classified.withColumns(
        {
            "metric_value": F.when(ran, stored_metric(F.col("metric"))),
            "new_commit": F.when(
                ran,
                F.when(F.col("status") == KEEP, F.col("new_commit")).otherwise(
                    F.col("base_commit")
                ),
            ),
        }
    )
    return as_results(rows)


def as_results(rows: DataFrame) -> DataFrame:
    """Any of the result shapes on the superset schema (absent → NULL)."""
    return rows.select(
        *[
            F.col(field.name).cast(field.dataType).alias(field.name)
            if field.name in rows.columns
            else F.lit(None).cast(field.dataType).alias(field.name)
            for field in RESULT_SCHEMA.fields
        ]
    )


def union_results(*shapes: DataFrame) -> DataFrame:
    """Result tables of different shapes as one set."""
    first, *others = shapes
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def outcomes(results: DataFrame) -> DataFrame:
    """What the caller of a run is told: status, reason, error, metric.

    With a column ``metric`` (the metric as read, before rounding for storage)
    that value is reported, otherwise the stored one.
    """
    told = F.col("metric" if "metric" in results.columns else "metric_value")
    failed = F.col("status") == FAILED
    code_failure = failed & F.col("error").isin(TIMEOUT, NO_METRIC_STORED)
    ran = ~failed
    return results.select(
        "project", "fingerprint", "run_id", "status",
        F.when(failed & (F.col("error") == NO_METRIC_STORED), NO_METRIC_REASON)
        .when(failed & (F.col("error") == TIMEOUT), TIMEOUT)
        .alias("reason"),
        F.when(failed & ~F.coalesce(code_failure, F.lit(False)), F.col("error"))
        .alias("error"),
        F.when(ran, F.col("metric_name")).alias("metric_name"),
        F.when(ran, told).alias("metric_value"),
    )


def skipped_outcomes(admitted: DataFrame) -> DataFrame:
    """Outcome rows of candidates that admission refused."""
    return admitted.where(F.col("reason") != "accepted").select(
        "project", "fingerprint", F.lit("skipped").alias("status"), "reason"
    )


def _prior(stored_scale: int | None) -> Column:
    # A discarded code run is never better than the best before it, so all code
    # runs may stand in the running minimum.  Config rows count if rankable.
    counts = F.col("is_code") | is_rankable(F.col("status"))
    m = F.col("m")
    if stored_scale is not None:
        m = F.when(F.col("is_code"), stored_metric(m, stored_scale)).otherwise(m)
    return F.when(counts, m)


def _costed(history: DataFrame) -> DataFrame:
    rows = history.withColumn("m", cost(F.col("objective"), F.col("metric_value")))
    if "is_code" not in rows.columns:
        rows = rows.withColumn("is_code", F.lit(True))
    if "status" not in rows.columns:
        rows = rows.withColumn("status", F.lit(None).cast("string"))
    return rows.select(
        "project", "objective", "completed_at", "run_id", "m", "is_code", "status"
    )


def _with_best(
    history: DataFrame, stored_scale: int | None, bucket_seconds: int, include_current: bool
) -> DataFrame:
    rows = _costed(history)
    bucket = time_bucket(F.col("completed_at"), rows.schema["completed_at"].dataType, bucket_seconds)
    return running_in_buckets(
        rows, ["project"], ["completed_at", "run_id"], bucket, "_best", "min", _prior(stored_scale), include_current
    )


def keep_discard_replay(
    history: DataFrame,
    stored_scale: int | None = 6,
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """Replay each project's history and decide every code run again.

    ``history``: project, objective, completed_at, run_id, metric_value and
    optionally is_code, status.  A run is kept when strictly better than the
    best earlier stored metric; stored code metrics are rounded.  A project is
    played in buckets of ``bucket_seconds``, whatever its size; the width changes
    no result.
    """
    best = F.col("_best")
    decision = (
        F.when(F.col("m").isNull(), FAILED)
        .when(best.isNull() | (F.col("m") < best), KEEP)
        .otherwise(DISCARD)
    )
    return (
        _with_best(history, stored_scale, bucket_seconds, include_current=False)
        .where("is_code")
        .select(
            "project", "run_id", "completed_at",
            metric_of(F.col("objective"), F.col("m")).alias("metric_value"),
            metric_of(F.col("objective"), best).alias("prior_best"),
            decision.alias("decision"),
        )
    )


def best_so_far(
    history: DataFrame,
    stored_scale: int | None = 6,
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """Best stored metric of each project after each run."""
    return _with_best(history, stored_scale, bucket_seconds, include_current=True).select(
        "project", "run_id", "completed_at",
        metric_of(F.col("objective"), F.col("_best")).alias("best_metric"),
    )


def diff_groups(diffs: DataFrame) -> DataFrame:
    """One row per (project, fingerprint) of non-empty diffs: the first run.

    ``diffs``: project, run_id, fingerprint.  The texts stay behind: key them
    with text_fingerprint() first and drop the column.
    """
    return diffs.groupBy("project", "fingerprint").agg(
        F.min("run_id").alias("first_run_id"), F.count("*").alias("n_runs")
    )


__all__ = [
    "COMPLETED", "as_results", "best_so_far", "classify_runs", "code_results",
    "decide", "decision_error", "diff_groups", "keep_discard_replay", "outcomes",
    "skipped_outcomes", "union_results",
]
