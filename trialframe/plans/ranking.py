"""Leaderboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialframe.functions.objective import better, stored_metric
from trialframe.operators import leaderboard as lb
from trialframe.operators.decisions import as_results, union_results
from trialframe.operators.evaluation import override
from trialframe.plans.registry import query, with_runs
from trialframe.plans.tables import contracts, runs, table


@query("rankable", with_runs("""
SELECT project, run_id, status FROM runs WHERE status IN ('completed', 'keep')"""))
def rankable(spark, sf_dir):
    return lb.rankable(runs(spark, sf_dir)).select("project", "run_id", "status")


_BEST = with_runs("""
SELECT project, fingerprint, run_id, metric_value FROM best""")


@query("best_per_fingerprint", _BEST)
def best_per_fingerprint(spark, sf_dir):
    return lb.best_per_fingerprint(runs(spark, sf_dir)).select(
        "project", "fingerprint", "run_id", "metric_value"
    )


@query("best_per_fingerprint_agg", _BEST)
def best_per_fingerprint_agg(spark, sf_dir):
    return lb.best_per_fingerprint_agg(runs(spark, sf_dir)).select(
        "project", "fingerprint", "run_id", "metric_value"
    )


@query("sorted_results", with_runs("""
SELECT project, fingerprint, run_id, metric_value, agent_id FROM best
ORDER BY project, m, fingerprint"""))
def sorted_results(spark, sf_dir):
    return lb.sorted_results(runs(spark, sf_dir)).select(
        "project", "fingerprint", "run_id", "metric_value", "agent_id"
    )


@query("leaderboard_topk", with_runs("""
SELECT project, CAST(rank AS INTEGER) AS rank, fingerprint, run_id, metric_value,
       agent_id
FROM ranked WHERE rank <= 10"""))
def leaderboard_topk(spark, sf_dir):
    return lb.ranked(runs(spark, sf_dir), 10).select(
        "project", "rank", "fingerprint", "run_id", "metric_value", "agent_id"
    )


@query("project_topk", with_runs("""
SELECT fingerprint, run_id, metric_value FROM ranked
WHERE project = 'p3' AND rank <= 10"""))
def project_topk(spark, sf_dir):
    return lb.top_of_project(runs(spark, sf_dir), "p3", 10).select(
        "fingerprint", "run_id", "metric_value"
    )


@query("leaderboard_best", with_runs("""
SELECT c.name AS project, c.objective, r.fingerprint, r.run_id, r.metric_value
FROM contracts c LEFT JOIN ranked r ON r.project = c.name AND r.rank = 1"""))
def leaderboard_best(spark, sf_dir):
    return lb.best_rows(runs(spark, sf_dir), contracts(spark, sf_dir)).select(
        "project", "objective", "fingerprint", "run_id", "metric_value"
    )


@query("leaderboard_full_rows", with_runs("""
SELECT project, CAST(rank AS INTEGER) AS rank, fingerprint, run_id, config, branch
FROM ranked WHERE rank <= 10"""))
def leaderboard_full_rows(spark, sf_dir):
    results = runs(spark, sf_dir)
    narrow = lb.ranked(lb.ranking_view(results), 10)
    return lb.full_rows(narrow, results).select(
        "project", "rank", "fingerprint", "run_id", "config", "branch"
    )


@query("status_counts", with_runs("""
SELECT project,
       count(DISTINCT CASE WHEN status IN ('completed', 'keep')
                            AND metric_value IS NOT NULL THEN fingerprint END)
         AS num_completed,
       count(*) FILTER (status = 'discard') AS num_discarded,
       count(*) FILTER (status = 'failed') AS num_failed,
       count(*) FILTER (status IN ('completed', 'keep') AND metric_value IS NULL)
         AS num_unrankable
FROM runs GROUP BY project"""))
def status_counts(spark, sf_dir):
    return lb.status_counts(runs(spark, sf_dir))


SNAPSHOT_SQL = with_runs("""
SELECT c.name AS project, 'value' AS metric, c.objective,
  (SELECT count(*) FROM best b WHERE b.project = c.name) AS num_completed,
  (SELECT count(*) FROM runs r WHERE r.project = c.name AND status = 'discard')
    AS num_discarded,
  (SELECT count(*) FROM runs r WHERE r.project = c.name AND status = 'failed')
    AS num_failed,
  coalesce((SELECT string_agg(rank || ' ' || fingerprint || ' ' || run_id, ','
                              ORDER BY rank)
            FROM ranked r WHERE r.project = c.name AND rank <= 10), '') AS top_k,
  (SELECT run_id FROM ranked r WHERE r.project = c.name AND rank = 1) AS best_run_id,
  (SELECT metric_value FROM ranked r WHERE r.project = c.name AND rank = 1)
    AS best_metric
FROM contracts c""")


def flat_snapshot(snapshot):
    """A snapshot with its nested rows as text."""
    line = lambda row: F.concat_ws(
        " ", row["rank"].cast("string"), row["fingerprint"], row["run_id"]
    )
    best = F.col("best")
    return snapshot.select(
        "project", "metric", "objective",
        "num_completed", "num_discarded", "num_failed",
        F.array_join(F.transform("top_k", line), ",").alias("top_k"),
        best["run_id"].alias("best_run_id"),
        best["metric_value"].alias("best_metric"),
    )


@query("leaderboard_snapshot", SNAPSHOT_SQL.replace("""
FROM contracts c""", """,
  (SELECT config FROM ranked r WHERE r.project = c.name AND rank = 1) AS best_config,
  coalesce((SELECT string_agg(agent_id || ' ' || config, ',' ORDER BY rank)
            FROM ranked r WHERE r.project = c.name AND rank <= 10), '') AS records
FROM contracts c"""))
def leaderboard_snapshot(spark, sf_dir):
    """Counters, ranked rows and best, with fields of the whole records."""
    board = lb.leaderboard_snapshot(runs(spark, sf_dir), contracts(spark, sf_dir))
    record = lambda row: F.concat_ws(" ", row["agent_id"], row["config"])
    fields = board.select(
        "project", F.col("best.config").alias("best_config"),
        F.array_join(F.transform("top_k", record), ",").alias("records"),
    )
    return flat_snapshot(board).join(fields, "project")


@query("baseline_delta", with_runs("""
, ranking AS (
  SELECT *, row_number() OVER (PARTITION BY project
                               ORDER BY completed_at, run_id) AS at
  FROM scored WHERE status IN ('completed', 'keep') AND m IS NOT NULL)
SELECT f.project, f.run_id AS baseline_run_id, f.metric_value AS baseline_metric,
       b.metric_value AS best_metric, f.m - b.m AS improvement
FROM ranking f JOIN ranked b ON b.project = f.project AND b.rank = 1
WHERE f.at = 1"""))
def baseline_delta(spark, sf_dir):
    return lb.baseline_delta(runs(spark, sf_dir))


@query("with_contract", with_runs("""
SELECT r.project, r.run_id, c.objective, 'value' AS metric,
       CAST(21600 AS INTEGER) AS claim_ttl_seconds,
       CAST(10 AS INTEGER) AS leaderboard_limit
FROM runs r JOIN contracts c ON c.name = r.project"""))
def with_contract(spark, sf_dir):
    return lb.with_contract(runs(spark, sf_dir), contracts(spark, sf_dir)).select(
        "project", "run_id", "objective", "metric", "claim_ttl_seconds",
        "leaderboard_limit",
    )


@query("result_artifact", with_runs("""
SELECT r.agent_id, r.run_id, r.status,
       CASE WHEN r.status IN ('completed', 'keep')
            THEN r.agent_id || '/' || r.run_id END AS artifact_path
FROM runs r"""))
def result_artifact(spark, sf_dir):
    results = runs(spark, sf_dir)
    artifacts = lb.rankable(results).select(
        "agent_id", "run_id", F.concat_ws("/", "agent_id", "run_id").alias("artifact_path")
    )
    return lb.result_artifacts(
        results.select("agent_id", "run_id", "status"), artifacts
    )


@query("artifact_merge", with_runs("""
SELECT agent_id, run_id, CAST(4 AS INTEGER) AS n_keys, 'user' AS metric_name,
       config, branch AS note
FROM runs"""))
def artifact_merge(spark, sf_dir):
    base = F.create_map(
        F.lit("run_id"), F.col("run_id"), F.lit("metric_name"), F.col("metric_name"),
        F.lit("config"), F.col("config"),
    )
    own = F.create_map(
        F.lit("metric_name"), F.lit("user"), F.lit("note"), F.col("branch")
    )
    merged = override(base, own)
    return runs(spark, sf_dir).select(
        "agent_id", "run_id", F.size(merged).alias("n_keys"),
        merged["metric_name"].alias("metric_name"),
        merged["config"].alias("config"), merged["note"].alias("note"),
    )


@query("union_shapes", with_runs("""
SELECT project, run_id, status, metric_value,
       CASE status WHEN 'failed' THEN 'Oops: no metric' WHEN 'signup' THEN 'timeout' END
         AS error,
       CASE WHEN status IN ('keep', 'discard') THEN config END AS description,
       CASE WHEN status = 'completed' THEN run_id || '.json' END AS artifact_path
FROM runs"""))
def union_shapes(spark, sf_dir):
    results = runs(spark, sf_dir)
    common = ["project", "run_id", "status"]
    of = lambda *names: results.where(F.col("status").isin(*names))
    success = of("completed").select(
        *common, "metric_value", F.concat("run_id", F.lit(".json")).alias("artifact_path")
    )
    failure = of("failed").select(
        *common, "metric_value", F.lit("Oops: no metric").alias("error")
    )
    timeout = of("signup").select(*common, "metric_value", F.lit("timeout").alias("error"))
    decided = of("keep", "discard").select(
        *common, "metric_value", F.col("config").alias("description")
    )
    return as_results(union_results(success, failure, timeout, decided)).select(
        *common, "metric_value", "error", "description", "artifact_path"
    )


@query("better_pairs", """
SELECT event_id, CASE WHEN user_id % 2 = 0 THEN value < event_id % 100
                      ELSE value > event_id % 100 END AS is_better
FROM events""")
def better_pairs(spark, sf_dir):
    objective = F.when(F.col("user_id") % 2 == 0, "minimize").otherwise("maximize")
    other = (F.col("event_id") % 100).cast("double")
    return table(spark, sf_dir, "events").select(
        "event_id", better(objective, F.col("value"), other).alias("is_better")
    )


@query("metric_round", """
SELECT event_id, round(value / 3.0, 6) AS metric_value FROM events""")
def metric_round(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", stored_metric(F.col("value") / 3.0).alias("metric_value")
    )
