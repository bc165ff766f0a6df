"""Queries on sweeps and user functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialframe.functions.fingerprints import config_fingerprint
from trialframe.operators import evaluation as e
from trialframe.operators import sweep as s
from trialframe.operators.leaderboard import leaderboard_snapshot
from trialframe.operators.rounds import config_round
from trialframe.plans.registry import query, with_runs
from trialframe.plans.tables import (
    candidates, claims, contracts, finished, runs, table,
)

THRESHOLDS = list(range(100, 5001, 100))


@query("sweep_accuracy", """
SELECT CAST(t.threshold AS INTEGER) AS threshold,
       count(*) FILTER ((d.n_chars > t.threshold) = (l.quality = 1)) AS hits,
       count(*) AS n
FROM labels l JOIN documents d USING (doc_id)
CROSS JOIN range(100, 5001, 100) t(threshold)
GROUP BY 1""")
def sweep_accuracy(spark, sf_dir):
    labelled = table(spark, sf_dir, "labels").select("doc_id", "quality").join(
        table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id"
    )
    return s.sweep_thresholds(labelled, "n_chars", "quality", THRESHOLDS)


@query("sweep_mae", """
SELECT CAST(g.a AS INTEGER) AS a,
  CAST(sum(abs(CAST(round(l_extendedprice * 1000) AS BIGINT)
    - g.a * CAST(l_quantity AS BIGINT) * CAST(round(p_retailprice * 100) AS BIGINT)))
    AS BIGINT) AS error,
  count(*) AS n
FROM lineitem JOIN part ON p_partkey = l_partkey CROSS JOIN range(5, 16) g(a)
GROUP BY 1""")
def sweep_mae(spark, sf_dir):
    priced = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_quantity", "l_extendedprice"
    ).join(
        table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"),
        F.col("l_partkey") == F.col("p_partkey"),
    )
    actual = F.round(F.col("l_extendedprice") * 1000).cast("bigint")
    base = F.col("l_quantity").cast("bigint") * F.round(
        F.col("p_retailprice") * 100
    ).cast("bigint")
    data = priced.select(actual.alias("actual"), base.alias("base"))

    def measures(point):
        guess = F.lit(point["a"]) * F.col("base")
        return {
            "error": F.sum(F.abs(F.col("actual") - guess)),
            "n": F.count("*"),
        }

    return s.sweep_aggregate(data, [{"a": a} for a in range(5, 16)], measures)


def configs(spark, sf_dir):
    """The distinct configs tried in each project."""
    return runs(spark, sf_dir).select(
        "project", "objective", "fingerprint", "config"
    ).distinct()


_CONFIGS = with_runs("""
, configs AS (
  SELECT DISTINCT project, objective, fingerprint, config,
         CAST(regexp_extract(config, '[0-9]+') AS BIGINT) AS k FROM runs)
""")


@query("grid_seeds", _CONFIGS + """
SELECT project, fingerprint, CAST(seed AS INTEGER) AS seed
FROM configs CROSS JOIN (VALUES (7), (13), (21), (42)) AS pool(seed)""")
def grid_seeds(spark, sf_dir):
    tried = configs(spark, sf_dir).select("project", "fingerprint")
    return s.expand_seeds(tried, contracts(spark, sf_dir))


@query("grid_parameters", _CONFIGS + """
SELECT project, fingerprint, lr, CAST(depth AS INTEGER) AS depth
FROM configs CROSS JOIN (VALUES (0.5::DOUBLE), (0.25::DOUBLE)) AS x(lr)
CROSS JOIN (VALUES (2), (4), (8)) AS y(depth)""")
def grid_parameters(spark, sf_dir):
    tried = configs(spark, sf_dir).select("project", "fingerprint")
    return s.expand_grid(tried, {"lr": [0.5, 0.25], "depth": [2, 4, 8]})


def score(config, prior):
    """A stand-in for a user's evaluation; some configs crash."""
    k = config["k"]
    if k % 10 == 0:
        raise ValueError(f"bad k {k}")
    return {
        "metric_name": "value",
        "metric_value": (k * 37 % 101) / 4,
        "status": "completed",
        "artifact_payload": {"k": k},
    }


_SCORE = "CASE WHEN k % 10 <> 0 THEN (k * 37 % 101) / 4.0::DOUBLE END"


@query("sweep_python", _CONFIGS + f"""
SELECT project, fingerprint,
  CASE WHEN k % 10 = 0 THEN 'failed' ELSE 'completed' END AS status,
  {_SCORE} AS metric_value,
  CASE WHEN k % 10 = 0 THEN 'ValueError: bad k ' || k END AS error,
  CASE WHEN k % 10 <> 0 THEN CAST(k AS VARCHAR) END AS artifact_k
FROM configs""")
def sweep_python(spark, sf_dir):
    return e.evaluate_configs(configs(spark, sf_dir), score).select(
        "project", "fingerprint", "status", "metric_value", "error",
        F.col("artifact_payload")["k"].alias("artifact_k"),
    )


@query("config_results", _CONFIGS + f"""
SELECT project, objective, fingerprint, config,
  CASE WHEN k % 10 = 0 THEN 'failed' ELSE 'completed' END AS status,
  'value' AS metric_name, {_SCORE} AS metric_value,
  CASE WHEN k % 10 = 0 THEN 'ValueError: bad k ' || k END AS error
FROM configs""")
def config_results(spark, sf_dir):
    """Evaluated configs as rows of the results table."""
    evaluated = e.evaluate_configs(configs(spark, sf_dir), score)
    return e.config_results(evaluated, contracts(spark, sf_dir)).select(
        "project", "objective", "fingerprint", "config", "status", "metric_name",
        "metric_value", "error",
    )


def improve(config, prior):
    """Evaluation that looks at the best earlier runs."""
    best = prior[0]["metric_value"] if prior else 0.0
    return {
        "metric_name": "value",
        "metric_value": best + config["k"] + 1000.0 * len(prior),
        "status": "completed",
    }


@query("sweep_with_history", _CONFIGS + """
SELECT c.project, c.fingerprint, r.metric_value + c.k + 10000.0 AS metric_value
FROM configs c JOIN ranked r ON r.project = c.project AND r.rank = 1""")
def sweep_with_history(spark, sf_dir):
    snapshot = leaderboard_snapshot(runs(spark, sf_dir), contracts(spark, sf_dir))
    asked = e.with_history(configs(spark, sf_dir), snapshot)
    return e.evaluate_configs(asked, improve).select(
        "project", "fingerprint", "metric_value"
    )


def tens_only(config):
    """User rewrite: configs with the same tens digit are the same."""
    return {"k": config["k"] // 10 * 10}


@query("canonicalize_udf", with_runs("""
SELECT run_id, substr(sha256('{"config":{"k":'
    || (CAST(regexp_extract(config, '[0-9]+') AS BIGINT) // 10 * 10)
    || '},"objective":"' || objective || '","project":"' || project || '"}'), 1, 16)
  AS fingerprint
FROM runs"""))
def canonicalize_udf(spark, sf_dir):
    rewritten = e.canonicalize_configs(
        runs(spark, sf_dir).select("run_id", "project", "objective", "config"), tens_only
    )
    return rewritten.select(
        "run_id",
        config_fingerprint(
            F.col("config"), F.col("objective"), F.col("project")
        ).alias("fingerprint"),
    )


def weigh(config, prior):
    """Evaluation that looks at a reduction of all earlier runs."""
    seen = prior[0]
    return {
        "metric_name": "value",
        "metric_value": seen["best"] + config["k"] + 1000.0 * seen["n_failed"] + seen["n_discarded"],
        "status": "completed",
    }


@query("sweep_with_reduction", _CONFIGS + """
SELECT c.project, c.fingerprint,
       h.best + c.k + 1000.0 * h.n_failed + h.n_discarded AS metric_value
FROM configs c JOIN (
  SELECT project, max(metric_value) AS best,
         count(*) FILTER (status = 'failed') AS n_failed,
         count(*) FILTER (status = 'discard') AS n_discarded
  FROM runs GROUP BY project) h ON h.project = c.project""")
def sweep_with_reduction(spark, sf_dir):
    """The evaluation sees counts over all results, failed and discarded too."""
    def reduce(results):
        return results.groupBy("project").agg(
            F.max("metric_value").alias("best"),
            F.count_if(F.col("status") == "failed").alias("n_failed"),
            F.count_if(F.col("status") == "discard").alias("n_discarded"),
        )

    asked = e.with_reduced_history(configs(spark, sf_dir), runs(spark, sf_dir), reduce)
    return e.evaluate_configs(asked, weigh).select(
        "project", "fingerprint", "metric_value"
    )


def recall(config, prior):
    """Evaluation that reads every earlier run of its own config, in order."""
    last, n_failed, n = 0.0, 0, 0
    for result in prior:
        n += 1
        n_failed += result["status"] == "failed"
        if result["metric_value"] is not None:
            last = result["metric_value"]
    return {"metric_name": "value", "metric_value": last + 1000.0 * n_failed + n, "status": "completed"}


@query("sweep_own_history", _CONFIGS + """
SELECT project, fingerprint,
       coalesce(arg_max(metric_value, (completed_at, run_id)) FILTER (metric_value IS NOT NULL), 0.0)
         + 1000.0 * count(*) FILTER (status = 'failed') + count(*) AS metric_value
FROM runs GROUP BY project, fingerprint""")
def sweep_own_history(spark, sf_dir):
    """The evaluation sees all results of its own config, failed ones too."""
    done = e.evaluate_with_own_history(configs(spark, sf_dir), runs(spark, sf_dir), recall)
    return done.select("project", "fingerprint", "metric_value")


@query("sweep_round", with_runs(f"""
, fresh AS (
  SELECT project, objective, fingerprint,
         {_SCORE} AS metric_value, k % 10 = 0 AS failed
  FROM (SELECT *, CAST(regexp_extract(config, '[0-9]+') AS BIGINT) AS k
        FROM admitted WHERE reason = 'accepted')),
together AS (
  SELECT project, objective, fingerprint, metric_value, failed FROM fresh
  UNION ALL SELECT project, objective, fingerprint, metric_value, false FROM finished),
places AS (
  SELECT *, row_number() OVER (PARTITION BY project
      ORDER BY CASE objective WHEN 'maximize' THEN -metric_value ELSE metric_value END,
               fingerprint) AS place
  FROM together WHERE NOT failed)
SELECT c.name AS project,
  (SELECT count(DISTINCT fingerprint) FROM together t
   WHERE t.project = c.name AND NOT failed) AS num_completed,
  (SELECT count(*) FROM together t WHERE t.project = c.name AND failed) AS num_failed,
  (SELECT fingerprint FROM places p WHERE p.project = c.name AND place = 1)
    AS best_fingerprint,
  (SELECT metric_value FROM places p WHERE p.project = c.name AND place = 1)
    AS best_metric
FROM contracts c"""))
def sweep_round(spark, sf_dir):
    """Admit late views, evaluate the accepted ones, rank them with the rest."""
    outcome = config_round(
        candidates(spark, sf_dir), finished(spark, sf_dir), claims(spark, sf_dir),
        contracts(spark, sf_dir), score,
    )
    return outcome["snapshot"].select(
        "project", "num_completed", "num_failed",
        F.col("best.fingerprint").alias("best_fingerprint"),
        F.col("best.metric_value").alias("best_metric"),
    )
