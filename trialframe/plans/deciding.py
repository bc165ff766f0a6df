"""Queries on code runs: logs, classification, replay, diffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialframe.functions.fingerprints import has_changes
from trialframe.functions.logs import DEFAULT_METRIC_PATTERN, log_metric
from trialframe.functions.text import keep_message
from trialframe.operators import decisions as d
from trialframe.operators.rounds import code_round
from trialframe.plans.registry import query, with_runs
from trialframe.plans.tables import claims, contracts, diffs, finished, logs, runs, table


@query("log_metric", """
SELECT event_id, TRY_CAST(nullif(regexp_extract(
  'loss x' || chr(10) || 'metric_value:  ' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR)
  || chr(10), '(?m)^metric_value:\\s+([0-9.]+)', 1), '') AS DOUBLE) AS metric
FROM events""")
def metric_of_log(spark, sf_dir):
    return logs(spark, sf_dir).select("event_id", log_metric(F.col("log")).alias("metric"))


def _code_runs(spark, sf_dir):
    """Logs as code runs: every 11th timed out, every 5th has no best yet."""
    event = F.col("event_id")
    objective = F.when(F.col("user_id") % 2 == 0, "minimize").otherwise("maximize")
    printed = F.when(F.col("event_type") != "error", log_metric(F.col("log")))
    return d.classify_runs(
        logs(spark, sf_dir).select(
            F.lit("code").alias("project"), objective.alias("objective"),
            F.lpad(F.lower(F.hex(event)), 12, "0").alias("run_id"),
            F.substring(F.sha2(event.cast("string"), 256), 1, 16).alias("fingerprint"),
            F.concat(F.lit("a"), F.col("user_id").cast("string")).alias("agent_id"),
            F.lit("value").alias("metric_name"),
            F.lit("c0").alias("base_commit"),
            F.concat(F.lit("c"), event.cast("string")).alias("new_commit"),
            (event % 11 == 0).alias("timed_out"),
            printed.alias("metric"),
            F.when(event % 5 != 0, F.lit(20.0)).alias("best_metric"),
        )
    )


_CODE = """
WITH code AS (
  SELECT printf('%012x', event_id) AS run_id, 'a' || user_id AS agent_id, event_id,
    substr(sha256(CAST(event_id AS VARCHAR)), 1, 16) AS fingerprint,
    CASE WHEN event_type <> 'error' THEN value END AS metric,
    event_id % 11 = 0 AS timed_out,
    event_id % 5 = 0 OR CASE WHEN user_id % 2 = 0 THEN value < 20
                             ELSE value > 20 END AS is_better
  FROM events),
classified AS (
  SELECT *, CASE WHEN timed_out OR metric IS NULL THEN 'failed'
                 WHEN is_better THEN 'keep' ELSE 'discard' END AS status,
    CASE WHEN timed_out THEN 'timeout'
         WHEN metric IS NULL THEN 'metric not found in log' END AS error
  FROM code)
"""


@query("classify_runs", _CODE + """
SELECT run_id, status, error,
       CASE WHEN status <> 'failed' THEN metric END AS metric_value,
       CASE status WHEN 'keep' THEN 'c' || event_id WHEN 'discard' THEN 'c0' END
         AS new_commit
FROM classified""")
def classify_runs(spark, sf_dir):
    return d.code_results(_code_runs(spark, sf_dir)).select(
        "run_id", "status", "error", "metric_value", "new_commit"
    )


@query("outcomes", _CODE + """
SELECT 'code' AS project, fingerprint, run_id, status,
       CASE error WHEN 'timeout' THEN 'timeout'
                  WHEN 'metric not found in log' THEN 'metric_not_found' END AS reason,
       CAST(NULL AS VARCHAR) AS error,
       CASE WHEN status <> 'failed' THEN 'value' END AS metric_name,
       CASE WHEN status <> 'failed' THEN metric END AS metric_value
FROM classified""")
def outcomes(spark, sf_dir):
    return d.outcomes(_code_runs(spark, sf_dir))


@query("keep_messages", _CODE + """
SELECT run_id, 'agent ' || agent_id || ' [main]: value=' || printf('%.6f', metric)
       || ' keep — run ' || run_id AS message
FROM classified WHERE status = 'keep'""")
def keep_messages(spark, sf_dir):
    kept = _code_runs(spark, sf_dir).where("status = 'keep'")
    return kept.select(
        "run_id",
        keep_message(
            F.col("agent_id"), F.lit("main"), F.col("metric_name"), F.col("metric"),
            F.concat(F.lit("run "), F.col("run_id")),
        ).alias("message"),
    )


def _history(spark, sf_dir):
    """Every event as a code run (errors have no metric); its own status is not used."""
    return runs(spark, sf_dir).drop("status")


REPLAY_SQL = with_runs("""
, priors AS (
  SELECT *, min(round(m, 6)) OVER (PARTITION BY project ORDER BY completed_at, run_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p
  FROM scored)
SELECT project, run_id, completed_at, metric_value,
       CASE WHEN objective = 'maximize' THEN -p ELSE p END AS prior_best,
       CASE WHEN m IS NULL THEN 'failed' WHEN p IS NULL OR m < p THEN 'keep'
            ELSE 'discard' END AS decision
FROM priors""")


@query("keep_discard_replay", REPLAY_SQL)
def keep_discard_replay(spark, sf_dir):
    return d.keep_discard_replay(_history(spark, sf_dir))


@query("keep_discard_chunked", REPLAY_SQL)
def keep_discard_chunked(spark, sf_dir):
    """The same replay in far smaller buckets, as for very large projects."""
    return d.keep_discard_replay(_history(spark, sf_dir), bucket_seconds=60)


@query("best_so_far", with_runs("""
, priors AS (
  SELECT *, min(round(m, 6)) OVER (PARTITION BY project ORDER BY completed_at, run_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p
  FROM scored)
SELECT project, run_id, completed_at,
       CASE WHEN objective = 'maximize' THEN -p ELSE p END AS best_metric
FROM priors"""))
def best_so_far(spark, sf_dir):
    return d.best_so_far(_history(spark, sf_dir))


@query("diff_dedup", """
SELECT 'docs' AS project, substr(sha256(text), 1, 16) AS fingerprint,
       min(doc_id) AS first_run_id, count(*) AS n_runs
FROM documents WHERE regexp_matches(text, '\\S') GROUP BY 2""")
def diff_dedup(spark, sf_dir):
    keyed = diffs(spark, sf_dir).where(has_changes(F.col("text"))).drop("text")
    return d.diff_groups(keyed)


@query("code_round", with_runs("""
, offered AS (
  SELECT 'p' || (e.user_id % 10) AS project,
    CASE WHEN e.user_id % 2 = 0 THEN 'minimize' ELSE 'maximize' END AS objective,
    printf('%012x', e.event_id) AS run_id, e.event_id, e.ts,
    substr(sha256(d.text), 1, 16) AS fingerprint, sha256(d.text) AS diff_hash,
    e.event_id % 11 = 0 AS timed_out,
    CASE WHEN e.event_id % 11 <> 0 THEN e.value END AS metric_value
  FROM events e JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents)
  WHERE regexp_matches(d.text, '\\S')),
ran AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY project, fingerprint
                                 ORDER BY ts, run_id) AS turn FROM offered)
  WHERE turn = 1),
history AS (
  SELECT project, objective, run_id, ts + INTERVAL 1 DAY AS completed_at,
         metric_value, round(metric_value, 6) AS prior, true AS is_code, timed_out, diff_hash
  FROM ran
  UNION ALL
  SELECT project, objective, run_id, completed_at, metric_value, metric_value,
         false, false, NULL
  FROM finished),
costed AS (
  SELECT *, CASE objective WHEN 'maximize' THEN -metric_value ELSE metric_value END AS m,
    min(CASE objective WHEN 'maximize' THEN -prior ELSE prior END) OVER (
      PARTITION BY project ORDER BY completed_at, run_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
  FROM history)
SELECT project, run_id, metric_value,
  CASE WHEN metric_value IS NULL THEN 'failed' WHEN best IS NULL OR m < best THEN 'keep'
       ELSE 'discard' END AS status,
  CASE WHEN timed_out THEN 'timeout' END AS error, diff_hash
FROM costed WHERE is_code"""))
def code_runs_round(spark, sf_dir):
    """Documents as diffs, tried in turn by all events, each with its log."""
    documents = table(spark, sf_dir, "documents")
    many = documents.count()
    tried = logs(spark, sf_dir).select(
        (F.col("event_id") % many).alias("doc_id"),
        F.concat(F.lit("p"), F.col("user_id") % 10).alias("project"),
        F.lpad(F.lower(F.hex("event_id")), 12, "0").alias("run_id"),
        F.col("user_id").cast("string").alias("agent_id"),
        "log", (F.col("event_id") % 11 == 0).alias("timed_out"),
        F.col("ts").alias("claimed_at"),
        (F.col("ts") + F.expr("INTERVAL '1' DAY")).alias("completed_at"),
        F.lit("c0").alias("base_commit"), F.lit("c1").alias("new_commit"),
    )
    texts = documents.select("doc_id", F.col("text").alias("diff"))
    offered = tried.join(texts, "doc_id").drop("doc_id")

    def diffs_of(keys):
        """Runs meet the keys before they get texts."""
        asked = tried.join(keys, ["project", "run_id"], "left_semi")
        return asked.join(texts, "doc_id").select("project", "run_id", "diff")

    terms = contracts(spark, sf_dir).withColumn("metric_pattern", F.lit(DEFAULT_METRIC_PATTERN))
    outcome = code_round(offered, finished(spark, sf_dir), claims(spark, sf_dir), terms, diffs_of=diffs_of)
    return outcome["results"].select(
        "project", "run_id", "metric_value", "status", "error",
        F.sha2("diff", 256).alias("diff_hash"),
    )
