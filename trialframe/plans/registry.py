"""Named queries over the driver tables, each with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` with its equivalent SQL."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


#: The views of plans/tables.py in SQL.
RUNS_SQL = """
runs AS (
  SELECT 'p' || (user_id % 10) AS project,
         CASE WHEN user_id % 2 = 0 THEN 'minimize' ELSE 'maximize' END AS objective,
         CAST(user_id AS VARCHAR) AS agent_id,
         'b' || (user_id % 7) AS branch,
         printf('%012x', event_id) AS run_id,
         CASE event_type WHEN 'click' THEN 'completed' WHEN 'purchase' THEN 'keep'
              WHEN 'view' THEN 'discard' WHEN 'error' THEN 'failed'
              ELSE 'signup' END AS status,
         CASE WHEN event_type <> 'error' THEN value END AS metric_value,
         props AS config, ts AS completed_at, event_id, event_type,
         substr(sha256('{"config":{"k":' || regexp_extract(props, '[0-9]+')
           || '},"objective":"'
           || CASE WHEN user_id % 2 = 0 THEN 'minimize' ELSE 'maximize' END
           || '","project":"p' || (user_id % 10) || '"}'), 1, 16) AS fingerprint
  FROM events),
scored AS (
  SELECT *, CASE WHEN objective = 'maximize' THEN -metric_value
                 ELSE metric_value END AS m FROM runs),
best AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY project, fingerprint
                                 ORDER BY m, run_id) AS rn
    FROM scored WHERE status IN ('completed', 'keep') AND m IS NOT NULL)
  WHERE rn = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY project
                               ORDER BY m, fingerprint) AS rank FROM best),
contracts AS (
  SELECT DISTINCT project AS name, objective FROM runs
  UNION ALL
  SELECT 'p' || count(DISTINCT project), 'minimize' FROM runs),
candidates AS (
  SELECT project, objective, fingerprint, config, completed_at AS ts,
         event_id AS candidate_id
  FROM runs WHERE event_type = 'view'),
finished AS (
  SELECT * FROM runs
  WHERE event_type = 'purchase'),
claims AS (
  SELECT project, fingerprint, max(completed_at) AS claimed_at,
         max(completed_at) + INTERVAL 5 DAY AS expires_at
  FROM runs WHERE event_type = 'signup'
  GROUP BY project, fingerprint),
flagged AS (
  SELECT c.*,
    EXISTS (SELECT 1 FROM finished f WHERE f.project = c.project
            AND f.fingerprint = c.fingerprint) AS done,
    EXISTS (SELECT 1 FROM claims l WHERE l.project = c.project
            AND l.fingerprint = c.fingerprint AND l.claimed_at <= c.ts
            AND l.expires_at > c.ts) AS leased
  FROM candidates c),
admitted AS (
  SELECT *, CASE WHEN done THEN 'completed' WHEN leased THEN 'claimed'
    WHEN row_number() OVER (PARTITION BY project, fingerprint, done, leased
                            ORDER BY ts, candidate_id) = 1 THEN 'accepted'
    ELSE 'claimed' END AS reason FROM flagged)
"""


def with_runs(select: str, recursive: bool = False) -> str:
    """SQL over the views above."""
    head = "WITH RECURSIVE" if recursive else "WITH"
    return f"{head} {RUNS_SQL} {select}"
