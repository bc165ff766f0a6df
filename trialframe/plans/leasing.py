"""Queries on leases, admission and shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialframe.operators import admission as a
from trialframe.operators import decisions as d
from trialframe.operators import leases as l
from trialframe.plans.registry import query, with_runs
from trialframe.plans.tables import (
    beats, candidates, claims, contracts, finished, runs,
)
from trialframe.session import new_scratch
from trialframe.store import TrialStore

_AS_OF = "2024-01-15"
_EARLY = "2024-01-05"


def moment(text: str):
    return F.lit(text).cast("timestamp_ntz")


@query("live_claims", with_runs(f"""
SELECT project, agent_id, run_id, completed_at + INTERVAL 21600 SECOND AS expires_at
FROM runs WHERE completed_at <= TIMESTAMP '{_AS_OF}'
  AND completed_at + INTERVAL 21600 SECOND > TIMESTAMP '{_AS_OF}'"""))
def live_claims(spark, sf_dir):
    made = runs(spark, sf_dir).where(F.col("completed_at") <= moment(_AS_OF)).select(
        "project", "agent_id", "run_id", F.col("completed_at").alias("claimed_at")
    )
    held = l.claim_rows(made, contracts(spark, sf_dir))
    return l.live_claims(held, moment(_AS_OF)).select(
        "project", "agent_id", "run_id", "expires_at"
    )


SESSIONS_SQL = """
WITH marked AS (
  SELECT user_id, ts, event_id,
    CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (
  SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id
    ROWS UNBOUNDED PRECEDING) AS lease FROM marked),
leases AS (
  SELECT user_id, min(ts) AS lease_start, max(ts) + INTERVAL 6 HOUR AS lease_end,
         count(*) AS beats
  FROM numbered GROUP BY user_id, lease)
"""


@query("lease_sessions", SESSIONS_SQL + "SELECT * FROM leases")
def lease_sessions(spark, sf_dir):
    return l.lease_sessions(beats(spark, sf_dir), ["user_id"])


@query("lease_sessions_chunked", SESSIONS_SQL + "SELECT * FROM leases")
def lease_sessions_chunked(spark, sf_dir):
    """The same leases on the path for very busy keys."""
    return l.lease_sessions(beats(spark, sf_dir), ["user_id"], max_group_rows=0)


def lease_log(results):
    """Clicks claim, purchases release, every other event refreshes."""
    kind = (
        F.when(F.col("event_type") == "click", l.CLAIM)
        .when(F.col("event_type") == "purchase", l.RELEASE)
        .otherwise(l.REFRESH)
    )
    return results.select(
        "project", "fingerprint",
        F.concat(F.lit("a"), F.col("event_id") % 3).alias("agent_id"),
        kind.alias("kind"), F.col("completed_at").alias("ts"), "event_id",
        F.lit(3 * 86_400).alias("ttl_seconds"),
    )


_CUT = f" WHERE completed_at <= TIMESTAMP '{_AS_OF}'"
_LEASE_LOG = f"""
, log AS (
  SELECT project, fingerprint, 'a' || (event_id % 3) AS agent_id, completed_at AS ts,
    event_id, completed_at + INTERVAL 3 DAY AS expires,
    CASE event_type WHEN 'click' THEN 'claim' WHEN 'purchase' THEN 'release'
         ELSE 'refresh' END AS kind
  FROM runs{_CUT}),
episodes AS (
  SELECT *, sum(CASE WHEN kind = 'claim' THEN 1 ELSE 0 END) OVER (
    PARTITION BY project, fingerprint ORDER BY ts, event_id
    ROWS UNBOUNDED PRECEDING) AS episode FROM log),
owned AS (
  SELECT *, coalesce(agent_id = first_value(agent_id) OVER w AND episode > 0, false)
      AS owner
  FROM episodes
  WINDOW w AS (PARTITION BY project, fingerprint, episode ORDER BY ts, event_id)),
valid AS (
  SELECT * FROM (
    SELECT *, coalesce(sum(CASE WHEN owner AND kind = 'release' THEN 1 ELSE 0 END) OVER (
      PARTITION BY project, fingerprint, episode ORDER BY ts, event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS released
    FROM owned WHERE owner)
  WHERE released = 0)
"""


@query("lease_event_effects", with_runs(_LEASE_LOG.replace(_CUT, "") + """
SELECT l.project, l.fingerprint, l.event_id, v.event_id IS NOT NULL AS effective
FROM log l LEFT JOIN valid v ON v.event_id = l.event_id"""))
def lease_event_effects(spark, sf_dir):
    return l.event_effects(lease_log(runs(spark, sf_dir)))


_LEASES = _LEASE_LOG + """
, marked AS (
  SELECT *, CASE WHEN kind = 'claim' THEN 1
    WHEN kind = 'refresh' AND ts >= max(CASE WHEN kind <> 'release' THEN expires END)
      OVER (PARTITION BY project, fingerprint, episode ORDER BY ts, event_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1
    ELSE 0 END AS opens FROM valid),
numbered AS (
  SELECT *, sum(opens) OVER (PARTITION BY project, fingerprint ORDER BY ts, event_id
    ROWS UNBOUNDED PRECEDING) AS lease FROM marked),
leases AS (
  SELECT project, fingerprint, min(agent_id) AS agent_id,
    min(ts) FILTER (kind <> 'release') AS lease_start,
    max(expires) FILTER (kind <> 'release') AS expires,
    min(ts) FILTER (kind = 'release') AS released_at,
    count(*) FILTER (kind <> 'release') AS beats
  FROM numbered GROUP BY project, fingerprint, lease)
"""


@query("lease_states", with_runs(_LEASES + f"""
SELECT project, fingerprint, agent_id, lease_start,
  CASE WHEN released_at < expires THEN released_at ELSE expires END AS lease_end, beats,
  CASE WHEN released_at < expires THEN 'released'
       WHEN expires <= TIMESTAMP '{_AS_OF}' THEN 'expired' ELSE 'open' END AS state
FROM leases"""))
def lease_states(spark, sf_dir):
    return l.lease_states(lease_log(runs(spark, sf_dir)), moment(_AS_OF))


@query("store_admission", with_runs(_LEASES + f"""
, live AS (
  SELECT project, fingerprint, lease_start, expires FROM leases
  WHERE NOT coalesce(released_at < expires, false) AND expires > TIMESTAMP '{_AS_OF}'),
judged AS (
  SELECT c.project, c.fingerprint, c.completed_at AS ts, c.event_id AS candidate_id,
    EXISTS (SELECT 1 FROM runs f WHERE f.event_type = 'purchase' AND f.project = c.project
            AND f.fingerprint = c.fingerprint AND f.completed_at < TIMESTAMP '{_EARLY}') AS done,
    EXISTS (SELECT 1 FROM live v WHERE v.project = c.project AND v.fingerprint = c.fingerprint
            AND v.lease_start <= c.completed_at AND v.expires > c.completed_at) AS leased
  FROM runs c WHERE c.event_type = 'view' AND c.completed_at >= TIMESTAMP '{_AS_OF}')
SELECT project, fingerprint, candidate_id,
  CASE WHEN done THEN 'completed' WHEN leased THEN 'claimed'
    WHEN row_number() OVER (PARTITION BY project, fingerprint, done, leased
                            ORDER BY ts, candidate_id) = 1 THEN 'accepted'
    ELSE 'claimed' END AS reason
FROM judged"""))
def store_admission(spark, sf_dir):
    """A store's life: claims, refreshes, releases and results are written, then candidates asked."""
    store = TrialStore(spark, new_scratch(spark, "store"), contracts(spark, sf_dir))
    log = lease_log(runs(spark, sf_dir)).withColumns(
        {"event_id": F.format_string("%012x", "event_id"), "ts": F.col("ts").cast("timestamp"),
         "ttl_seconds": F.col("ttl_seconds").cast("double")}
    )
    store.record_lease_events(log)
    done = finished(spark, sf_dir).where(F.col("completed_at") < moment(_EARLY))
    store.write_results(d.as_results(done))
    asked = candidates(spark, sf_dir).where(F.col("ts") >= moment(_AS_OF))
    decided = store.admit(
        asked.withColumn("ts", F.col("ts").cast("timestamp")), F.lit(_AS_OF).cast("timestamp")
    )
    return decided.select("project", "fingerprint", "candidate_id", "reason")


@query("completed_semi", with_runs("""
SELECT project, fingerprint, candidate_id FROM flagged WHERE done"""))
def completed_semi(spark, sf_dir):
    return a.completed_candidates(
        candidates(spark, sf_dir), finished(spark, sf_dir)
    ).select("project", "fingerprint", "candidate_id")


@query("novel_candidates", with_runs("""
SELECT project, fingerprint, candidate_id FROM flagged WHERE NOT done"""))
def novel_candidates(spark, sf_dir):
    return a.novel_candidates(
        candidates(spark, sf_dir), finished(spark, sf_dir)
    ).select("project", "fingerprint", "candidate_id")


ADMISSION_SQL = with_runs("""
SELECT project, fingerprint, ts, candidate_id, reason = 'accepted' AS accepted, reason
FROM admitted""")


@query("admission", ADMISSION_SQL)
def admission(spark, sf_dir):
    return a.admit(
        candidates(spark, sf_dir), finished(spark, sf_dir), claims(spark, sf_dir)
    )


@query("admission_chunked", ADMISSION_SQL)
def admission_chunked(spark, sf_dir):
    """The same decisions on the path for very frequent fingerprints."""
    return a.admit(
        candidates(spark, sf_dir), finished(spark, sf_dir), claims(spark, sf_dir),
        max_group_rows=0,
    )


@query("shard_assign", with_runs("""
SELECT run_id, fingerprint,
  ['explore', 'exploit', 'features', 'ensemble'][
    CAST(('0x' || substr(fingerprint, 1, 8))::BIGINT % 4 + 1 AS INTEGER)]
    AS search_group
FROM runs"""))
def shard_assign(spark, sf_dir):
    groups = F.array(*map(F.lit, ("explore", "exploit", "features", "ensemble")))
    grouped = contracts(spark, sf_dir).withColumn("search_groups", groups)
    return a.assign_shards(
        runs(spark, sf_dir).select("project", "run_id", "fingerprint"), grouped
    ).drop("project")


@query("skipped_outcomes", with_runs("""
SELECT project, fingerprint, 'skipped' AS status, reason
FROM admitted WHERE reason <> 'accepted'"""))
def skipped_outcomes(spark, sf_dir):
    return d.skipped_outcomes(admission(spark, sf_dir))
