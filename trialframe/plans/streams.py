"""Streaming queries, drained to the end of the driver table."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialframe.plans.deciding import REPLAY_SQL
from trialframe.plans.leasing import SESSIONS_SQL, lease_log
from trialframe.plans.ranking import SNAPSHOT_SQL, flat_snapshot
from trialframe.plans.registry import query, with_runs
from trialframe.plans.tables import LEASE_TTL, contracts, runs_of, table
from trialframe.session import new_scratch, session_conf
from trialframe.streaming import feed
from trialframe.streaming.admission import admit_stream
from trialframe.streaming.best import decide_stream
from trialframe.streaming.leaderboard import current_leaderboard, update_leaderboard
from trialframe.streaming.leases import (
    MERGE_BEFORE_SHUFFLE, closed_leases, track_leases,
)
from trialframe.streaming.timers import TIMER_STATE, timed_leases


def _events(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return feed.parquet_stream(spark, sf_dir, schema, "events.parquet")


def _timed(stream, column):
    """Watermarks need a timestamp with time zone semantics."""
    return stream.withColumn(column, F.col(column).cast("timestamp"))


def _local(column):
    return F.col(column).cast("timestamp_ntz").alias(column)


@query("stream_results_dedup", with_runs("""
SELECT project, run_id, status FROM runs"""))
def stream_results_dedup(spark, sf_dir):
    """Each result is delivered twice and kept once."""
    results = _timed(runs_of(_events(spark, sf_dir)), "completed_at")
    twice = results.withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2))))
    once = feed.deduplicated(twice).select("project", "run_id", "status")
    return feed.drain_to_table(once, new_scratch(spark, "stream-results"))


@query("stream_lease_sessions", SESSIONS_SQL + """
SELECT * FROM leases
WHERE lease_end - INTERVAL 1 MICROSECOND
      <= (SELECT date_trunc('millisecond', max(ts)) FROM events)""")
def stream_lease_sessions(spark, sf_dir):
    """Leases that have ended by the last beat of the stream."""
    beats = _timed(_events(spark, sf_dir), "ts").select(
        "user_id", "ts", F.lit(LEASE_TTL).alias("ttl_seconds")
    )
    closed = closed_leases(beats, ["user_id"], "0 seconds")
    with session_conf(spark, **MERGE_BEFORE_SHUFFLE):
        leases = feed.drain_to_table(closed, new_scratch(spark, "stream-leases"))
    return leases.select("user_id", _local("lease_start"), _local("lease_end"), "beats")


@query("stream_lease_timers", """
WITH beats AS (
  SELECT user_id, ts, event_id, ts + CASE WHEN event_id % 3 = 0 THEN INTERVAL 10 HOUR
    ELSE INTERVAL 1 HOUR END AS expires FROM events),
marked AS (
  SELECT *, CASE WHEN ts < lag(expires) OVER w THEN 0 ELSE 1 END AS opens
  FROM beats WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (
  SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id
    ROWS UNBOUNDED PRECEDING) AS lease FROM marked)
SELECT user_id, min(ts) AS lease_start, arg_max(expires, (ts, event_id)) AS lease_end, count(*) AS beats
FROM numbered GROUP BY user_id, lease
HAVING arg_max(expires, (ts, event_id)) <= (SELECT date_trunc('millisecond', max(ts)) FROM events)""")
def stream_lease_timers(spark, sf_dir):
    """Leases that end by their last beat's own ttl, let out by timers."""
    ttl = F.when(F.col("event_id") % 3 == 0, 36_000).otherwise(3_600).alias("ttl_seconds")
    beats = _timed(_events(spark, sf_dir), "ts").select("user_id", "ts", ttl)
    with session_conf(spark, **TIMER_STATE):
        leases = feed.drain_to_table(
            timed_leases(beats, ["user_id"], "0 seconds"), new_scratch(spark, "stream-timers")
        )
    return leases.select("user_id", _local("lease_start"), _local("lease_end"), "beats")


@query("stream_lease_tracker", with_runs("""
, log AS (
  SELECT project, fingerprint, 'a' || (event_id % 3) AS agent_id, completed_at AS ts,
    completed_at + INTERVAL 3 DAY AS expires,
    CASE event_type WHEN 'click' THEN 'claim' WHEN 'purchase' THEN 'release'
         ELSE 'refresh' END AS kind,
    row_number() OVER (PARTITION BY project, fingerprint
                       ORDER BY completed_at, event_id) AS place
  FROM runs),
step AS (
  SELECT project, fingerprint, CAST(0 AS BIGINT) AS place,
    CAST(NULL AS VARCHAR) AS agent, CAST(NULL AS TIMESTAMP) AS began,
    CAST(NULL AS TIMESTAMP) AS ends, CAST(0 AS BIGINT) AS beats, false AS live,
    CAST(NULL AS VARCHAR) AS out_agent, CAST(NULL AS TIMESTAMP) AS out_start,
    CAST(NULL AS TIMESTAMP) AS out_end, CAST(0 AS BIGINT) AS out_beats,
    CAST(NULL AS VARCHAR) AS out_state
  FROM log WHERE place = 1
  UNION ALL
  SELECT project, fingerprint, place,
    CASE WHEN takes THEN v_agent WHEN gives THEN NULL ELSE agent END,
    CASE WHEN takes OR renews THEN ts WHEN gives THEN NULL ELSE began END,
    CASE WHEN takes OR renews OR extends THEN expires WHEN gives THEN NULL ELSE ends END,
    CASE WHEN takes OR renews THEN 1 WHEN extends THEN beats + 1 ELSE beats END,
    CASE WHEN takes OR renews THEN true WHEN gives THEN false ELSE now_live END,
    CASE WHEN lapsed OR (gives AND now_live) THEN agent END,
    CASE WHEN lapsed OR (gives AND now_live) THEN began END,
    CASE WHEN lapsed THEN ends WHEN gives AND now_live THEN ts END,
    CASE WHEN lapsed OR (gives AND now_live) THEN beats ELSE 0 END,
    CASE WHEN lapsed THEN 'expired' WHEN gives AND now_live THEN 'released' END
  FROM (
    SELECT *, kind = 'claim' AND NOT now_live AS takes,
      kind = 'refresh' AND owner AND now_live AS extends,
      kind = 'refresh' AND owner AND NOT now_live AS renews,
      kind = 'release' AND owner AS gives
    FROM (
      SELECT s.project, s.fingerprint, v.place, s.agent, s.began, s.ends, s.beats,
        v.agent_id AS v_agent, v.ts, v.expires, v.kind,
        s.live AND s.ends > v.ts AS now_live, s.live AND s.ends <= v.ts AS lapsed,
        coalesce(s.agent = v.agent_id, false) AS owner
      FROM step s JOIN log v ON v.project = s.project
        AND v.fingerprint = s.fingerprint AND v.place = s.place + 1))),
final AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY project, fingerprint
                                 ORDER BY place DESC) AS back FROM step)
  WHERE back = 1 AND live
    AND ends <= (SELECT max(ts) FROM log))
SELECT project, fingerprint, out_agent AS agent_id, out_start AS lease_start,
       out_end AS lease_end, out_beats AS beats, out_state AS state
FROM step WHERE out_state IS NOT NULL
UNION ALL
SELECT project, fingerprint, agent, began, ends, beats, 'expired' FROM final""",
    recursive=True))
def stream_lease_tracker(spark, sf_dir):
    """Leases as they are released or expire, with ownership."""
    log = _timed(lease_log(runs_of(_events(spark, sf_dir))), "ts")
    tracked = track_leases(log, new_scratch(spark, "stream-tracker"))
    return tracked.select(
        "project", "fingerprint", "agent_id", _local("lease_start"),
        _local("lease_end"), "beats", "state",
    )


@query("stream_leaderboard", SNAPSHOT_SQL)
def stream_leaderboard(spark, sf_dir):
    root = new_scratch(spark, "stream-leaderboard")
    terms = contracts(spark, sf_dir)
    update_leaderboard(runs_of(_events(spark, sf_dir)), terms, root)
    return flat_snapshot(current_leaderboard(spark, root, terms))


@query("stream_best", REPLAY_SQL)
def stream_best(spark, sf_dir):
    return decide_stream(runs_of(_events(spark, sf_dir)), new_scratch(spark, "stream-best"))


@query("stream_admission", with_runs("""
, asked AS (
  SELECT project, fingerprint, completed_at AS ts, event_id AS candidate_id,
    row_number() OVER (PARTITION BY project, fingerprint
                       ORDER BY completed_at, event_id) AS place
  FROM runs WHERE event_type = 'view'),
following AS (
  SELECT a.project, a.fingerprint, a.place, a.candidate_id,
    min(b.place) FILTER (b.ts >= a.ts + INTERVAL 3 DAY) AS next_place
  FROM asked a JOIN asked b USING (project, fingerprint) GROUP BY ALL),
won AS (
  SELECT project, fingerprint, place, candidate_id, next_place
  FROM following WHERE place = 1
  UNION ALL
  SELECT f.project, f.fingerprint, f.place, f.candidate_id, f.next_place
  FROM won w JOIN following f ON f.project = w.project
    AND f.fingerprint = w.fingerprint AND f.place = w.next_place)
SELECT a.project, a.fingerprint, a.candidate_id,
       CASE WHEN w.place IS NULL THEN 'claimed' ELSE 'accepted' END AS reason
FROM asked a LEFT JOIN won w USING (project, fingerprint, place)""", recursive=True))
def stream_admission(spark, sf_dir):
    """Every view asks for its config; a win holds it for three days."""
    asked = runs_of(_events(spark, sf_dir)).where("event_type = 'view'").select(
        "project", "fingerprint", F.col("completed_at").cast("timestamp").alias("ts"),
        F.col("event_id").alias("candidate_id"), F.lit(3 * 86_400).alias("ttl_seconds"),
    )
    return admit_stream(asked, new_scratch(spark, "stream-admission"))
