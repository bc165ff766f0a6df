from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from helpers import at
from trialframe.operators import leases as l

EVENTS = (
    "project string, fingerprint string, agent_id string, kind string, "
    "ts timestamp, event_id long, ttl_seconds double"
)


def beats(spark, seconds, ttl=60):
    rows = [("a", at(s), i, float(ttl)) for i, s in enumerate(seconds)]
    return spark.createDataFrame(rows, "k string, ts timestamp, beat_id long, ttl_seconds double")


def test_beat_at_expiry_opens_a_new_lease(spark):
    assert l.lease_sessions(beats(spark, [0, 60]), ["k"]).count() == 2
    assert l.lease_sessions(beats(spark, [0, 59.999999]), ["k"]).count() == 1


def test_last_beat_sets_the_end(spark):
    rows = [("a", at(0), 0, 100.0), ("a", at(10), 1, 5.0), ("a", at(15), 2, 5.0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, beat_id long, ttl_seconds double")
    got = [(r.lease_start, r.lease_end, r.beats)
           for r in l.lease_sessions(df, ["k"]).orderBy("lease_start").collect()]
    assert got == [(at(0), at(15), 2), (at(15), at(20), 1)]


def test_live_claims_at_the_boundary(spark):
    df = spark.createDataFrame([("a", at(10)), ("b", at(10.000001)), ("c", None)],
                               "f string, expires_at timestamp")
    assert [r.f for r in l.live_claims(df, F.lit(at(10))).collect()] == ["b"]


def states(spark, rows, now, **options):
    events = [("p", "f", agent, kind, at(s), i, float(ttl))
              for i, (agent, kind, s, ttl) in enumerate(rows)]
    df = l.lease_states(spark.createDataFrame(events, EVENTS), F.lit(at(now)), **options)
    return [(r.agent_id, r.lease_start, r.lease_end, r.beats, r.state)
            for r in df.orderBy("lease_start").collect()]


def test_only_the_owner_refreshes_and_releases(spark):
    got = states(spark, [("a", "claim", 0, 60), ("b", "refresh", 30, 60), ("b", "release", 35, 0),
                         ("a", "refresh", 40, 60), ("a", "release", 50, 0)], 1000)
    assert got == [("a", at(0), at(50), 2, "released")]


def test_expired_open_and_reclaimed(spark):
    got = states(spark, [("a", "claim", 0, 60), ("b", "claim", 60, 60), ("a", "refresh", 70, 60),
                         ("b", "refresh", 100, 60)], 110)
    assert got == [("a", at(0), at(60), 1, "expired"), ("b", at(60), at(160), 2, "open")]


def test_beat_after_expiry_opens_and_after_release_does_not(spark):
    got = states(spark, [("a", "claim", 0, 10), ("a", "refresh", 10, 10), ("a", "release", 15, 0),
                         ("a", "refresh", 16, 10)], 1000)
    assert got == [("a", at(0), at(10), 1, "expired"), ("a", at(10), at(15), 1, "released")]


def test_release_after_expiry_does_not_shorten(spark):
    assert states(spark, [("a", "claim", 0, 10), ("a", "release", 20, 0)], 30) == [
        ("a", at(0), at(10), 1, "expired")]


def test_future_events_are_unknown(spark):
    assert states(spark, [("a", "claim", 0, 60), ("a", "release", 30, 0)], 20) == [
        ("a", at(0), at(60), 1, "open")]


def leases_by_loop(rows):
    """Play the events of one key; claims in the log are accepted ones."""
    out, held, gone = [], None, True
    for agent, kind, s, ttl in rows:
        if kind == "claim":
            if held and not gone:
                out.append((*held, "expired"))
            held, gone = [agent, s, s + ttl, 1], False
        elif held and agent == held[0]:
            if kind == "release":
                if not gone:
                    ended = s < held[2]
                    out.append((held[0], held[1], s if ended else held[2], held[3],
                                "released" if ended else "expired"))
                held = None
            elif s >= held[2]:
                out.append((*held, "expired"))
                held = [agent, s, s + ttl, 1]
            else:
                held[2], held[3] = s + ttl, held[3] + 1
    if held and not gone:
        out.append((*held, "expired"))
    return sorted((a, at(s), at(e), n, state) for a, s, e, n, state in out)


@pytest.mark.parametrize("bound", [10**6, 0])
@pytest.mark.parametrize("seed", range(3))
def test_states_equal_a_loop(spark, bound, seed):
    rng = random.Random(seed)
    rows, s, until, owner = [], 0, 0, None
    for _ in range(300):
        s += rng.randrange(1, 30)
        kind = rng.choice(["claim", "refresh", "refresh", "release"])
        agent = rng.choice("ab")
        ttl = rng.randrange(10, 60)
        if kind == "claim" and s < until:
            continue  # only accepted claims are in the log
        if kind == "claim":
            owner, until = agent, s + ttl
        elif agent == owner and kind == "refresh":
            until = s + ttl
        elif agent == owner and kind == "release":
            until, owner = 0, None
        rows.append((agent, kind, s, ttl))
    got = states(spark, rows, 10**6, max_group_rows=bound)
    assert sorted(got) == leases_by_loop(rows)
