"""Machines as parallel scans: transitions, split keys, and the plain fold."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trialframe.streaming import admission as ad
from trialframe.streaming import leases as le
from trialframe.streaming.fold import CHUNK, chunks, fold_in_order

EVENTS = st.lists(
    st.tuples(st.integers(0, 40), st.sampled_from("abc"), st.sampled_from(["claim", "refresh", "release"]), st.integers(0, 12)),
    max_size=25,
)
MEMORY = st.sampled_from([None, 0, 3, 100])
STATES = st.one_of(
    st.just(le.NO_LEASE),
    st.tuples(st.sampled_from("abcd"), st.integers(-20, 0), st.integers(-10, 45), st.integers(1, 9), st.booleans()),
)


def lease_rows(events):
    return [(t, k, who, kind, ttl, None, None, None, False) for k, (t, who, kind, ttl) in enumerate(sorted(events, key=lambda e: e[0]))]


def played(machine, rows, state):
    fold = machine.fold()
    fold.state = state
    out = [x for r in rows for x in fold.row(*r)]
    return fold, out



@settings(max_examples=2000, deadline=None)
@given(EVENTS, MEMORY, STATES)
def test_lease_transition_equals_the_fold(events, memory, state):
    machine, rows = le.LeaseMachine(100, memory), lease_rows(events)
    fold, _ = played(machine, rows, state)
    assert machine.transition(rows).after(state) == fold.state


@settings(max_examples=500, deadline=None)
@given(EVENTS, MEMORY, STATES, st.integers(0, 25), st.integers(0, 25))
def test_lease_transitions_compose(events, memory, state, i, j):
    machine, rows = le.LeaseMachine(100, memory), lease_rows(events)
    i, j = sorted((i, j))
    after = state
    for part in (rows[:i], rows[i:j], rows[j:]):
        after = machine.transition(part).after(after)
    assert after == played(machine, rows, state)[0].state


@settings(max_examples=1000, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 15)), max_size=30), st.one_of(st.none(), st.integers(-5, 70)), st.integers(0, 30))
def test_admission_transitions_compose(asked, until, cut):
    machine = ad.AdmissionMachine()
    rows = [(t, k, ttl, None) for k, (t, ttl) in enumerate(sorted(asked))]
    fold = machine.fold()
    fold.state = until
    for r in rows:
        fold.row(*r)
    assert machine.transition(rows).after(until) == fold.state
    assert machine.transition(rows[cut:]).after(machine.transition(rows[:cut]).after(until)) == fold.state


def busy_log(seed, n):
    """A third of the events are of one key; some keys have a stored state."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        key = ("p", "hot") if k % 3 == 0 else (rng.choice("pq"), f"f{rng.randrange(30)}")
        rows.append((*key, rng.randrange(4 * n), k, rng.choice("abc"), rng.choice(["claim", "refresh", "refresh", "release"]), rng.randrange(1, 60)))
    return rows


@pytest.mark.parametrize("memory", [None, 40])
def test_busy_key_is_played_in_all_chunks_and_equals_the_fold(spark, memory):
    log = busy_log(3, 900)
    schema = "project string, fingerprint string, at long, event_id long, agent_id string, kind string, ttl long, began long, ends long, beats long, live boolean"
    rows = [(*r, None, None, None, False) for r in log]
    rows += [("p", "hot", None, None, "a", "", None, -50, 30, 4, True), (None, "f1", 5, 1, "a", "claim", 10, None, None, None, False)]
    frame = spark.createDataFrame(rows, schema).repartition(5)
    machine = le.LeaseMachine(3000, memory)
    order = ["at", "event_id"]
    got = fold_in_order(frame, le.KEY, order, machine, le._FOLDED, count=8).collect()
    want = []
    for key in {r[:2] for r in rows}:
        own = sorted((r[2:] for r in rows if r[:2] == key), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or 0))
        fold, out = played(machine, own, le.NO_LEASE)
        want += [(*key, *x) for x in out + fold.finish()]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    placed = chunks(frame, le.KEY, order, 8)
    spread = placed.where("fingerprint = 'hot'").groupBy(CHUNK).count().collect()
    assert len(spread) >= 3 and max(r["count"] for r in spread) < 200


def test_busy_key_of_admission_equals_the_fold(spark):
    rng = random.Random(8)
    asked = [("p", "hot" if k % 3 == 0 else f"f{k % 7}", rng.randrange(5000), k, rng.randrange(1, 200)) for k in range(800)]
    frame = spark.createDataFrame(asked, "project string, fingerprint string, at long, candidate_id long, ttl long")
    frame = frame.withColumn("until", F.lit(None).cast("long"))
    got = fold_in_order(frame, ad.KEY, ["at", "candidate_id"], ad.AdmissionMachine(), ad._FOLDED, count=8).collect()
    want = []
    for key in {r[:2] for r in asked}:
        fold = ad.AdmissionFold()
        for r in sorted(r[2:] for r in asked if r[:2] == key):
            want += [(*key, *x) for x in fold.row(*r, None)]
        want += [(*key, *x) for x in fold.finish()]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_plan_deals_rows_by_chunk_not_by_key(spark):
    frame = spark.createDataFrame([("p", "f", 1, 1, 5, None)], "project string, fingerprint string, at long, candidate_id long, ttl long, until long")
    folded = fold_in_order(frame, ad.KEY, ["at", "candidate_id"], ad.AdmissionMachine(), ad._FOLDED, count=4)
    plan = folded._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(project" not in plan and CHUNK in plan
