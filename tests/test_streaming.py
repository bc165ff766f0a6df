"""Streams: golden cases, many micro-batches, and stream equals batch."""

from __future__ import annotations

import random
import uuid

import pytest
from pyspark.sql import functions as F

from helpers import RESULT, at, contract_table, results
from test_leases import EVENTS
from trialframe.operators import leaderboard as lb
from trialframe.operators.decisions import keep_discard_replay
from trialframe.operators.leases import lease_sessions, lease_states
from trialframe.session import session_conf
from trialframe.streaming import feed
from trialframe.streaming.admission import admit_stream
from trialframe.streaming.best import decide_stream
from trialframe.streaming.leaderboard import current_leaderboard, update_leaderboard
from trialframe.streaming.leases import closed_leases, track_leases


def as_stream(spark, tmp_path, batches, schema):
    """One file per micro-batch, in order of their modification times."""
    path = tmp_path / f"in-{uuid.uuid4().hex}"
    for i, rows in enumerate(batches):
        part = str(path / "parts" / str(i))
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(part)
        file = next((path / "parts" / str(i)).glob("*.parquet"))
        (path / f"{i:04d}.parquet").hardlink_to(file)
    return feed.parquet_stream(spark, str(path), spark.createDataFrame([], schema).schema,
                               "*.parquet", files_per_trigger=1)


def random_results(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        project = rng.choice("pppq")
        status = rng.choice(["completed", "keep", "discard", "failed", "odd"])
        metric = None if status == "failed" or rng.random() < 0.05 else float(rng.randrange(60))
        name = "other" if rng.random() < 0.1 else "loss"  # rows of another metric do not rank
        rows.append((project, "minimize" if project == "p" else "maximize",
                     f"f{rng.randrange(40):02d}", f"r{i:04d}", status, name, metric, at(i)))
    return rows


@pytest.mark.parametrize("cuts", [[0, 150], [0, 10, 11, 80, 150]])
def test_leaderboard_after_any_split_equals_batch(spark, tmp_path, cuts):
    rows = random_results(5, cuts[-1])
    batches = [rows[a:b] for a, b in zip(cuts, cuts[1:])]
    terms = contract_table(spark, ("p", "minimize", 4), ("q", "maximize", 6), ("e", "minimize", 3))
    root = str(tmp_path / "board")
    update_leaderboard(as_stream(spark, tmp_path, batches, RESULT), terms, root)
    live = current_leaderboard(spark, root, terms)
    narrow = ("fingerprint", "run_id", "metric_value")
    batch = lb.leaderboard_snapshot(spark.createDataFrame(rows, RESULT), terms, narrow)
    assert sorted(map(repr, live.collect())) == sorted(map(repr, batch.select(live.columns).collect()))


def test_repeated_batch_changes_nothing(spark, tmp_path):
    from trialframe.streaming.leaderboard import merge_results

    root = str(tmp_path / "replay")
    terms = contract_table(spark, ("p", "minimize", 3))
    merge = merge_results(root, terms)
    merge(results(spark, [("p", "minimize", "fa", "r1", "keep", 1.0), ("p", "minimize", "fb", "r2", "keep", 2.0)]), 0)
    second = results(spark, [("p", "minimize", "fb", "r3", "keep", 0.5), ("p", "minimize", "fc", "r4", "discard", 2.0)])
    merge(second, 1)
    merge(second, 1)
    # Batch 1 was merged twice on top of batch 0, and counted once.
    row = current_leaderboard(spark, root, terms).first()
    assert (row.num_completed, row.num_discarded) == (2, 1)
    assert [r.fingerprint for r in row.top_k] == ["fb", "fa"] and row.best.run_id == "r3"


def test_versions_behind_are_removed(spark, tmp_path):
    from trialframe.streaming.leaderboard import merge_results

    root, terms = str(tmp_path / "many"), contract_table(spark, ("p", "minimize", 3))
    merge = merge_results(root, terms)
    for i in range(8):
        merge(results(spark, [("p", "minimize", f"f{i}", f"r{i}", "keep", float(i))]), i)
    assert len(list((tmp_path / "many" / "board" / "versions").iterdir())) <= 4
    assert current_leaderboard(spark, root, terms).first().num_completed == 8


def test_scratch_of_a_micro_batch_is_removed(spark, tmp_path):
    import glob

    from trialframe.session import new_scratch

    held = glob.glob(new_scratch(spark, "x").removeprefix("file:").rsplit("/", 1)[0] + "/*")
    rows = [("p", "f", at(i), i, 10.0) for i in range(5)]
    schema = "project string, fingerprint string, ts timestamp, candidate_id long, ttl_seconds double"
    admit_stream(as_stream(spark, tmp_path, [rows[:2], rows[2:]], schema), str(tmp_path / "a"))
    assert glob.glob(new_scratch(spark, "x").removeprefix("file:").rsplit("/", 1)[0] + "/*") == held


def test_best_on_arrival_equals_batch_in_time_order(spark, tmp_path):
    rng = random.Random(9)
    rows = [("p", "maximize", f"f{i}", f"r{i:04d}", "x", "loss",
             None if rng.random() < 0.1 else rng.randrange(10**5) / 1000, at(i)) for i in range(120)]
    stream = as_stream(spark, tmp_path, [rows[:50], rows[50:51], rows[51:]], RESULT)
    live = decide_stream(stream, str(tmp_path / "best"))
    batch = keep_discard_replay(spark.createDataFrame(rows, RESULT).drop("status"))
    assert live.count() == 120
    assert live.select(batch.columns).exceptAll(batch).count() == 0


def test_results_are_kept_once_and_late_ones_dropped(spark, tmp_path):
    row = lambda i, s: ("p", "minimize", "f", f"r{i}", "keep", "loss", 1.0, at(s))
    batches = [[row(1, 0), row(1, 0), row(2, 10_000)], [row(2, 10_000), row(3, 20_000)], [row(4, 1), row(5, 19_000)]]
    once = feed.deduplicated(as_stream(spark, tmp_path, batches, RESULT), delay="1 hour")
    got = feed.drain_to_table(once, str(tmp_path / "out"))
    assert sorted(r.run_id for r in got.collect()) == ["r1", "r2", "r3", "r5"]


def test_closed_leases_equal_batch_up_to_the_watermark(spark, tmp_path):
    rng = random.Random(2)
    times = sorted(rng.randrange(3000) for _ in range(120)) + [4000]
    rows = [(f"k{rng.randrange(3)}", at(s), i, 60.0) for i, s in enumerate(times)]
    rows += [("edge", at(0), 1000, 60.0), ("edge", at(60), 1001, 60.0)]
    rows.sort(key=lambda r: r[1])
    schema = "k string, ts timestamp, beat_id long, ttl_seconds double"
    stream = as_stream(spark, tmp_path, [rows[:40], rows[40:90], rows[90:]], schema)
    live = feed.drain_to_table(closed_leases(stream, ["k"], "0 seconds"), str(tmp_path / "leases"))
    batch = lease_sessions(spark.createDataFrame(rows, schema), ["k"]).where(F.col("lease_end") <= F.lit(at(4000)))
    assert sorted(live.collect()) == sorted(batch.select(live.columns).collect())
    assert live.where("k = 'edge'").count() == 2


def track(spark, tmp_path, batches, **options):
    stream = as_stream(spark, tmp_path, batches, EVENTS)
    out = track_leases(stream, str(tmp_path / f"t{uuid.uuid4().hex}"), **options)
    return sorted((r.fingerprint, r.agent_id, r.lease_start, r.lease_end, r.beats, r.state) for r in out.collect())


def test_tracker_golden(spark, tmp_path):
    event = lambda i, f, a, kind, s, ttl=60.0: ("p", f, a, kind, at(s), i, ttl)
    batches = [
        [event(1, "f", "a", "claim", 0), event(2, "f", "b", "claim", 1), event(3, "f", "b", "refresh", 5)],
        [event(4, "f", "a", "refresh", 30), event(5, "f", "b", "release", 40), event(6, "g", "c", "claim", 50)],
        [event(7, "f", "a", "release", 60), event(8, "g", "c", "refresh", 110)],
        [event(9, "z", "z", "claim", 1000)],
        [event(10, "f", "a", "claim", 20), event(11, "z", "z", "release", 1001)],
    ]
    assert track(spark, tmp_path, batches) == [
        ("f", "a", at(0), at(60), 2, "released"),
        ("f", "a", at(20), None, 0, "late"),
        ("g", "c", at(50), at(110), 1, "expired"),
        ("g", "c", at(110), at(170), 1, "expired"),
        ("z", "z", at(1000), at(1001), 1, "released"),
    ]


def test_tracker_forgets_expired_leases_when_asked(spark, tmp_path):
    event = lambda i, f, kind, s: ("p", f, "a", kind, at(s), i, 60.0)
    batches = [[event(1, "f", "claim", 0)], [event(2, "z", "claim", 100)], [event(3, "z", "claim", 400)],
               [event(4, "f", "refresh", 401)], [event(5, "z", "claim", 1000)]]
    kept = track(spark, tmp_path, batches)
    assert ("f", "a", at(401), at(461), 1, "expired") in kept
    gone = track(spark, tmp_path, batches, memory_seconds=200)
    assert [r for r in gone if r[0] == "f"] == [("f", "a", at(0), at(60), 1, "expired")]


def test_tracker_equals_batch_states(spark, tmp_path):
    rng = random.Random(4)
    rows, until, owner, s = [], {}, {}, 0
    for i in range(150):
        s += rng.randrange(1, 12)
        f, agent, kind, ttl = rng.choice("fgh"), rng.choice("ab"), rng.choice(
            ["claim", "refresh", "refresh", "release"]), rng.randrange(10, 60)
        if kind == "claim" and s < until.get(f, 0):
            continue
        if kind == "claim":
            owner[f], until[f] = agent, s + ttl
        elif owner.get(f) == agent and kind == "refresh":
            until[f] = s + ttl
        elif owner.get(f) == agent and kind == "release":
            until[f], owner[f] = 0, None
        rows.append(("p", f, agent, kind, at(s), i, float(ttl)))
    rows.append(("p", "end", "a", "claim", at(s + 10_000), 999, 5.0))
    live = track(spark, tmp_path, [rows[:30], rows[30:31], rows[31:100], rows[100:]])
    batch = lease_states(spark.createDataFrame(rows, EVENTS), F.lit(at(s + 10_000))).where("state <> 'open'")
    assert live == sorted((r.fingerprint, r.agent_id, r.lease_start, r.lease_end, r.beats, r.state)
                          for r in batch.collect())


def test_admission_on_arrival(spark, tmp_path):
    schema = "project string, fingerprint string, ts timestamp, candidate_id long, ttl_seconds double"
    row = lambda i, f, s: ("p", f, at(s), i, 10.0)
    batches = [[row(1, "a", 0), row(2, "a", 5), row(3, "b", 5)], [row(4, "a", 9.999999), row(5, "a", 10), row(6, "b", 14)]]
    out = admit_stream(as_stream(spark, tmp_path, batches, schema), str(tmp_path / "admitted"))
    assert {r.candidate_id: r.reason for r in out.collect()} == {
        1: "accepted", 2: "claimed", 3: "accepted", 4: "claimed", 5: "accepted", 6: "claimed"}


ORDERS = {"ascending": lambda r: r, "descending": lambda r: r[::-1], "shuffled": lambda r: random.Random(8).sample(r, len(r))}


@pytest.mark.parametrize("order", ORDERS)
@pytest.mark.parametrize("size", [5, 10_000])
def test_tracker_and_admission_ignore_arrival_order_and_batch_size(spark, tmp_path, order, size):
    rng = random.Random(11)
    events = [("p", "f", rng.choice("ab"), rng.choice(["claim", "refresh", "release"]), at(i), i, 3.0) for i in range(60)]
    asked = [("p", "f", at(i), i, 10.0) for i in range(30)]
    schema = "project string, fingerprint string, ts timestamp, candidate_id long, ttl_seconds double"
    with session_conf(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(size)):
        live = track(spark, tmp_path, [ORDERS[order](events)])
        out = admit_stream(as_stream(spark, tmp_path, [ORDERS[order](asked)], schema), str(tmp_path / "a")).collect()
    assert live == track(spark, tmp_path, [events])
    assert sorted(r.candidate_id for r in out if r.reason == "accepted") == [0, 10, 20] and len(out) == 30


def test_tracker_uses_the_last_beats_own_ttl(spark, tmp_path):
    events = [("p", "f", "a", "claim", at(0), 1, 36_000.0), ("p", "f", "a", "refresh", at(3600), 2, 3600.0),
              ("p", "z", "a", "claim", at(90_000), 3, 5.0)]
    assert track(spark, tmp_path, [events]) == [("f", "a", at(0), at(7200), 2, "expired")]


def test_result_files_stream(spark, tmp_path):
    import json

    record = {"project": "p", "fingerprint": "f", "run_id": "r", "metric_value": 1, "completed_at": 1.5,
              "config": {"a": 1}}
    source = tmp_path / "files"
    source.mkdir()
    for i in range(3):
        (source / f"f__{i}.json").write_text(json.dumps({**record, "run_id": f"r{i}"}, indent=2))
    (source / "f__9.json.1.tmp").write_text("{")
    got = feed.drain_to_table(feed.result_stream(spark, str(source), 1), str(tmp_path / "out")).collect()
    assert sorted((r.run_id, r.completed_at.microsecond, json.loads(r.config)["a"]) for r in got) == [
        (f"r{i}", 500000, 1) for i in range(3)]
