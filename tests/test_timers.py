"""Leases in keyed state: timers, changing ttl, micro-batches."""

from __future__ import annotations

import random

import pytest
from pyspark.errors import StreamingQueryException

from helpers import at
from test_streaming import as_stream
from trialframe.operators.leases import lease_sessions
from trialframe.session import session_conf
from trialframe.streaming import feed
from trialframe.streaming.leases import closed_leases
from trialframe.streaming.timers import TIMER_STATE, timed_leases

BEATS = "key string, ts timestamp, beat_id long, ttl_seconds int"


def drained(spark, tmp_path, batches, delay="0 seconds"):
    stream = as_stream(spark, tmp_path, batches, BEATS)
    with session_conf(spark, **TIMER_STATE):
        leases = feed.drain_to_table(timed_leases(stream, ["key"], delay), str(tmp_path / "out"))
    return sorted(tuple(r) for r in leases.collect())


def test_end_is_the_last_beats_own(spark, tmp_path):
    """Ten hours, then one: the lease ends two hours in, in the stream as in the batch."""
    rows = [("a", at(0), 1, 36_000), ("a", at(3600), 2, 3600), ("b", at(50_000), 3, 60)]
    got = drained(spark, tmp_path, [rows])
    batch = lease_sessions(spark.createDataFrame(rows, BEATS), ["key"]).where("key = 'a'").collect()
    assert got == [("a", at(0), at(7200), 2)] == [tuple(batch[0][c] for c in ("key", "lease_start", "lease_end", "beats"))]


def test_idle_key_ends_when_the_watermark_passes(spark, tmp_path):
    """Key a has one beat in the first micro-batch and never another event."""
    batches = [[("a", at(0), 1, 100)], [("b", at(99), 2, 1000)], [("b", at(200), 3, 1000)], [("b", at(250), 4, 1000)]]
    assert drained(spark, tmp_path, batches) == [("a", at(0), at(100), 1)]


def test_boundary_and_late_beats(spark, tmp_path):
    batches = [
        [("a", at(0), 1, 100), ("a", at(100), 2, 100), ("c", at(300), 3, 10)],
        [("c", at(305), 4, 5)],
        [("a", at(5), 5, 1000)],  # behind the watermark: dropped
        [("c", at(1000), 6, 10)],
    ]
    assert drained(spark, tmp_path, batches) == [
        ("a", at(0), at(100), 1), ("a", at(100), at(200), 1), ("c", at(300), at(310), 2),
    ]


@pytest.mark.parametrize("size", [1000, 40])
def test_stream_equals_batch(spark, tmp_path, size):
    rng = random.Random(size)
    rows = sorted(
        ((rng.choice("aaabcdef"), at(rng.randrange(20_000)), k, rng.choice([60, 300, 900])) for k in range(200)),
        key=lambda r: r[1],
    )
    rows.append(("z", at(100_000), 1000, 60))
    got = drained(spark, tmp_path, [rows[i : i + size] for i in range(0, len(rows), size)])
    want = lease_sessions(spark.createDataFrame(rows, BEATS), ["key"]).where("key <> 'z'")
    assert got == sorted(tuple(r) for r in want.select("key", "lease_start", "lease_end", "beats").collect())


def test_session_windows_refuse_a_changed_ttl(spark, tmp_path):
    rows = [("a", at(0), 1, 36_000), ("a", at(3600), 2, 3600), ("b", at(90_000), 3, 60)]
    leases = closed_leases(as_stream(spark, tmp_path, [rows], BEATS), ["key"], "0 seconds")
    with pytest.raises(StreamingQueryException, match="ttl changed"):
        feed.drain_to_table(leases, str(tmp_path / "out"))
