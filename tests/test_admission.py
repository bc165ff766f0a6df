from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from helpers import at
from trialframe.operators import admission as a

CANDIDATES = "project string, fingerprint string, ts timestamp, candidate_id long"
RESULTS = "project string, fingerprint string, status string"
CLAIMS = "project string, fingerprint string, claimed_at timestamp, expires_at timestamp"


def admit(spark, candidates, results=(), claims=(), **options):
    df = a.admit(
        spark.createDataFrame([("p", f, at(s), i) for i, (f, s) in enumerate(candidates)], CANDIDATES),
        spark.createDataFrame([("p", f, s) for f, s in results], RESULTS),
        spark.createDataFrame(
            [("p", f, at(s), None if e is None else at(e)) for f, s, e in claims], CLAIMS),
        **options,
    )
    return {r.candidate_id: r.reason for r in df.collect()}


def by_loop(candidates, results, claims):
    done = {f for f, _ in results}
    taken, out = set(), {}
    for i, (f, s) in sorted(enumerate(candidates), key=lambda x: (x[1][1], x[0])):
        leased = any(cf == f and cs <= s and ce is not None and ce > s for cf, cs, ce in claims)
        if f in done:
            out[i] = "completed"
        elif leased or f in taken:
            out[i] = "claimed"
        else:
            taken.add(f)
            out[i] = "accepted"
    return out


def test_any_result_blocks(spark):
    got = admit(spark, [("a", 1), ("b", 1), ("c", 1)], [("a", "failed"), ("b", "discard")])
    assert got == {0: "completed", 1: "completed", 2: "accepted"}


def test_lease_boundaries(spark):
    claims = [("a", 0, 10), ("b", 0, 10.000001), ("c", 10, 20), ("d", 11, 20), ("e", 0, None)]
    got = admit(spark, [(f, 10) for f in "abcde"], claims=claims)
    assert got == {0: "accepted", 1: "claimed", 2: "claimed", 3: "accepted", 4: "accepted"}


def test_one_winner_per_key(spark):
    assert admit(spark, [("a", 5), ("a", 3), ("a", 3)]) == {0: "claimed", 1: "accepted", 2: "claimed"}


@pytest.mark.parametrize("bound", [10**6, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_loop(spark, bound, seed):
    rng = random.Random(seed)
    name = lambda: "hot" if rng.random() < 0.4 else f"f{rng.randrange(20)}"
    candidates = [(name(), rng.randrange(100)) for _ in range(300)]
    results = [(f"f{rng.randrange(20)}", "failed") for _ in range(5)]
    claims = [(name(), s := rng.randrange(100), s + rng.randrange(40)) for _ in range(40)]
    got = admit(spark, candidates, results, claims, max_group_rows=bound)
    assert got == by_loop(candidates, results, claims)


def test_shards_are_disjoint_stable_and_cover_all(spark):
    groups = F.array(*map(F.lit, ["x", "y", "z"]))
    df = spark.range(300).select(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 16).alias("f"))
    shards = df.select("f", a.shard_of(F.col("f"), groups).alias("s"))
    rows = shards.union(shards).distinct().collect()
    assert len(rows) == 300
    sizes = [sum(r.s == g for r in rows) for g in "xyz"]
    assert sum(sizes) == 300 and min(sizes) > 60


def test_existence_by_key(spark):
    candidates = spark.createDataFrame([("p", "a", at(0), 1), ("p", "b", at(0), 2)], CANDIDATES)
    stored = spark.createDataFrame([("p", "a", "failed"), ("p", "a", "keep"), ("q", "b", "keep")], RESULTS)
    assert [r.candidate_id for r in a.completed_candidates(candidates, stored).collect()] == [1]
    assert [r.candidate_id for r in a.novel_candidates(candidates, stored).collect()] == [2]
