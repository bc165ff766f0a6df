from __future__ import annotations

import random

import pytest
from pyspark.errors import PySparkException

from helpers import board_by_loop, contract_table, results
from trialframe.operators import leaderboard as lb


def top(df):
    return [(r.fingerprint, r.run_id) for r in df.orderBy("rank").collect()]


@pytest.mark.parametrize("objective", ["minimize", "maximize"])
def test_ties_go_to_lower_fingerprint_and_run(spark, objective):
    rows = [
        ("p", objective, "fb", "r3", "completed", 1.0),
        ("p", objective, "fa", "r2", "keep", 1.0),
        ("p", objective, "fa", "r1", "completed", 1.0),
    ]
    assert top(lb.ranked(results(spark, rows), 10)) == [("fa", "r1"), ("fb", "r3")]


def test_better_duplicate_replaces_the_first(spark):
    rows = [
        ("p", "maximize", "fa", "r1", "completed", 1.0),
        ("p", "maximize", "fa", "r2", "completed", 2.0),
    ]
    df = results(spark, rows)
    assert top(lb.ranked(df, 10)) == [("fa", "r2")]
    assert lb.best_per_fingerprint_agg(df).first().run_id == "r2"


def test_unknown_status_null_and_nan(spark):
    rows = [
        ("p", "minimize", "fa", "r1", "mystery", 0.0),
        ("p", "minimize", "fb", "r2", "completed", None),
        ("p", "minimize", "fc", "r3", "keep", float("nan")),
        ("p", "minimize", "fd", "r4", "completed", 5.0),
        ("p", "minimize", "fe", "r5", "discard", 1.0),
        ("p", "minimize", "ff", "r6", "failed", None),
        ("p", "minimize", "fd", "r7", "keep", 6.0),
        ("p", "minimize", "fg", "r8", None, 6.0),
    ]
    df = results(spark, rows)
    assert top(lb.ranked(df, 10)) == [("fd", "r4")]
    counts = lb.status_counts(df).first()
    assert (counts.num_completed, counts.num_discarded, counts.num_failed,
            counts.num_unrankable) == (1, 1, 1, 2)


def test_snapshot_limits_and_empty_projects(spark):
    rows = [("p", "minimize", f"f{i}", f"r{i}", "completed", float(i)) for i in range(5)]
    terms = contract_table(spark, ("p", "minimize", 2), ("q", "maximize", 10), ("z", "minimize", 0))
    rows += [("z", "minimize", "fz", "rz", "keep", 1.0)]
    board = {r.project: r for r in lb.leaderboard_snapshot(results(spark, rows), terms).collect()}
    assert [e.fingerprint for e in board["p"].top_k] == ["f0", "f1"]
    assert board["p"].num_completed == 5 and board["p"].best.run_id == "r0"
    assert board["q"].top_k == [] and board["q"].best is None
    assert (board["q"].num_completed, board["q"].num_failed) == (0, 0)
    assert board["z"].top_k == [] and board["z"].best.run_id == "rz"


def test_snapshot_ignores_other_metrics(spark):
    rows = [("p", "minimize", "fa", "r1", "completed", 1.0)]
    df = results(spark, rows).replace("loss", "accuracy", "metric_name")
    row = lb.leaderboard_snapshot(df, contract_table(spark, ("p", "minimize", 5))).first()
    assert row.top_k == [] and row.num_completed == 0 and row.num_unrankable == 1


def test_negative_limit_and_bad_objective_raise(spark):
    df = results(spark, [("p", "best", "fa", "r1", "completed", 1.0)])
    with pytest.raises(ValueError):
        lb.ranked(df, -1)
    with pytest.raises(ValueError):
        lb.leaderboard_snapshot(df, contract_table(spark, ("p", "minimize", -1)))
    with pytest.raises(PySparkException, match="Unsupported objective"):
        lb.ranked(df, 1).collect()


@pytest.mark.parametrize("objective", ["minimize", "maximize"])
@pytest.mark.parametrize("seed", [1, 2])
def test_board_equals_sequential_scan(spark, objective, seed):
    rng = random.Random(seed)
    rows = [
        ("p", objective, f"f{rng.randrange(30):02d}", f"r{i:04d}",
         rng.choice(["completed", "keep", "discard", "failed", "other"]),
         float(rng.randrange(40)))
        for i in range(400)
    ]
    rng.shuffle(rows)
    df = results(spark, rows)
    count, expected = board_by_loop(rows, objective, 7)
    got = [(r.fingerprint, r.run_id, r.metric_value)
           for r in lb.ranked(df, 7).orderBy("rank").collect()]
    assert got == expected
    assert lb.status_counts(df).first().num_completed == count
    one = [(r.fingerprint, r.run_id, r.metric_value)
           for r in lb.top_of_project(df, "p", 7).collect()]
    assert one == expected
    by_window = lb.best_per_fingerprint(df).select("fingerprint", "run_id").collect()
    by_aggregate = lb.best_per_fingerprint_agg(df).select("fingerprint", "run_id").collect()
    assert sorted(by_window) == sorted(by_aggregate)


def test_sorted_results_are_in_order(spark):
    rows = [("p", "maximize", f"f{i}", f"r{i}", "keep", float(i * 7 % 5)) for i in range(9)]
    got = [(r.m, r.fingerprint) for r in lb.sorted_results(results(spark, rows)).collect()]
    assert got == sorted(got) and len(got) == 9


def test_contract_values_replace_row_values(spark):
    df = results(spark, [("p", "minimize", "fa", "r1", "completed", 1.0),
                         ("x", "minimize", "fb", "r2", "completed", 1.0)])
    got = {r.run_id: r.objective for r in
           lb.with_contract(df, contract_table(spark, ("p", "maximize", 3))).collect()}
    assert got == {"r1": "maximize", "r2": None}


def test_baseline_is_the_first_finished_run(spark):
    rows = [("p", "minimize", "fb", "r2", "completed", 4.0, 10),
            ("p", "minimize", "fa", "r1", "completed", 9.0, 20),
            ("p", "minimize", "fc", "r3", "keep", 1.5, 30),
            ("p", "minimize", "fd", "r4", "failed", 0.0, 1)]
    row = lb.baseline_delta(results(spark, rows)).first()
    assert (row.baseline_run_id, row.baseline_metric, row.best_metric, row.improvement) == (
        "r2", 4.0, 1.5, 2.5)
