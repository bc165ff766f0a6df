from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from helpers import at
from trialframe.functions.fingerprints import has_changes, text_fingerprint
from trialframe.operators import decisions as d

HISTORY = (
    "project string, objective string, completed_at timestamp, run_id string, "
    "metric_value double, is_code boolean, status string"
)


def replay_by_loop(rows, scale=6):
    """(run_id → decision) by playing one project's runs in order."""
    best, out = None, {}
    for _, objective, _, run_id, metric, is_code, status in sorted(rows, key=lambda r: (r[2], r[3])):
        sign = 1 if objective == "minimize" else -1
        if is_code:
            if metric is None:
                out[run_id] = "failed"
                continue
            keep = best is None or sign * metric < sign * best
            out[run_id] = "keep" if keep else "discard"
            stored = round(metric, scale)
            counts = keep
        else:
            stored, counts = metric, status in ("completed", "keep") and metric is not None
        if counts and (best is None or sign * stored < sign * best):
            best = stored
    return out


def decisions(df, **options):
    return {r.run_id: r.decision for r in d.keep_discard_replay(df, **options).collect()}


def test_first_better_tie_worse_and_failed(spark):
    metrics = [None, 5.0, 4.0, 4.0, 6.0, 3.0]
    rows = [("p", "minimize", at(i), f"r{i}", m, True, None) for i, m in enumerate(metrics)]
    df = spark.createDataFrame(rows, HISTORY)
    assert decisions(df) == {
        "r0": "failed", "r1": "keep", "r2": "keep", "r3": "discard", "r4": "discard", "r5": "keep"}


def test_unrounded_repeat_beats_its_rounded_self(spark):
    rows = [("p", "minimize", at(i), f"r{i}", 0.1234567, True, None) for i in range(2)]
    df = spark.createDataFrame(rows, HISTORY)
    assert decisions(df) == {"r0": "keep", "r1": "keep"}
    assert decisions(df, stored_scale=None) == {"r0": "keep", "r1": "discard"}


def test_config_rows_count_only_when_rankable(spark):
    rows = [("p", "maximize", at(0), "r0", 9.0, False, "failed"),
            ("p", "maximize", at(1), "r1", 5.0, False, "completed"),
            ("p", "maximize", at(2), "r2", 6.0, True, None),
            ("p", "maximize", at(3), "r3", 5.5, True, None)]
    df = spark.createDataFrame(rows, HISTORY)
    assert decisions(df) == {"r2": "keep", "r3": "discard"}


@pytest.mark.parametrize("bound", [10**6, 3600, 7, 1])
@pytest.mark.parametrize("objective", ["minimize", "maximize"])
def test_replay_equals_loop(spark, objective, bound):
    rng = random.Random(11)
    rows = [
        ("p", objective, at(rng.randrange(200)), f"r{i:04d}",
         None if rng.random() < 0.1 else rng.randrange(10**5) / 1000,
         rng.random() < 0.8, rng.choice(["completed", "failed", "discard"]))
        for i in range(500)
    ]
    df = spark.createDataFrame(rows, HISTORY)
    got = decisions(df, bucket_seconds=bound)
    curve = d.best_so_far(df, bucket_seconds=bound).collect()
    assert got == replay_by_loop(rows)
    assert len(curve) == len(rows)
    values = [r.best_metric for r in sorted(curve, key=lambda r: (r.completed_at, r.run_id))]
    values = [v for v in values if v is not None]
    assert values == sorted(values, reverse=objective == "minimize")


def test_classification_order(spark):
    rows = [("minimize", True, 0.1, None), ("minimize", False, None, None),
            ("minimize", False, 1.0, None), ("minimize", False, 1.0, 1.0),
            ("maximize", False, 2.0, 1.0), ("minimize", None, 0.5, 1.0)]
    df = spark.createDataFrame(rows, "objective string, timed_out boolean, metric double, best_metric double")
    got = [(r.status, r.error) for r in d.classify_runs(df).collect()]
    assert got == [("failed", "timeout"), ("failed", "metric not found in log"), ("keep", None),
                   ("discard", None), ("keep", None), ("keep", None)]


def test_code_results_fill_the_superset(spark):
    df = spark.createDataFrame(
        [("r0", "failed", 0.5, "b", "n"), ("r1", "keep", 0.12345678, "b", "n"),
         ("r2", "discard", 0.9, "b", "n")],
        "run_id string, status string, metric double, base_commit string, new_commit string")
    got = {r.run_id: (r.metric_value, r.new_commit) for r in d.code_results(df).collect()}
    assert got == {"r0": (None, None), "r1": (0.123457, "n"), "r2": (0.9, "b")}


def test_outcomes_tell_reason_or_error(spark):
    rows = [("r0", "failed", "timeout", None), ("r1", "failed", "metric not found in log", None),
            ("r2", "failed", "ValueError: x", None), ("r3", "keep", None, 1.0),
            ("r4", "odd", None, 2.0)]
    df = spark.createDataFrame(
        [("p", "f", *r, "loss") for r in rows],
        "project string, fingerprint string, run_id string, status string, error string, "
        "metric_value double, metric_name string")
    got = {r.run_id: (r.status, r.reason, r.error, r.metric_value) for r in d.outcomes(df).collect()}
    assert got == {
        "r0": ("failed", "timeout", None, None), "r1": ("failed", "metric_not_found", None, None),
        "r2": ("failed", None, "ValueError: x", None), "r3": ("keep", None, None, 1.0),
        "r4": ("odd", None, None, 2.0)}


def test_outcome_reports_the_metric_as_read(spark):
    df = spark.createDataFrame([("p", "f", "r", "keep", None, "loss", 0.12345678, 0.123457)],
        "project string, fingerprint string, run_id string, status string, error string, "
        "metric_name string, metric double, metric_value double")
    assert d.outcomes(df).first().metric_value == 0.12345678
    assert d.outcomes(df.drop("metric")).first().metric_value == 0.123457


def test_diff_groups(spark):
    df = spark.createDataFrame([("p", 1, "a"), ("p", 2, "a"), ("p", 3, " \n"), ("q", 4, "a")],
                               "project string, run_id int, text string")
    keyed = df.where(has_changes(F.col("text"))).withColumn("fingerprint", text_fingerprint(F.col("text")))
    got = {(r.project, r.first_run_id, r.n_runs) for r in d.diff_groups(keyed).collect()}
    assert got == {("p", 1, 2), ("q", 4, 1)}
