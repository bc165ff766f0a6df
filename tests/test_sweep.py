from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from helpers import at, contract_table, results
from trialframe.functions.fingerprints import config_fingerprint
from trialframe.operators import evaluation as e
from trialframe.operators import sweep as s
from trialframe.operators.leaderboard import leaderboard_snapshot
from trialframe.operators.rounds import config_round


def test_threshold_sweep_equals_brute_force(spark):
    data = [(v % 13 - 2, (v * 7) % 3 % 2) for v in range(200)] + [(None, 1), (3, None)]
    df = spark.createDataFrame(data, "v int, y int")
    bounds = [5, -3, 0, 5, 2, 40]
    got = {r.threshold: (r.hits, r.n) for r in s.sweep_thresholds(df, "v", "y", bounds).collect()}
    full = [(v, y) for v, y in data if v is not None and y is not None]
    assert got == {t: (sum((v > t) == (y == 1) for v, y in full), 200) for t in set(bounds)}


def test_threshold_sweep_of_no_rows(spark):
    df = spark.createDataFrame([], "v int, y int")
    assert [tuple(r) for r in s.sweep_thresholds(df, "v", "y", [1]).collect()] == [(1, 0, 0)]


@pytest.mark.parametrize("per_scan", [1, 3, 100])
def test_aggregate_sweep_in_slices(spark, per_scan):
    df = spark.range(10)
    grid = [{"a": a, "name": f"g{a}"} for a in range(5)]
    got = s.sweep_aggregate(
        df, grid, lambda p: {"total": F.sum(F.col("id") * p["a"]), "n": F.count("*")}, per_scan)
    assert sorted(map(tuple, got.collect())) == [(a, f"g{a}", 45 * a, 10) for a in range(5)]
    with pytest.raises(ValueError):
        s.sweep_aggregate(df, [], lambda p: {})


@pytest.mark.parametrize("per_row", [1, 3, 100])
def test_aggregate_sweep_of_no_rows(spark, per_row):
    grid = [{"a": a} for a in range(5)]
    got = s.sweep_aggregate(
        spark.range(0), grid, lambda p: {"total": F.sum(F.col("id") * p["a"]), "n": F.count("*")}, per_row)
    assert sorted(got.collect()) == [(a, None, 0) for a in range(5)]


def test_parameters_of_every_type(spark):
    grid = [{"x": 0.5, "s": "a\"b", "b": True, "n": None}, {"x": 2, "s": None, "b": False, "n": 1 << 40}]
    got = s.sweep_aggregate(spark.range(4), grid, lambda p: {"over": F.count_if(F.col("id") > p["x"])})
    assert sorted(map(tuple, got.collect()), key=str) == [(0.5, 'a"b', True, None, 3), (2.0, None, False, 1 << 40, 1)]
    with pytest.raises(TypeError):
        s.sweep_aggregate(spark.range(4), [{"x": 1}, {"x": "a"}], lambda p: {"n": F.count("*")})


def test_thousands_of_points_are_one_scan(spark, tmp_path):
    path = str(tmp_path / "data")
    spark.range(0, 3000).select("id", (F.col("id") % 2).alias("y")).write.parquet(path)
    data = spark.read.parquet(path)
    grid = [{"a": a} for a in range(5000)]
    begin = time.perf_counter()
    swept = s.sweep_aggregate(data, grid, lambda p: {"hits": F.count_if((F.col("id") > p["a"]) == (F.col("y") == 1))})
    plan = swept._jdf.queryExecution().executedPlan().toString()
    cut = s.sweep_thresholds(data, "id", "y", list(range(5000)))
    cuts = cut._jdf.queryExecution().executedPlan().toString()
    assert time.perf_counter() - begin < 10
    assert plan.count("FileScan parquet") == cuts.count("FileScan parquet") == 1
    got = {r.a: r.hits for r in swept.collect()}
    assert got == {r.threshold: r.hits for r in cut.collect()}
    assert len(got) == 5000 and got[10] == sum((i > 10) == (i % 2 == 1) for i in range(3000))


def test_thresholds_on_odd_values(spark):
    rows = [(x, y) for x in (float("nan"), float("inf"), float("-inf"), -0.0, 0.0, 1.5, 1.4999) for y in (0, 1, 2)]
    got = {r.threshold: (r.hits, r.n) for r in s.sweep_thresholds(spark.createDataFrame(rows, "v double, y int"), "v", "y", [0.0, 1.5, -1.0]).collect()}
    above = lambda v, t: v != v or v > t
    assert got == {t: (sum(y == 1 if above(v, t) else y == 0 for v, y in rows), 21) for t in (0.0, 1.5, -1.0)}


def configs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, config string")


def test_evaluation_turns_exceptions_into_failed_rows(spark):
    def evaluate(config, prior):
        if "x" not in config:
            raise KeyError("x")
        return {"metric_name": "loss", "metric_value": config["x"], "status": config.get("s", "completed"),
                "artifact_payload": {"n": [1, 2], "t": "text"}}

    df = configs(spark, '{"x": 2}', "{}", '{"x": null, "s": "odd"}', "not json", '{"x": "abc"}')
    rows = {r.i: r for r in e.evaluate_configs(df, evaluate).collect()}
    assert (rows[0].status, rows[0].metric_value, rows[0].error) == ("completed", 2.0, None)
    assert rows[0].artifact_payload == {"n": "[1, 2]", "t": "text"}
    assert (rows[1].status, rows[1].error) == ("failed", "KeyError: 'x'")
    assert (rows[2].status, rows[2].metric_value) == ("odd", None)
    assert rows[3].error.startswith("JSONDecodeError: ")
    assert rows[4].status == "failed"
    assert all(r.started_at <= r.completed_at for r in rows.values())


def test_prior_rows_reach_the_function(spark):
    board = leaderboard_snapshot(
        results(spark, [("p", "minimize", "fa", "r1", "keep", 4.0), ("p", "minimize", "fb", "r2", "keep", 3.0)]),
        contract_table(spark, ("p", "minimize", 10)))
    df = spark.createDataFrame([("p", "{}"), ("q", "{}")], "project string, config string")

    def evaluate(config, prior):
        values = [row["metric_value"] for row in prior]
        return {"metric_name": "loss", "metric_value": sum(values), "status": f"saw {len(values)}"}

    got = {r.project: (r.metric_value, r.status)
           for r in e.evaluate_configs(e.with_history(df, board), evaluate).collect()}
    assert got == {"p": (7.0, "saw 2"), "q": (0.0, "saw 0")}


def test_canonicalize_merges_equivalent_configs(spark):
    df = configs(spark, '{"x": 1, "note": "a"}', '{ "note": "b", "x": 1 }')
    keyed = lambda d: d.select(
        config_fingerprint(F.col("config"), F.lit("minimize"), F.lit("p"))).distinct().count()
    assert keyed(e.canonicalize_configs(df, None)) == 2
    assert keyed(e.canonicalize_configs(df, lambda c: {"x": c["x"]})) == 1
    with pytest.raises(TypeError):
        e.canonicalize_configs(df, "not a function")


def test_results_and_artifacts_of_evaluated_configs(spark):
    df = configs(spark, '{"x": 1}', '{"x": 0}').selectExpr(
        "config", "'p' AS project", "'a' AS agent_id", "concat('r', i) AS run_id", "'f' AS fingerprint")

    def evaluate(config, prior):
        return {"metric_name": "loss", "metric_value": 1 / config["x"], "status": "completed",
                "artifact_payload": {"run_id": "mine", "more": 1}}

    evaluated = e.evaluate_configs(df, evaluate)
    rows = {r.run_id: r for r in e.config_results(evaluated, contract_table(spark, ("p", "maximize", 1))).collect()}
    assert (rows["r0"].metric_value, rows["r0"].objective) == (1.0, "maximize")
    assert (rows["r1"].status, rows["r1"].metric_name) == ("failed", "loss")
    assert rows["r1"].error == "ZeroDivisionError: division by zero"
    artifacts = e.artifact_rows(evaluated).collect()
    assert [(r.run_id, r.artifact["run_id"], r.artifact["more"]) for r in artifacts] == [("r0", "mine", "1")]


def test_round_admits_evaluates_and_ranks(spark):
    terms = contract_table(spark, ("p", "minimize", 5))
    stored = results(spark, [("p", "minimize", "fa", "r1", "completed", 2.0)])
    asked = spark.createDataFrame(
        [("p", f, at(i), i, json.dumps({"x": i})) for i, f in enumerate(["fa", "fb", "fb", "fc"])],
        "project string, fingerprint string, ts timestamp, candidate_id long, config string")
    claims = spark.createDataFrame(
        [("p", "fc", at(0), at(100))],
        "project string, fingerprint string, claimed_at timestamp, expires_at timestamp")
    out = config_round(asked, stored, claims, terms,
                      lambda c, prior: {"metric_name": "loss", "metric_value": c["x"] - len(prior), "status": "completed"})
    assert [(r.fingerprint, r.metric_value) for r in out["results"].collect()] == [("fb", 0.0)]
    assert sorted(r.reason for r in out["admission"].collect()) == ["accepted", "claimed", "claimed", "completed"]
    board = out["snapshot"].first()
    assert [x.fingerprint for x in board.top_k] == ["fb", "fa"]
    # Evaluated once: ids are the same on every read.
    assert out["results"].first().run_id == out["results"].first().run_id


def test_grid_and_seeds(spark):
    base = spark.createDataFrame([("p",)], "project string")
    grid = s.expand_grid(base, {"a": [1, 2], "b": ["x", "y", "z"]})
    assert grid.distinct().count() == 6
    seeds = s.expand_seeds(base, contract_table(spark, ("p", "minimize", 1)))
    assert sorted(r.seed for r in seeds.collect()) == [7, 13, 21, 42]


def test_own_history_is_whole_ordered_and_lazy(spark):
    asked = spark.createDataFrame(
        [("p", "a", '{"x": 1}'), ("p", "a", '{"x": 2}'), ("p", "b", '{"x": 3}'), (None, "a", '{"x": 4}'), ("p", "c", "no json")],
        "project string, fingerprint string, config string")
    stored = spark.createDataFrame(
        [("p", "a", f"r{i}", ["completed", "failed"][i % 2], None if i % 2 else float(i), at(100 - i)) for i in range(30)]
        + [(None, "a", "r0", "keep", 7.0, at(1)), ("q", "b", "r1", "keep", 9.0, at(1))],
        "project string, fingerprint string, run_id string, status string, metric_value double, completed_at timestamp",
    ).repartition(4)

    def evaluate(config, prior):
        if config["x"] == 2:
            return {"metric_name": "first", "metric_value": float(next(prior)["run_id"][1:]), "status": "completed"}
        seen = list(prior)
        assert seen == sorted(seen, key=lambda r: (r["completed_at"], r["run_id"]))
        return {"metric_name": str(sum(r["status"] == "failed" for r in seen)), "metric_value": len(seen),
                "status": "completed", "artifact_payload": {"n": len(seen)}}

    rows = {r.config: r for r in e.evaluate_with_own_history(asked, stored, evaluate).collect()}
    assert (rows['{"x": 1}'].metric_name, rows['{"x": 1}'].metric_value) == ("15", 30.0)
    assert rows['{"x": 2}'].metric_value == 29.0
    assert (rows['{"x": 3}'].metric_value, rows['{"x": 4}'].metric_value) == (0.0, 1.0)
    assert rows["no json"].status == "failed" and rows["no json"].error.startswith("JSONDecodeError")
    assert rows['{"x": 1}'].artifact_payload == {"n": "30"}


def test_round_shows_the_function_a_reduction_of_all_results(spark):
    asked = spark.createDataFrame(
        [("p", "minimize", "new", '{"x": 1}', at(50), 1)],
        "project string, objective string, fingerprint string, config string, ts timestamp, candidate_id long")
    stored = results(spark, [("p", "minimize", f"f{i}", f"r{i}", "failed" if i % 3 else "completed", float(i)) for i in range(9)])
    none = spark.createDataFrame([], "project string, fingerprint string, claimed_at timestamp, expires_at timestamp")

    def reduce(rows):
        return rows.groupBy("project").agg(F.count_if(F.col("status") == "failed").alias("n_failed"))

    def evaluate(config, prior):
        return {"metric_name": "loss", "metric_value": prior[0]["n_failed"], "status": "completed"}

    out = config_round(asked, stored, none, contract_table(spark, ("p", "minimize", 3)), evaluate, reduce)
    assert [r.metric_value for r in out["results"].collect()] == [6.0]
