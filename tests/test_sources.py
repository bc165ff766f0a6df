from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from helpers import at, contract_table, results
from trialframe.operators import leaderboard as lb
from trialframe.operators.decisions import as_results
from trialframe.operators.evaluation import override
from trialframe.sources import readers, writers
from trialframe.sources.contracts import beat_plan, with_defaults
from trialframe.store import TrialStore

FP = ["00000000000000aa", "00000000000000bb", "00000000000000cc"]


@pytest.fixture
def result_dir(tmp_path):
    """One pretty-printed file per result, a truncated one and a temporary one."""
    for i, fingerprint in enumerate(FP[:2]):
        run_id = f"{i:012x}"
        record = {
            "project": "p", "objective": "minimize", "fingerprint": fingerprint,
            "run_id": run_id, "status": "completed", "metric_name": "loss",
            "metric_value": 1 + i, "config": {"b": 1.0, "a": "x y"},
            "started_at": 1704067200.1795749, "completed_at": 1704067201.25,
            "extra": "ignored",
        }
        path = tmp_path / f"{fingerprint}__{run_id}.json"
        path.write_text(json.dumps(record, indent=2, sort_keys=True) + "\n")
    (tmp_path / f"{FP[2]}__00000000000c.json").write_text('{"project": "p", "fing')
    (tmp_path / f"{FP[2]}__00000000000d.json.17.tmp").write_text("{}")
    return str(tmp_path)


def test_scan_results_files(spark, result_dir):
    rows = readers.scan_results(spark, result_dir, in_file_order=True)
    good = readers.clean(rows).collect()
    assert [r.fingerprint for r in good] == FP[:2]
    assert json.loads(good[0].config) == {"b": 1.0, "a": "x y"}
    assert good[0].started_at.microsecond == 179575
    assert good[1].metric_value == 2.0
    bad = readers.quarantined(rows).collect()
    assert len(bad) == 1 and bad[0][0].startswith('{"project"')
    # The key of an unreadable record is still known from its file name.
    assert rows.where("_corrupt_record IS NOT NULL").first().fingerprint == FP[2]


def test_quarantine_on_a_default_scan(spark, result_dir):
    rows = readers.scan_results(spark, result_dir)
    assert readers.clean(rows).count() == 2
    assert [r[0][:9] for r in readers.quarantined(rows).collect()] == ['{"project']
    claims = readers.scan_claims(spark, result_dir)
    assert readers.clean(claims).count() == 2 and readers.quarantined(claims).count() == 1


def test_sinks_skip_what_they_hold(spark, tmp_path):
    rows = stored(spark, [("p", "minimize", "fa", "r1", "completed", 1.0), ("q", "minimize", "fb", "r2", "keep", 2.0)])
    rows = rows.withColumns({"agent_id": F.lit("a"), "branch": F.lit("b")})
    artifacts = rows.select("agent_id", "run_id", F.create_map(F.lit("k"), F.lit("v")).alias("artifact"))
    for _ in range(2):
        writers.write_artifacts(artifacts, str(tmp_path / "artifacts"))
        writers.write_audit(rows, str(tmp_path / "audit"))
    assert writers.read_artifacts(spark, str(tmp_path / "artifacts")).count() == 2
    assert spark.read.text(str(tmp_path / "audit")).count() == 2


def test_scan_results_can_fail_fast(spark, result_dir):
    with pytest.raises((PySparkException, Py4JJavaError), match="(?i)malformed|failed_read"):
        readers.scan_results(spark, result_dir, on_error="raise").collect()
    with pytest.raises(ValueError):
        readers.scan_results(spark, result_dir, on_error="ignore")


def test_has_completed_by_file_name(spark, result_dir):
    assert readers.has_completed(spark, result_dir, FP[0])
    assert readers.has_completed(spark, result_dir, FP[2])  # content does not matter
    assert not readers.has_completed(spark, result_dir, "f" * 16)


def test_scan_claims(spark, tmp_path):
    claim = {"agent_id": "a", "fingerprint": FP[0], "claimed_at": 0, "expires_at": 300.5, "thread": "MainThread"}
    (tmp_path / f"{FP[0]}.json").write_text(json.dumps(claim, indent=2))
    (tmp_path / f"{FP[1]}.json").write_text("{")
    rows = {r.fingerprint: r for r in readers.scan_claims(spark, str(tmp_path)).collect()}
    assert str(rows[FP[0]].expires_at) == "1970-01-01 00:05:00.500000"
    assert rows[None].expires_at is None  # unreadable: expired


def test_config_files_and_logs(spark, tmp_path):
    for name, body in {"a.json": '{\n "x": 1\n}', "b.json": "[1]", "c.json": "{", "d.json": "3"}.items():
        (tmp_path / name).write_text(body)
    got = readers.read_config_files(spark, str(tmp_path)).collect()
    assert [(r.path.rsplit("/", 1)[1], json.loads(r.config)) for r in got] == [("a.json", {"x": 1})]
    with pytest.raises((PySparkException, Py4JJavaError), match="must be a JSON object"):
        readers.read_config_files(spark, str(tmp_path), on_error="raise").collect()
    log = tmp_path / "logs"
    log.mkdir()
    (log / "r1.log").write_text("one\nmetric_value: 0.5\n")
    assert [r.log for r in readers.read_logs(spark, str(log)).collect()] == ["one\nmetric_value: 0.5\n"]


def stored(spark, rows):
    return as_results(results(spark, rows))


def test_append_results_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "results")
    first = [("p", "minimize", "fa", "r1", "completed", 1.0), ("q", "minimize", "fb", "r2", "keep", 2.0)]
    writers.append_results(stored(spark, first), path)
    writers.append_results(stored(spark, first + first + [("p", "minimize", "fa", "r3", "failed", None)]), path)
    got = sorted((r.project, r.run_id) for r in readers.read_results(spark, path).collect())
    assert got == [("p", "r1"), ("p", "r3"), ("q", "r2")]


def test_publish_replaces_and_keeps_serving(spark, tmp_path):
    root = str(tmp_path / "board")
    with pytest.raises(FileNotFoundError):
        writers.read_published(spark, root)
    assert writers.read_published(spark, root, lambda: spark.range(1)).count() == 1
    assert writers.republish(spark.range(5), root).count() == 5
    # A version that was written but not published is not served.
    spark.range(9).write.parquet(f"{root}/versions/000000000007-x")
    assert writers.read_published(spark, root).count() == 5
    assert writers.version_before(spark, root, 1) == 0


def test_no_update_of_publishers_at_the_same_time_is_lost(spark, tmp_path):
    root = str(tmp_path / "board")
    writers.republish(spark.range(1), root)
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda n: writers.republish(spark.range(n), root), range(2, 8)))
    marks = writers._published(spark, root)
    versions = [v for v, _, _ in marks]
    assert versions[-1] == 6 and len(set(versions)) == len(versions)
    assert writers.read_version(spark, root, 6).count() in range(2, 8)


def test_claims_at_the_same_time_are_of_different_versions(spark, tmp_path):
    with ThreadPoolExecutor(6) as pool:
        for n in range(40):
            assert sorted(pool.map(lambda _: writers._claim(spark, str(tmp_path / str(n))), range(6))) == list(range(6))


def test_appended_results_are_evaluated_once(spark, tmp_path):
    """Run ids made at random are the same in the check and in the write."""
    path = str(tmp_path / "results")
    rows = [("p", "minimize", f"f{i}", "r", "completed", 1.0) for i in range(50)]
    writers.append_results(stored(spark, rows[:1]), path)
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    frame = stored(spark, rows)
    writers.append_results(frame.mapInArrow(seen, frame.schema), path)
    assert calls.value == 50
    assert readers.read_results(spark, path).count() == 50


def test_artifacts_and_audit(spark, tmp_path):
    artifacts = spark.createDataFrame(
        [("a", "r1", {"k": "v"}), ("b", "r2", {"k": None})],
        "agent_id string, run_id string, artifact map<string,string>")
    path = str(tmp_path / "artifacts")
    writers.write_artifacts(artifacts, path)
    assert (tmp_path / "artifacts" / "agent_id=a").is_dir()
    got = {(r.agent_id, r.run_id): r.artifact for r in writers.read_artifacts(spark, path).collect()}
    assert got[("a", "r1")] == {"k": "v"}
    lines = as_results(results(spark, [("p", "minimize", "fa", "r1", "completed", 0.5)])).fillna(
        {"branch": "main", "agent_id": "a"})
    audit = str(tmp_path / "audit")
    writers.write_audit(lines, audit)
    writers.write_audit(lines, audit)
    unsynced = contract_table(spark, ("p", "minimize", 1))
    assert writers.audit_lines(lines, unsynced).count() == 0
    assert writers.audit_lines(lines, unsynced.withColumn("git_sync", F.lit(True))).count() == 1
    texts = [r.value for r in spark.read.text(audit).collect()]
    assert texts == ["agent a [main]: fa__r1 loss=0.5 status=completed"]


def test_override_lets_extra_keys_win(spark):
    maps = spark.range(1).select(
        F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")).alias("base"),
        F.create_map(F.lit("b"), F.lit("3")).alias("extra"))
    assert maps.select(override(F.col("base"), F.col("extra"))).first()[0] == {"a": "1", "b": "3"}


def test_contract_defaults_and_required_fields(spark):
    df = spark.createDataFrame(
        [("a", "loss", "minimize", None, "cmd", "pat", None), ("b", "loss", "maximize", 5, None, None, 9)],
        "name string, metric string, objective string, claim_ttl_seconds int, run_command string, "
        "metric_pattern string, timeout_seconds int")
    a, b = with_defaults(df).orderBy("name").collect()
    assert (a.claim_ttl_seconds, a.leaderboard_limit, a.git_sync) == (300, 10, False)
    assert (a.registry_dir, a.artifact_dir, a.runner_entry) == ("registry", "runs", "projects.py")
    assert (a.search_groups, a.default_seed_pool) == (["explore"], [7, 13, 21, 42])
    assert (a.log_file, a.timeout_seconds, a.editable_files) == ("run.log", 600, [])
    assert b.claim_ttl_seconds == 5 and b.log_file is None and b.timeout_seconds is None
    with pytest.raises(PySparkException, match="metric_pattern"):
        with_defaults(df.withColumn("metric_pattern", F.lit(None).cast("string"))).collect()
    with pytest.raises(PySparkException, match="objective"):
        with_defaults(df.drop("objective")).collect()
    late = {r.name: r.first_beat_too_late for r in beat_plan(with_defaults(df)).collect()}
    assert late == {"a": False, "b": True}


def test_store_round_trip(spark, tmp_path):
    terms = contract_table(spark, ("p", "minimize", 3))
    store = TrialStore(spark, str(tmp_path / "store"), terms)
    assert store.results().count() == 0 and store.leases(F.lit(at(0))).count() == 0
    assert store.leaderboard().first().num_completed == 0
    store.record_lease_events(spark.createDataFrame(
        [("p", "fb", "a", "claim", at(0), "e1", 60.0)],
        "project string, fingerprint string, agent_id string, kind string, ts timestamp, "
        "event_id string, ttl_seconds double"))
    store.write_results(stored(spark, [("p", "minimize", "fa", "r1", "completed", 1.0)]))
    asked = spark.createDataFrame(
        [("p", f, at(30), i) for i, f in enumerate(["fa", "fb", "fc"])],
        "project string, fingerprint string, ts timestamp, candidate_id long")
    got = {r.fingerprint: r.reason for r in store.admit(asked, F.lit(at(30))).collect()}
    assert got == {"fa": "completed", "fb": "claimed", "fc": "accepted"}
    assert store.leaderboard().first().num_completed == 0  # still the published one
    assert store.rebuild_leaderboard().first().best.run_id == "r1"
    assert store.leaderboard().first().num_completed == 1


def test_full_rows_bring_wide_columns_back(spark):
    df = results(spark, [("p", "minimize", "fa", "r1", "keep", 1.0), ("p", "minimize", "fb", "r2", "keep", 2.0)])
    df = df.withColumn("diff", F.concat(F.lit("d"), "run_id"))
    got = lb.full_rows(lb.ranked(lb.ranking_view(df), 1), df).collect()
    assert [(r.run_id, r.diff) for r in got] == [("r1", "dr1")]


def test_logs_of_a_busy_user_are_read_in_bounded_files(spark, monkeypatch):
    from oracle import connect, differences
    from trialframe.plans import files

    sf_dir, read, longest = "/root/testdata/sf0.001", readers.read_logs, []

    def reading(spark, path):
        logs = read(spark, path)
        longest.append(logs.agg(F.max(F.regexp_count("log", F.lit("\n")))).first()[0])
        return logs

    def one_user(spark, sf_dir, name):
        # Times fall while ids rise, so that the first event is in the last file.
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet").where("event_id < 200")
        hot = F.when(F.col("event_id") % 4 > 0, 1).otherwise(F.col("user_id")).cast("long")
        ts = F.expr("timestamp_ntz'2024-01-01 00:00:00' - make_dt_interval(0, 0, 0, cast(event_id div 2 as int))")
        return rows.withColumn("user_id", hot).withColumn("ts", ts)

    monkeypatch.setattr(files, "LOG_EVENTS", 25)
    monkeypatch.setattr(readers, "read_logs", reading)
    monkeypatch.setattr(files, "table", one_user)
    con = connect(sf_dir)
    con.register("changed", one_user(spark, sf_dir, "events").toArrow())
    con.execute("CREATE OR REPLACE VIEW events AS SELECT * FROM changed")
    sql = r"""SELECT user_id, first(value ORDER BY ts, event_id) AS metric_value, count(*) AS n_lines
FROM (SELECT user_id, ts, event_id, CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS value FROM events)
GROUP BY user_id"""
    assert differences(files.read_log_files(spark, sf_dir), con, sql) == []
    assert longest and max(longest) <= 26


def _many_users(n):
    """``n`` events of as many users, without any input file."""
    def rows(spark, sf_dir, name):
        events = spark.range(n).selectExpr(
            "id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "id AS user_id",
            "'click' AS event_type", "CAST(id AS double) AS value", "'{\"k\": 1}' AS props")
        return events
    return rows


def test_log_files_are_not_as_many_as_users(spark, monkeypatch):
    from trialframe.plans import files

    read, counted = readers.read_logs, []

    def reading(spark, path):
        logs = read(spark, path)
        counted.append(logs.count())
        return logs

    monkeypatch.setattr(files, "table", _many_users(300))
    monkeypatch.setattr(readers, "read_logs", reading)
    got = {r.user_id: (r.metric_value, r.n_lines) for r in files.read_log_files(spark, "").collect()}
    assert got == {k: (float(k), 1) for k in range(300)}
    assert counted[0] <= files.LOG_GROUPS


def test_many_configs_share_a_file(spark, monkeypatch, tmp_path):
    from trialframe.plans import files

    folder = tmp_path / "configs"
    folder.mkdir()
    (folder / "a.txt").write_text('{"a": 1,\n "b": 2}\x1e[{"a": 1}]\x1e{"a": 3}x\x1e{"a": 4}\x1e')
    got = readers.read_config_files(spark, str(folder), separator=readers.SEPARATOR).collect()
    assert sorted(r.config for r in got) == ['{"a": 1,\n "b": 2}', '{"a": 4}']

    read, paths = readers.read_config_files, []

    def reading(spark, path, **options):
        paths.append(path)
        return read(spark, path, **options)

    monkeypatch.setattr(files, "table", _many_users(300))
    monkeypatch.setattr(readers, "read_config_files", reading)
    rows = files.read_config_files(spark, "").collect()
    assert sorted(rows) == [(k, 1) for k in range(300) if k % 5]
    assert spark.read.text(paths[0]).select("_metadata.file_name").distinct().count() <= 16


def test_artifacts_of_many_agents_share_directories(spark, tmp_path):
    path = tmp_path / "artifacts"
    agents = [f"a{k}" for k in range(60)] + [None, ""]
    rows = [(a, f"r{k}", {"k": str(k)}) for a in agents for k in range(2)]
    schema = "agent_id string, run_id string, artifact map<string,string>"
    artifacts = spark.createDataFrame(rows, schema)
    for _ in range(2):
        writers.write_artifacts(artifacts.where("agent_id <> ''"), str(path), 4)
    assert sorted(p.name for p in path.glob("*=*")) == [f"bucket={k}" for k in range(4)]
    got = writers.read_artifacts(spark, str(path))
    assert got.columns == ["run_id", "artifact", "agent_id"]
    key = lambda r: (r[0], r[1])
    found = sorted(((r.agent_id, r.run_id, r.artifact) for r in got.collect()), key=key)
    assert found == sorted((r for r in rows if r[0]), key=key)
    # Null and empty agents come back as they went.
    writers.write_artifacts(artifacts.where("coalesce(agent_id, '') = ''"), str(tmp_path / "odd"), 4)
    odd = writers.read_artifacts(spark, str(tmp_path / "odd")).select("agent_id").distinct().collect()
    assert {r.agent_id for r in odd} == {None, ""}
