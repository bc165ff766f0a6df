"""The physical plans are the ones we rely on at scale."""

from __future__ import annotations

import re
from pathlib import Path

import pytest

import __spark_entry__ as entry
from trialframe.operators import admission as a
from trialframe.operators import leaderboard as lb
from trialframe.operators.decisions import as_results
from trialframe.plans.tables import runs
from trialframe.session import durable
from trialframe.sources.writers import append_results
from trialframe.sources.readers import read_results

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "results")
    append_results(as_results(runs(spark, SF_DIR)), path)
    return read_results(spark, path)


def test_ranking_never_reads_wide_columns(spark, stored):
    board = lb.ranked(lb.ranking_view(stored), 10).select("project", "rank", "run_id")
    schemas = re.findall(r"ReadSchema: (\S+)", plan(board))
    assert schemas
    for schema in schemas:
        assert not any(f"{wide}:" in schema for wide in ("config", "diff", "description"))


def test_status_filter_reaches_the_scan(spark, stored):
    assert "In(status" in plan(lb.ranked(stored, 10))


def test_top_k_is_cut_before_its_shuffle(spark, stored):
    text = plan(lb.ranked(stored, 10))
    assert text.count("WindowGroupLimit") == 4  # partial and final, twice
    assert text.count("Exchange hashpartitioning") == 2


def test_one_project_reads_one_partition_without_rank_window(spark, stored):
    text = plan(lb.top_of_project(stored, "p3", 10))
    assert "TakeOrderedAndProject" in text
    assert re.search(r"PartitionFilters: \[[^]]*project", text)


def test_snapshot_reads_results_once_for_ranking_and_once_for_records(spark, stored, monkeypatch):
    written = []
    monkeypatch.setattr(lb, "durable", lambda df: written.append(plan(df)) or durable(df))
    terms = spark.createDataFrame([(f"p{i}", "value", "minimize", i) for i in range(10)],
                                  "name string, metric string, objective string, leaderboard_limit int")
    snapshot = lb.leaderboard_snapshot(stored, terms)
    board = written[0]
    assert board.count("PartitionFilters") == 1  # one scan of the partitioned results
    assert re.findall(r"ReadSchema: (\S+)", board)[0].find("config") < 0
    windows = re.findall(r"Window \[row_number\(\) windowspecdefinition\(([^)]*)", board)
    assert windows and all("pmod" in w or "_w" in w for w in windows)
    assert re.search(r"partial_min\(", board) and re.search(r"partial_sum\(", board)
    assert len(re.findall(r"PartitionFilters: \[[^]]*project", plan(snapshot))) <= 1


def test_counters_aggregate_before_their_shuffle(spark, stored):
    text = plan(lb.status_counts(stored))
    assert "partial_count" in text and "Expand" not in text


def test_few_candidates_do_not_shuffle_the_results(spark, stored):
    text = plan(a.finished_keys(stored.where("project = 'p3'").limit(5), stored))
    assert "BroadcastHashJoin" in text and "LeftSemi" in text
    assert "SortMergeJoin" not in text


def test_no_cross_joins_and_no_local_checkpoints():
    root = Path(entry.__file__).parent
    for file in [root / "__spark_entry__.py", *root.glob("trialframe/**/*.py")]:
        source = file.read_text()
        code = re.sub(r'"""[\s\S]*?"""', "", source)
        assert "crossJoin" not in code and "localCheckpoint" not in code, file


def test_code_round_fetches_only_diffs_of_accepted_runs(spark, monkeypatch):
    from trialframe.plans import deciding

    outcomes, whole = [], deciding.code_round
    monkeypatch.setattr(deciding, "code_round", lambda *given, **more: outcomes.append(whole(*given, **more)) or outcomes[0])
    deciding.code_runs_round(spark, "/root/testdata/sf0.001")

    def nodes(plan):
        yield plan
        for k in range(plan.children().size()):
            yield from nodes(plan.children().apply(k))

    plan = outcomes[0]["results"]._jdf.queryExecution().optimizedPlan()
    outer = [n for n in nodes(plan) if n.nodeName() == "Join" and n.joinType().toString() == "LeftOuter"]
    found = [n.right().toString() for n in outer if "diff#" in n.right().output().toString()]
    assert found
    # The keys meet the events below the join with the texts, so that no text is shuffled for them.
    for text in found:
        assert "LeftSemi" in text and text.index("Join Inner") < text.index("Join LeftSemi")
