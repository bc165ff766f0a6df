"""Ranking runs per project: filter, dedupe, order, top-k, counters.

The ranking path touches seven narrow columns.  Rows are reduced to one per
fingerprint before the shuffle (partial aggregation or a partial window-group
limit), so a fingerprint or project holding a large share of all rows costs
its mappers no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialframe.functions.objective import cost, is_rankable
from trialframe.schemas import DISCARD, FAILED, RANKING_COLUMNS
from trialframe.session import durable

RUN_KEY = ["project", "fingerprint", "run_id"]
#: Parts of a project that are ranked apart before their best rows meet.
SALTS = 64


def with_contract(results: DataFrame, contracts: DataFrame) -> DataFrame:
    """Attach each project's contract; its values replace the rows' own.

    Without a hint: Spark broadcasts contracts while they fit its threshold
    and splits hot projects at run time when they do not.
    """
    fields = contracts.withColumnRenamed("name", "project")
    replaced = [c for c in fields.columns if c != "project" and c in results.columns]
    return results.drop(*replaced).join(fields, "project", "left")


def rankable(results: DataFrame) -> DataFrame:
    """Rows with a rankable status (completed or keep)."""
    return results.where(is_rankable(F.col("status")))


def _scored(results: DataFrame, metric_name: str | None = None) -> DataFrame:
    """Rankable rows with a usable metric, and their cost ``m``."""
    rows = rankable(results)
    if metric_name is not None:
        rows = rows.where(F.col("metric_name") == metric_name)
    return rows.withColumn(
        "m", cost(F.col("objective"), F.col("metric_value"))
    ).where(F.col("m").isNotNull())


def best_per_fingerprint(results: DataFrame) -> DataFrame:
    """Best row per (project, fingerprint); the lowest run_id wins a tie."""
    order = Window.partitionBy("project", "fingerprint").orderBy("m", "run_id")
    return (
        _scored(results)
        .withColumn("_rank", F.row_number().over(order))
        .where("_rank = 1")
        .drop("_rank")
    )


def best_per_fingerprint_agg(
    results: DataFrame, carry: tuple[str, ...] = ("objective", "metric_value")
) -> DataFrame:
    """The same rows as an aggregate: the smallest (m, run_id, ...) struct.

    Only the ``carry`` columns travel.  (m, run_id) is unique per fingerprint,
    so the carried columns never decide the minimum.
    """
    packed = F.min(F.struct("m", "run_id", *carry)).alias("best")
    return (
        _scored(results)
        .groupBy("project", "fingerprint")
        .agg(packed)
        .select("project", "fingerprint", "best.*")
    )


def sorted_results(results: DataFrame) -> DataFrame:
    """All deduplicated rows in rank order (a distributed range sort)."""
    return best_per_fingerprint(results).orderBy("project", "m", "fingerprint")


def check_limit(limit: int) -> int:
    if limit < 0:
        raise ValueError("leaderboard limit must not be negative")
    return limit


def ranked(results: DataFrame, limit: int) -> DataFrame:
    """Top ``limit`` rows per project with their ``rank``, from 1."""
    order = Window.partitionBy("project").orderBy("m", "fingerprint")
    return (
        best_per_fingerprint(results)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= check_limit(limit))
    )


def top_of_project(results: DataFrame, project: str, limit: int) -> DataFrame:
    """Top rows of one project: the filter reaches the scan, no window rank."""
    chosen = results.where(F.col("project") == project)
    return (
        best_per_fingerprint(chosen)
        .orderBy("m", "fingerprint")
        .limit(check_limit(limit))
    )


def best_rows(results: DataFrame, contracts: DataFrame) -> DataFrame:
    """Best row per project; projects without one keep a row of NULLs."""
    best = ranked(results, 1).drop("rank")
    keep = [c for c in best.columns if c != "objective"]
    projects = contracts.select(F.col("name").alias("project"), "objective")
    return projects.join(best.select(*keep), "project", "left")


def _rankable_only(value: Column, usable: Column) -> Column:
    return F.when(is_rankable(F.col("status")) & usable, value)


def status_counts(results: DataFrame) -> DataFrame:
    """Counters per project.

    num_completed counts distinct fingerprints; num_discarded and num_failed
    count rows; num_unrankable counts rankable rows without a usable metric.
    """
    usable = F.col("metric_value").isNotNull() & ~F.isnan("metric_value")
    fingerprint = F.col("fingerprint")
    return results.groupBy("project").agg(
        F.count_distinct(_rankable_only(fingerprint, usable)).alias("num_completed"),
        F.count_if(F.col("status") == DISCARD).alias("num_discarded"),
        F.count_if(F.col("status") == FAILED).alias("num_failed"),
        F.count(_rankable_only(F.lit(1), ~usable)).alias("num_unrankable"),
    )


COUNTERS = ("num_completed", "num_discarded", "num_failed", "num_unrankable")


def largest_limit(contracts: DataFrame) -> int:
    """The largest leaderboard limit any contract asks for (one number)."""
    top = contracts.agg(
        F.max("leaderboard_limit"), F.min("leaderboard_limit")
    ).first()
    if top[1] is not None:
        check_limit(int(top[1]))
    return int(top[0] or 0)


def leaderboard_snapshot(
    results: DataFrame,
    contracts: DataFrame,
    row_columns: tuple[str, ...] | None = None,
    deepest: int | None = None,
) -> DataFrame:
    """One row per contract: counters, ``top_k`` and ``best``.

    ``deepest`` is the largest limit of any contract, read from the table when
    not given: ranks beyond it are cut before the shuffle.

    The rows of ``top_k`` and ``best`` are whole records: ranking reads narrow
    columns, and the records of the ranked runs join last.  With ``row_columns``
    they hold these of the ranking columns only, without that join.

    Objective and metric come from the contract.  A row whose metric_name is
    another metric is not ranked.  ``best`` is given even when the limit is 0.

    One scan gives counters and ranking: rows are combined to one per
    fingerprint, these are ranked within ``SALTS`` parts of a project, and a
    project's aggregate holds its counters and at most ``deepest`` rows of each
    part.  A second scan finds the records of the few ranked runs.
    """
    head = contracts.select(
        F.col("name").alias("project"), "metric", "objective", "leaderboard_limit"
    )
    if deepest is None:
        deepest = largest_limit(contracts)
    deepest = max(1, check_limit(deepest))
    narrow = tuple(c for c in row_columns or () if c not in ("fingerprint", "run_id"))
    found = combined(results, contracts, narrow)
    part = Window.partitionBy("project", F.pmod(F.xxhash64("fingerprint"), F.lit(SALTS))).orderBy(
        F.col("best").isNull(), "best.m", "fingerprint"
    )
    entry = F.struct("best.m", "fingerprint", "best.run_id", *[f"best.{c}" for c in narrow])
    near = (F.row_number().over(part) <= deepest) & F.col("best").isNotNull()
    totals = (
        found.withColumn("_entry", F.when(near, entry))
        .groupBy("project")
        .agg(
            F.count(F.when(F.col("fingerprint").isNotNull(), F.col("best"))).alias("num_completed"),
            *[F.sum(c).alias(c) for c in COUNTERS[1:]],
            F.array_sort(F.collect_list("_entry")).alias("_top"),
        )
    )
    wanted = F.greatest("leaderboard_limit", F.lit(1))
    board = durable(head.join(totals, "project", "left").withColumn("_top", F.slice("_top", F.lit(1), wanted)))
    entries = board.select("project", F.posexplode("_top").alias("rank", "_row")).select(
        "project", (F.col("rank") + 1).alias("rank"), "_row.*"
    )
    if row_columns is None:
        row_columns = tuple(c for c in results.columns if c != "project")
        entries = results.join(durable(entries.select(*RUN_KEY, "rank")), RUN_KEY)
    rows = entries.groupBy("project").agg(
        F.array_sort(F.collect_list(F.struct("rank", *row_columns))).alias("_rows")
    )
    listed = F.coalesce(F.col("_rows"), F.array().cast(rows.schema["_rows"].dataType))
    return board.drop("_top").join(rows, "project", "left").select(
        "project", "metric", "objective",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTERS],
        F.slice(listed, F.lit(1), F.col("leaderboard_limit")).alias("top_k"),
        F.get(listed, F.lit(0)).alias("best"),
    )


def combined(results: DataFrame, contracts: DataFrame, carry: tuple[str, ...] = ("metric_value",)) -> DataFrame:
    """One row per (project, fingerprint): its best row (``m``, ``run_id``, carried columns) and its counts.

    Objective and metric are the contract's; rows of projects without one are
    left out.  Rows are combined before they are shuffled.
    """
    terms = contracts.select(F.col("name").alias("project"), "metric", "objective")
    scoped = results.drop("objective").join(terms, "project")
    other = F.coalesce(F.col("metric_name") != F.col("metric"), F.lit(False))
    ranks = is_rankable(F.col("status"))
    scoped = scoped.withColumn("metric_value", F.when(~other, F.col("metric_value"))).withColumn(
        "m", F.when(ranks, cost(F.col("objective"), F.col("metric_value")))
    )
    usable = F.col("metric_value").isNotNull() & ~F.isnan("metric_value")
    best = F.struct("m", "run_id", *[c for c in carry if c not in ("m", "run_id")])
    return scoped.groupBy("project", "fingerprint").agg(
        F.min(F.when(F.col("m").isNotNull(), best)).alias("best"),
        F.count_if(F.col("status") == DISCARD).alias("num_discarded"),
        F.count_if(F.col("status") == FAILED).alias("num_failed"),
        F.count_if(ranks & ~usable).alias("num_unrankable"),
    )


def ranking_view(results: DataFrame) -> DataFrame:
    """The narrow columns ranking needs."""
    return results.select(*RANKING_COLUMNS)


def full_rows(ranked_rows: DataFrame, results: DataFrame) -> DataFrame:
    """Wide columns (config, diff, ...) for rows that survived ranking.

    The few ranked rows are written first, so the planner knows their size:
    within its broadcast threshold the wide columns are scanned but never
    shuffled, and only in the partitions of projects that have such rows.
    """
    wide = [c for c in results.columns if c not in ranked_rows.columns]
    return results.select(*RUN_KEY, *wide).join(durable(ranked_rows), RUN_KEY, "inner")


def baseline_delta(results: DataFrame) -> DataFrame:
    """First finished rankable run per project against the project's best."""
    finished = F.struct("completed_at", "run_id", "metric_value", "m")
    return (
        _scored(results)
        .groupBy("project", "objective")
        .agg(
            F.min(finished).alias("first"),
            F.min(F.struct("m", "metric_value")).alias("best"),
        )
        .select(
            "project",
            F.col("first.run_id").alias("baseline_run_id"),
            F.col("first.metric_value").alias("baseline_metric"),
            F.col("best.metric_value").alias("best_metric"),
            (F.col("first.m") - F.col("best.m")).alias("improvement"),
        )
    )


def result_artifacts(results: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Each result with its run's artifact, if any."""
    keys = ["agent_id", "run_id"]
    extra = [c for c in artifacts.columns if c not in results.columns]
    return results.join(artifacts.select(*keys, *extra), keys, "left")
