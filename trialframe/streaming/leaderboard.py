"""Leaderboard kept current by Structured Streaming.

One stream and one merge per micro-batch: its rows are scoped by the contracts
(metric, objective, limit) and reduced to one row per fingerprint, which is
written once.  Counters are added, fingerprints not seen before are logged and
counted, and the best rows are merged into the published board, which holds at
most a contract's ``leaderboard_limit`` rows, and always the best one.

Merging is safe to repeat: a version is named after its batch and is built
from the version before it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialframe.operators.leaderboard import COUNTERS, combined, largest_limit
from trialframe.session import durable, scratch_scope
from trialframe.sources.writers import publish, read_version, version_before
from trialframe.streaming.feed import drain_batches

_ROW = ("m", "fingerprint", "run_id", "metric_value")
_BOARD = (
    "project string, num_completed long, num_discarded long, num_failed long, num_unrankable long, "
    "top array<struct<m: double, fingerprint: string, run_id: string, metric_value: double>>"
)


def _earlier(spark: SparkSession, root: str, batch: int) -> DataFrame:
    version = version_before(spark, root, batch)
    if version is None:
        return spark.createDataFrame([], _BOARD)
    return read_version(spark, root, version)


def _terms(contracts: DataFrame) -> DataFrame:
    return contracts.select(F.col("name").alias("project"), "metric", "objective", "leaderboard_limit")


def _seen(spark: SparkSession, root: str, batch: int) -> DataFrame:
    try:
        log = spark.read.schema("project string, fingerprint string, batch long").parquet(f"{root}/seen")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "project string, fingerprint string")
    return log.where(F.col("batch") < batch).drop("batch")


def _top(rows: DataFrame, contracts: DataFrame, deepest: int) -> DataFrame:
    """The best rows of each project; ranks beyond any contract's limit are cut before the shuffle."""
    once = rows.groupBy("project", "fingerprint").agg(
        F.min(F.struct("m", "run_id", "metric_value")).alias("best")
    ).select("project", "fingerprint", "best.*")
    order = Window.partitionBy("project").orderBy("m", "fingerprint")
    limits = _terms(contracts).select("project", F.greatest("leaderboard_limit", F.lit(1)).alias("limit"))
    return (
        once.withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= max(1, deepest))
        .join(limits, "project")
        .where(F.col("_rank") <= F.col("limit"))
        .groupBy("project")
        .agg(F.array_sort(F.collect_list(F.struct(*_ROW))).alias("top"))
    )


def merge_results(root: str, contracts: DataFrame):
    """foreachBatch function that folds a micro-batch of results into the board."""
    deepest = largest_limit(contracts)

    def merge(results: DataFrame, batch: int) -> None:
        spark = results.sparkSession
        fresh = durable(combined(results, contracts))
        ranked = fresh.where("best is not null")
        new = ranked.select("project", "fingerprint").join(
            _seen(spark, root, batch), ["project", "fingerprint"], "left_anti"
        )
        new.write.mode("overwrite").parquet(f"{root}/seen/batch={batch}")
        new = spark.read.schema("project string, fingerprint string").parquet(f"{root}/seen/batch={batch}")
        board = _earlier(spark, f"{root}/board", batch)
        counts = fresh.groupBy("project").agg(*[F.sum(c).alias(c) for c in COUNTERS[1:]])
        found = new.groupBy("project").agg(F.count("*").alias("num_completed"))
        added = counts.join(found, "project", "left").select(
            "project", *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTERS]
        )
        totals = board.select("project", *COUNTERS).unionByName(added).groupBy("project").agg(
            *[F.sum(c).alias(c) for c in COUNTERS]
        )
        rows = board.select("project", F.inline("top")).unionByName(
            ranked.select("project", "best.m", "fingerprint", "best.run_id", "best.metric_value")
        )
        publish(totals.join(_top(rows, contracts, deepest), "project", "left"), f"{root}/board", batch)

    def merge_and_clean(results: DataFrame, batch: int) -> None:
        with scratch_scope(results.sparkSession):
            merge(results, batch)

    return merge_and_clean


def update_leaderboard(results: DataFrame, contracts: DataFrame, root: str) -> None:
    """Bring the board under ``root`` up to date with a stream of results.

    Results: project, fingerprint, run_id, status, metric_name, metric_value.
    Objective, metric and limit are the contracts'; rows of other projects are
    left out.  A contract that changes needs a new root.
    """
    drain_batches(results, merge_results(root, contracts), root)


def current_leaderboard(spark: SparkSession, root: str, contracts: DataFrame) -> DataFrame:
    """The board as published, one row per contract, as ``leaderboard_snapshot`` gives it."""
    board = _earlier(spark, f"{root}/board", 2**62)
    entry = lambda row, i: F.struct(
        (i + 1).alias("rank"), row["fingerprint"].alias("fingerprint"),
        row["run_id"].alias("run_id"), row["metric_value"].alias("metric_value"),
    )
    rows = F.transform(F.coalesce("top", F.array().cast(board.schema["top"].dataType)), entry)
    return (
        _terms(contracts)
        .join(board, "project", "left")
        .withColumn("_rows", rows)
        .select(
            "project", "metric", "objective",
            *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTERS],
            F.slice("_rows", F.lit(1), F.col("leaderboard_limit")).alias("top_k"),
            F.get("_rows", F.lit(0)).alias("best"),
        )
    )
