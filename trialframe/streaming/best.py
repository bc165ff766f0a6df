"""Keep/discard decisions on arrival.

State is one stored best per project.  Each micro-batch is replayed with the
same skew-safe scan as the batch operator, after a seed row with the stored
best, so a project with most of a batch's rows does not end up in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.functions.objective import cost, stored_metric
from trialframe.operators.decisions import BUCKET_SECONDS, keep_discard_replay
from trialframe.schemas import COMPLETED
from trialframe.session import durable, scratch_scope
from trialframe.sources.writers import publish, read_version, version_before
from trialframe.streaming.feed import drain_batches

_BEST = "project string, objective string, metric_value double"


def decide_batches(root: str, bucket_seconds: int = BUCKET_SECONDS):
    """foreachBatch function: decide each run of a batch, update the bests."""

    def decide(batch_runs: DataFrame, batch: int) -> None:
        spark = batch_runs.sparkSession
        version = version_before(spark, f"{root}/best", batch)
        if version is None:
            stored = spark.createDataFrame([], _BEST)
        else:
            stored = read_version(spark, f"{root}/best", version)
        time_type = batch_runs.schema["completed_at"].dataType
        seeds = stored.select(
            "project", "objective",
            F.lit(None).cast(time_type).alias("completed_at"),  # sorts first
            F.lit("").alias("run_id"), "metric_value",
            F.lit(False).alias("is_code"), F.lit(COMPLETED).alias("status"),
        )
        # Written once: the batch is read several times below.
        arrived = durable(
            batch_runs.select(
                "project", "objective", "completed_at", "run_id", "metric_value",
                F.lit(True).alias("is_code"),
                F.lit(None).cast("string").alias("status"),
            )
        )
        decisions = keep_discard_replay(
            seeds.unionByName(arrived), bucket_seconds=bucket_seconds
        )
        out = f"{root}/decisions/batch={batch}"
        decisions.write.mode("overwrite").parquet(out)
        offered = arrived.select(
            "project", "objective", stored_metric(F.col("metric_value")).alias("metric_value")
        ).unionByName(stored)
        m = cost(F.col("objective"), F.col("metric_value"))
        best = (
            offered.withColumn("m", m)
            .where(F.col("m").isNotNull())
            .groupBy("project", "objective")
            .agg(F.min(F.struct("m", "metric_value"))["metric_value"].alias("metric_value"))
        )
        publish(best, f"{root}/best", batch)

    def decide_and_clean(batch_runs: DataFrame, batch: int) -> None:
        with scratch_scope(batch_runs.sparkSession):
            decide(batch_runs, batch)

    return decide_and_clean


def decide_stream(
    runs: DataFrame, root: str, bucket_seconds: int = BUCKET_SECONDS
) -> DataFrame:
    """Decide all available runs and return the table of decisions.

    Runs are ordered by (completed_at, run_id) inside a micro-batch; batches
    count in order of arrival.
    """
    drain_batches(runs, decide_batches(root, bucket_seconds), root)
    spark = runs.sparkSession
    return spark.read.parquet(f"{root}/decisions").drop("batch")
