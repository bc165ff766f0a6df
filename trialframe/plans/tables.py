"""Views of the driver tables as runs, claims, candidates, logs and diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.functions.fingerprints import (
    config_fingerprint_jvm, text_fingerprint,
)
from trialframe.session import durable
from trialframe.sources.contracts import with_defaults

METRIC = "value"
LEASE_TTL = 21_600

_STATUS_OF_EVENT = {
    "click": "completed",
    "purchase": "keep",
    "view": "discard",
    "error": "failed",
    "signup": "signup",
}


# Given, so that no job has to read footers before a query is planned.
SCHEMAS = {
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
        "value double, props string"
    ),
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, "
        "p_size int, p_retailprice double"
    ),
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
        "c_mktsegment string"
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _mapped(column, mapping: dict[str, str]):
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.element_at(F.create_map(*pairs), column)


def _project():
    return F.concat(F.lit("p"), (F.col("user_id") % 10).cast("string"))


def _objective():
    return F.when(F.col("user_id") % 2 == 0, "minimize").otherwise("maximize")


def runs_of(events: DataFrame) -> DataFrame:
    """Events as stored results."""
    base = events.select(
        _project().alias("project"),
        _objective().alias("objective"),
        F.col("user_id").cast("string").alias("agent_id"),
        F.concat(F.lit("b"), F.col("user_id") % 7).alias("branch"),
        F.lpad(F.lower(F.hex("event_id")), 12, "0").alias("run_id"),
        _mapped(F.col("event_type"), _STATUS_OF_EVENT).alias("status"),
        F.lit(METRIC).alias("metric_name"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("metric_value"),
        F.col("props").alias("config"),
        F.col("ts").alias("completed_at"),
        "event_id", "event_type",
    )
    key = config_fingerprint_jvm(F.col("config"), F.col("objective"), F.col("project"))
    return base.withColumn("fingerprint", key)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_of(table(spark, sf_dir, "events"))


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One contract per project seen in events, and one without runs.

    A table of its own, as contracts are in use: the planner knows its size.
    """
    idle = F.struct(F.lit("p10").alias("name"), F.lit("minimize").alias("objective"))
    own = F.struct(_project().alias("name"), _objective().alias("objective"))
    rows = table(spark, sf_dir, "events").select(
        F.inline(F.array(own, idle))
    ).distinct()
    return durable(
        with_defaults(
            rows.withColumns(
                {"metric": F.lit(METRIC), "claim_ttl_seconds": F.lit(LEASE_TTL)}
            )
        )
    )


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a heartbeat of its user."""
    return table(spark, sf_dir, "events").select(
        "user_id", "ts", F.col("event_id").alias("beat_id"),
        F.lit(LEASE_TTL).alias("ttl_seconds"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as proposals."""
    return (
        runs(spark, sf_dir)
        .where(F.col("event_type") == "view")
        .select(
            "project", "objective", "fingerprint", "config", "agent_id", "branch",
            F.col("completed_at").alias("ts"), F.col("event_id").alias("candidate_id"),
        )
    )


def finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as stored results."""
    return runs(spark, sf_dir).where(F.col("event_type") == "purchase")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last signup per key, with a five-day lease."""
    return (
        runs(spark, sf_dir)
        .where(F.col("event_type") == "signup")
        .groupBy("project", "fingerprint")
        .agg(F.max("completed_at").alias("claimed_at"))
        .withColumn(
            "expires_at", F.col("claimed_at") + F.expr("INTERVAL '5' DAY")
        )
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run log per event; errors print no metric."""
    printed = F.concat(
        F.lit("loss x\nmetric_value:  "),
        F.col("value").cast("decimal(18,2)").cast("string"),
        F.lit("\n"),
    )
    return table(spark, sf_dir, "events").select(
        "event_id", "event_type", "user_id", "ts", printed.alias("log")
    )


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document texts as diffs; only their fingerprints leave the scan."""
    return table(spark, sf_dir, "documents").select(
        F.lit("docs").alias("project"), F.col("doc_id").alias("run_id"),
        text_fingerprint(F.col("text")).alias("fingerprint"), "text",
    )
