"""Sinks: results, artifacts, leaderboard snapshots and audit lines."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.functions.text import audit_line
from trialframe.operators.leaderboard import RUN_KEY
from trialframe.session import durable
from trialframe.sources.readers import read_results


def _missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def append_results(results: DataFrame, path: str) -> None:
    """Append immutable results.

    Rows whose (project, fingerprint, run_id) is stored already are skipped, so
    a repeated call adds nothing.  ``results`` is evaluated once.  Partitions are rebalanced before the write:
    a hot project is split over files, small ones share a task.  Inside a file
    rows are sorted by fingerprint, so row-group statistics serve key lookups.
    """
    spark = results.sparkSession
    fresh = results.dropDuplicates(RUN_KEY)
    try:
        stored = read_results(spark, path).select(*RUN_KEY)
        # Random run ids must not differ between the check and the write, and
        # keys of known size let few new rows not shuffle the stored keys.
        fresh = durable(fresh)
        asked = fresh.select(*RUN_KEY)
        present = durable(stored.join(asked, RUN_KEY, "left_semi"))
        fresh = fresh.join(present, RUN_KEY, "left_anti")
    except AnalysisException as error:
        if not _missing(error):
            raise
    laid_out = fresh.hint("rebalance", "project").sortWithinPartitions(
        "project", "fingerprint", "run_id"
    )
    laid_out.write.mode("append").partitionBy("project").parquet(path)


def write_artifacts(artifacts: DataFrame, path: str, buckets: int | None = None) -> None:
    """One directory per agent, one JSON line per run; stored runs are skipped.

    With ``buckets`` there are so many directories, and all runs of an agent
    lie in that of its hash, in order of agents inside a file: very many
    agents need no directory each.  A path keeps the layout it began with.
    """
    keys = ["agent_id", "run_id"]
    fresh = artifacts.dropDuplicates(keys)
    try:
        stored = read_artifacts(artifacts.sparkSession, path).select(*keys)
        fresh = durable(fresh.join(stored, keys, "left_anti"))
    except AnalysisException as error:
        if not _missing(error):
            raise
    if buckets is None:
        laid_out, place = fresh.hint("rebalance", "agent_id"), "agent_id"
    else:
        dealt, place = fresh.withColumn("bucket", F.pmod(F.hash("agent_id"), F.lit(buckets))), "bucket"
        laid_out = dealt.hint("rebalance", "bucket").sortWithinPartitions("bucket", "agent_id")
    laid_out.write.mode("append").partitionBy(place).json(path)


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Artifacts of either layout."""
    schema = "run_id string, artifact map<string,string>, agent_id string"
    return spark.read.schema(schema).json(path).select("run_id", "artifact", "agent_id")


#: Versions of a snapshot that stay readable behind the newest one.
KEPT_VERSIONS = 3


def _files(spark: SparkSession, path: str):
    """Hadoop's file system for a path, and the path as its object."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _published(spark: SparkSession, root: str) -> list[tuple[int, int, str]]:
    """(version, time, name) of every published directory, oldest first."""
    files, place = _files(spark, f"{root}/published")
    if not files.exists(place):
        return []
    found = [(x.getPath().getName(), x.getModificationTime()) for x in files.listStatus(place)]
    return sorted((int(name.partition("-")[0]), at, name) for name, at in found if name[0].isdigit())


def _created(spark: SparkSession, path: str) -> bool:
    """Whether this call created the empty file; another caller may have."""
    files, place = _files(spark, path)
    if files.getUri().getScheme() == "file":
        # Hadoop looks for a local file and creates it in two steps.
        files.mkdirs(place.getParent())
        return spark.sparkContext._jvm.java.io.File(place.toUri().getPath()).createNewFile()
    try:
        files.create(place, False).close()
    except Py4JJavaError as error:
        if not files.exists(place):
            raise error
        return False
    return True


def _claim(spark: SparkSession, root: str) -> int:
    """The next version, for this caller alone.

    A version is taken by creating its claim, which fails if another caller
    has: that one then tries the next.  Needs a file system whose creation of
    an absent file is atomic.
    """
    files, place = _files(spark, f"{root}/claims")
    taken = [int(x.getPath().getName()) for x in files.listStatus(place)] if files.exists(place) else []
    version = max([*taken, *(v for v, _, _ in _published(spark, root))], default=-1) + 1
    while True:
        if not _created(spark, f"{root}/claims/{version:012d}"):
            version += 1
            continue
        for old in taken:
            if old < version - 100 * KEPT_VERSIONS:
                files.delete(_files(spark, f"{root}/claims/{old:012d}")[1], False)
        return version


def publish(snapshot: DataFrame, root: str, version: int) -> None:
    """Replace the snapshot: write a directory of its own, then mark it published.

    Readers see marked directories only, and none is ever overwritten: of two
    directories of one version the later mark counts.  Versions more than
    ``KEPT_VERSIONS`` behind the newest are removed with their marks.
    """
    spark = snapshot.sparkSession
    name = f"{version:012d}-{uuid.uuid4().hex}"
    snapshot.write.parquet(f"{root}/versions/{name}")
    files, mark = _files(spark, f"{root}/published/{name}")
    files.create(mark).close()
    marks = _published(spark, root)
    for old, _, other in marks:
        if old < marks[-1][0] - KEPT_VERSIONS:
            for path in (f"{root}/published/{other}", f"{root}/versions/{other}"):
                files, place = _files(spark, path)
                files.delete(place, True)


def version_before(spark: SparkSession, root: str, bound: int) -> int | None:
    """Latest published version below ``bound``, or None."""
    below = [v for v, _, _ in _published(spark, root) if v < bound]
    return below[-1] if below else None


def latest_version(spark: SparkSession, root: str) -> int | None:
    """Latest published version, or None."""
    return version_before(spark, root, 2**62)


def read_version(spark: SparkSession, root: str, version: int) -> DataFrame:
    names = [name for v, _, name in _published(spark, root) if v == version]
    return spark.read.parquet(f"{root}/versions/{names[-1]}")


def read_published(
    spark: SparkSession, root: str, rebuild: Callable[[], DataFrame] | None = None
) -> DataFrame:
    """The published snapshot; built and published first when there is none."""
    version = latest_version(spark, root)
    if version is None:
        if rebuild is None:
            raise FileNotFoundError(f"nothing published under {root}")
        version = 0
        publish(rebuild(), root, version)
    return read_version(spark, root, version)


def republish(snapshot: DataFrame, root: str) -> DataFrame:
    """Publish ``snapshot`` as the next version and return it as stored.

    Callers at the same time get versions of their own, so none is lost.
    """
    spark = snapshot.sparkSession
    version = _claim(spark, root)
    publish(snapshot, root, version)
    return read_version(spark, root, version)


def audit_lines(results: DataFrame, contracts: DataFrame | None = None) -> DataFrame:
    """Branch and audit line of each result.

    With contracts, only for projects whose contract sets ``git_sync``.
    """
    if contracts is not None:
        synced = contracts.where("git_sync").select(F.col("name").alias("project"))
        results = results.join(synced, "project", "left_semi")
    return results.select(
        "branch",
        audit_line(
            F.col("agent_id"), F.col("branch"), F.col("fingerprint"),
            F.col("run_id"), F.col("metric_name"), F.col("metric_value"),
            F.col("status"),
        ).alias("line"),
    )


def write_audit(
    results: DataFrame, path: str, contracts: DataFrame | None = None
) -> None:
    """Append audit lines as text, one directory per branch; stored lines are skipped."""
    fresh = audit_lines(results, contracts).distinct()
    try:
        stored = results.sparkSession.read.schema("value string, branch string").text(path)
        same = (fresh["branch"] == stored["branch"]) & (fresh["line"] == stored["value"])
        fresh = durable(fresh.join(stored, same, "left_anti"))
    except AnalysisException as error:
        if not _missing(error):
            raise
    lines = fresh.hint("rebalance", "branch")
    lines.write.mode("append").partitionBy("branch").text(path)
