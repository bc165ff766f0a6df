"""Session helpers: shared scratch space and lineage cuts."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir must name a folder shared by all executors"
        )
    fresh = tempfile.mkdtemp(prefix="trialframe-")
    spark.sparkContext.setCheckpointDir(fresh)
    return spark.sparkContext.getCheckpointDir() or fresh


def new_scratch(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other call will use.

    All paths of one application share a folder, which may be deleted when the
    application has ended.
    """
    application = spark.sparkContext.applicationId
    root = f"{shared_dir(spark).rstrip('/')}/trialframe/{application}"
    path = f"{root}/{label}-{uuid.uuid4().hex}"
    for made in getattr(_scopes, "open", [])[-1:]:
        made.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path below the shared folder, if it is there."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(place, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete at its end what :func:`new_scratch` and :func:`durable` made inside.

    For work whose results are written elsewhere, such as a micro-batch.
    """
    stack = _scopes.__dict__.setdefault("open", [])
    stack.append([])
    try:
        yield
    finally:
        for path in stack.pop():
            remove(spark, path)


def durable(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, read many times.

    Cuts lineage, so a lost executor cannot change rows that depend on
    sampling, clocks or random ids.  Columns are pruned when it is read, and
    its size is known to the planner.
    """
    spark = df.sparkSession
    path = new_scratch(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def session_conf(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Set SQL settings (dots written as ``__``) and put the old values back."""
    names = {key.replace("__", "."): value for key, value in settings.items()}
    before = {key: spark.conf.get(key, None) for key in names}
    try:
        for key, value in names.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
