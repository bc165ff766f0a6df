"""Sources: results, claims, configs, logs and the published leaderboard.

Parquet is the main format.  JSON is for interchange: either one record per
file, named by key, or one record per line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialframe.functions.fingerprints import canonical_json
from trialframe.functions.text import key_from_file_name
from trialframe.schemas import (
    CLAIM_JSON_SCHEMA, CLAIM_SCHEMA, RESULT_JSON_SCHEMA, RESULT_SCHEMA,
)

CORRUPT = "_corrupt_record"
#: Stands behind every config of a file that holds many; valid JSON has no such character.
SEPARATOR = "\x1e"


def _json(
    spark: SparkSession, path: str, schema: T.StructType, one_per_file: bool,
    on_error: str,
) -> DataFrame:
    reader = (
        spark.read.schema(schema)
        .option("multiLine", one_per_file)
        .option("pathGlobFilter", "*.json")
        .option("recursiveFileLookup", False)
    )
    if on_error == "raise":
        return reader.option("mode", "FAILFAST").json(path)
    if on_error != "quarantine":
        raise ValueError("on_error must be 'quarantine' or 'raise'")
    with_bad = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return (
        reader.schema(with_bad)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )


def with_times(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Epoch seconds as timestamps, for the time columns of ``schema``."""
    # Rounded to the microsecond: timestamp_seconds() would cut it off.
    times = {
        field.name: F.timestamp_micros(
            F.round(F.col(field.name) * 1_000_000).cast("long")
        )
        for field in schema.fields
        if isinstance(field.dataType, T.TimestampType)
    }
    return df.withColumns(times)


def scan_results(
    spark: SparkSession, path: str, one_per_file: bool = True,
    on_error: str = "quarantine", in_file_order: bool = False,
) -> DataFrame:
    """Stored results from JSON files; epoch seconds become timestamps.

    ``quarantine`` keeps unreadable records in the column ``_corrupt_record``;
    ``raise`` fails the job.  Fingerprint and run id missing from a record are
    taken from its file name.
    """
    rows = with_times(
        _json(spark, path, RESULT_JSON_SCHEMA, one_per_file, on_error), RESULT_SCHEMA
    )
    if one_per_file:
        fingerprint, run_id = key_from_file_name(F.col("_metadata.file_name"))
        rows = rows.withColumns(
            {
                "fingerprint": F.coalesce("fingerprint", fingerprint),
                "run_id": F.coalesce("run_id", run_id),
            }
        )
    return rows.orderBy("fingerprint", "run_id") if in_file_order else rows


def scan_claims(
    spark: SparkSession, path: str, one_per_file: bool = True,
    on_error: str = "quarantine",
) -> DataFrame:
    """Claims from JSON files.  An unreadable claim has no expiry."""
    return with_times(
        _json(spark, path, CLAIM_JSON_SCHEMA, one_per_file, on_error), CLAIM_SCHEMA
    )


def _with_key(condition: Column) -> Column:
    # Spark refuses to read the text of unreadable records alone, so the
    # condition reads the key as well; it is always true.
    return condition & (F.length(F.coalesce("fingerprint", F.lit(""))) >= 0)


def clean(df: DataFrame) -> DataFrame:
    """Readable records only."""
    return df.where(_with_key(F.col(CORRUPT).isNull())).drop(CORRUPT)


def quarantined(df: DataFrame) -> DataFrame:
    """Text of unreadable records."""
    return df.where(_with_key(F.col(CORRUPT).isNotNull())).select(CORRUPT)


def has_completed(spark: SparkSession, path: str, fingerprint: str) -> bool:
    """Is there a result file of this fingerprint?  Opens no other file."""
    names = (
        spark.read.format("text")
        .option("pathGlobFilter", f"{fingerprint}__*.json")
        .load(path)
        .select("_metadata.file_name")
    )
    return not names.isEmpty()


def is_object(config: Column) -> Column:
    """True for text that is one JSON object and nothing else."""
    return F.coalesce(canonical_json(config).startswith("{"), F.lit(False))


def config_objects(
    configs: DataFrame, column: str = "config", on_error: str = "drop"
) -> DataFrame:
    """Configs whose text is a JSON object.

    Lists, scalars and junk are left out, or fail the job with ``raise``.
    """
    valid = is_object(F.col(column))
    if on_error == "raise":
        problem = F.raise_error(F.lit("a config must be a JSON object"))
        return configs.withColumn(
            column, F.when(valid, F.col(column)).otherwise(problem.cast("string"))
        )
    if on_error != "drop":
        raise ValueError("on_error must be 'drop' or 'raise'")
    return configs.where(valid)


def read_config_files(
    spark: SparkSession, path: str, on_error: str = "drop", separator: str | None = None
) -> DataFrame:
    """One row per config file: ``path`` and ``config``.

    With ``separator`` a file holds many configs, each ended by it, and there
    is one row per config.  Very many configs need no file each then.
    """
    files = spark.read.text(path, wholetext=separator is None, lineSep=separator)
    return config_objects(
        files.select(
            F.col("_metadata.file_path").alias("path"), F.col("value").alias("config")
        ),
        on_error=on_error,
    )


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """One row per log file: ``path`` and the whole ``log``."""
    files = spark.read.text(path, wholetext=True)
    return files.select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("log")
    )


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Results table in Parquet, partitioned by project."""
    return spark.read.schema(RESULT_SCHEMA).parquet(path)
