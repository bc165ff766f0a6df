"""Identifiers, file names and messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: run ids are 12 hex digits.
RUN_ID_LENGTH = 12
RESULT_FILE_PATTERN = r"^([0-9a-f]{16})__([0-9a-f]{12})\.json$"


def new_run_id() -> Column:
    """Random run id.  Persist the rows before using them twice."""
    return F.substring(F.regexp_replace(F.uuid(), "-", ""), 1, RUN_ID_LENGTH)


def result_stem(fingerprint: Column, run_id: Column) -> Column:
    return F.concat(fingerprint, F.lit("__"), run_id)


def result_file_name(fingerprint: Column, run_id: Column) -> Column:
    return F.concat(result_stem(fingerprint, run_id), F.lit(".json"))


def key_from_file_name(name: Column) -> tuple[Column, Column]:
    """(fingerprint, run_id) of a result file; NULL for other names."""
    part = lambda i: F.regexp_extract(name, RESULT_FILE_PATTERN, i)
    matches = name.rlike(RESULT_FILE_PATTERN)
    return F.when(matches, part(1)), F.when(matches, part(2))


def error_text(kind: Column, message: Column) -> Column:
    """``<Type>: <message>``; an empty message keeps the colon."""
    return F.concat(kind, F.lit(": "), F.coalesce(message, F.lit("")))


def float_text(value: Column) -> Column:
    """A double spelled as Python prints it (``None`` for NULL)."""
    size = F.abs(value)
    java = value.cast("string")

    def plain(scale: int) -> Column:
        digits = value.cast(f"decimal(38,{scale})").cast("string")
        short = F.regexp_replace(digits, "0+$", "")
        return F.regexp_replace(short, r"\.$", ".0")

    mantissa = F.regexp_replace(F.substring_index(java, "E", 1), r"\.0$", "")
    exponent = F.substring_index(java, "E", -1).cast("int")
    scientific = F.concat(
        mantissa,
        F.when(exponent < 0, "e-").otherwise("e+"),
        F.lpad(
            F.abs(exponent).cast("string"),
            F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))),
            "0",
        ),
    )
    return (
        F.when(value.isNull(), "None")
        .when(F.isnan(value), "nan")
        .when(size == float("inf"), F.when(value > 0, "inf").otherwise("-inf"))
        .when((size == 0) | ((size >= 1e-3) & (size < 1e7)), java)
        .when((size >= 1e7) & (size < 1e16), plain(12))
        .when((size >= 1e-4) & (size < 1e-3), plain(30))
        .otherwise(scientific)
    )


def audit_line(
    agent_id: Column, branch: Column, fingerprint: Column, run_id: Column,
    metric_name: Column, metric_value: Column, status: Column,
) -> Column:
    """One line per stored result, for a per-branch audit trail."""
    return F.format_string(
        "agent %s [%s]: %s %s=%s status=%s",
        agent_id, branch, result_stem(fingerprint, run_id),
        metric_name, float_text(metric_value), status,
    )


def keep_message(
    agent_id: Column, branch: Column, metric_name: Column,
    metric_value: Column, description: Column,
) -> Column:
    """Message recorded when a code run is kept."""
    return F.format_string(
        "agent %s [%s]: %s=%.6f keep — %s",
        agent_id, branch, metric_name, metric_value, description,
    )
