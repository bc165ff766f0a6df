"""Metric extraction from run logs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the documented metric pattern.
DEFAULT_METRIC_PATTERN = r"^metric_value:\s+([0-9.]+)"

# Number texts Python's float() accepts; digits may be grouped by single "_".
_DIGITS = "[0-9]+(?:_[0-9]+)*"
_NUMBER = (
    rf"(?i)^[+-]?(?:(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?"
    r"|inf|infinity|nan)\z"
)


def java_pattern(pattern: str) -> str:
    """A multi-line pattern in Java spelling.

    Only \\n ends a line, and classes such as ``\\s`` cover Unicode, as in Python.
    """
    return "(?mdU)" + re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern)


def _java_pattern_of(pattern: Column) -> Column:
    named = F.regexp_replace(pattern, r"\(\?P<(\w+)>", r"(?<$1>")
    return F.concat(F.lit("(?mdU)"), named)


def log_metric(log: Column, pattern: str | Column = DEFAULT_METRIC_PATTERN) -> Column:
    """Group 1 of the first match as a double; NULL without a match.

    Captured text that is no number, such as ``1.2.3``, also gives NULL.  The
    pattern may be a column, such as the one of a contract.
    """
    if isinstance(pattern, str):
        java = F.lit(java_pattern(pattern))
    else:
        java = _java_pattern_of(pattern)
    found = F.trim(F.call_function("regexp_extract", log, java, F.lit(1)))
    return F.when(
        found.rlike(_NUMBER), F.regexp_replace(found, "_", "").try_cast("double")
    )
