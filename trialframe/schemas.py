"""Record shapes: results, claims, artifacts and contracts as Spark schemas.

Every time column is a timestamp in the tables.  JSON interchange files hold
epoch seconds as numbers; the readers convert them.
"""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(kind: T.DataType, *names: str) -> list[T.StructField]:
    return [T.StructField(name, kind, True) for name in names]


_RESULT_KEYS = _fields(
    T.StringType(),
    "project", "objective", "fingerprint", "run_id", "agent_id", "branch",
    "search_group", "base_commit", "new_commit", "status", "metric_name",
)
_RESULT_VALUES = _fields(T.DoubleType(), "metric_value")
_RESULT_PAYLOAD = _fields(
    T.StringType(), "error", "config", "description", "diff", "artifact_path",
)

#: One superset schema for the five result shapes (absent fields are NULL).
RESULT_SCHEMA = T.StructType(
    _RESULT_KEYS + _RESULT_VALUES + _RESULT_PAYLOAD
    + _fields(T.TimestampType(), "started_at", "completed_at")
)

#: The same record as it appears in JSON files.
RESULT_JSON_SCHEMA = T.StructType(
    _RESULT_KEYS + _RESULT_VALUES + _RESULT_PAYLOAD
    + _fields(T.DoubleType(), "started_at", "completed_at")
)

_CLAIM_TEXT = _fields(
    T.StringType(),
    "agent_id", "base_commit", "branch", "config", "description",
    "fingerprint", "search_group", "thread",
)
CLAIM_SCHEMA = T.StructType(
    _CLAIM_TEXT + _fields(T.TimestampType(), "claimed_at", "expires_at")
)
CLAIM_JSON_SCHEMA = T.StructType(
    _CLAIM_TEXT + _fields(T.DoubleType(), "claimed_at", "expires_at")
)

#: Columns the ranking needs, and nothing more.
RANKING_COLUMNS = (
    "project", "objective", "fingerprint", "run_id", "status",
    "metric_name", "metric_value",
)

# Contract fields, their types and their defaults.
CONTRACT_REQUIRED = ("name", "metric", "objective")
CONTRACT_DEFAULTS = {
    "registry_dir": ("string", "'registry'"),
    "artifact_dir": ("string", "'runs'"),
    "claim_ttl_seconds": ("int", "300"),
    "leaderboard_limit": ("int", "10"),
    "git_sync": ("boolean", "false"),
    "runner_entry": ("string", "'projects.py'"),
    "runner_evaluate": ("string", "'evaluate_config'"),
    "runner_canonicalize": ("string", "'canonicalize_config'"),
    "search_groups": ("array<string>", "array('explore')"),
    "default_seed_pool": ("array<int>", "array(7, 13, 21, 42)"),
}
# Fields of the optional code section; the first two are required in it.
CODE_SECTION_REQUIRED = ("run_command", "metric_pattern")
CODE_SECTION_DEFAULTS = {
    "log_file": ("string", "'run.log'"),
    "timeout_seconds": ("int", "600"),
    "editable_files": ("array<string>", "array()"),
    "frozen_files": ("array<string>", "array()"),
}

# Result statuses.
RANKABLE_STATUSES = ("completed", "keep")
DISCARD, FAILED, KEEP, COMPLETED = "discard", "failed", "keep", "completed"
