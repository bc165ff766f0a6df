"""Project contracts as a table: required fields and defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.functions.clock import beat_seconds
from trialframe.schemas import (
    CODE_SECTION_DEFAULTS, CODE_SECTION_REQUIRED, CONTRACT_DEFAULTS,
    CONTRACT_REQUIRED,
)


def _required(df: DataFrame, name: str):
    problem = F.raise_error(F.lit(f"contract field '{name}' is missing"))
    if name not in df.columns:
        return problem.cast("string").alias(name)
    return F.coalesce(F.col(name), problem.cast("string")).alias(name)


def _defaulted(df: DataFrame, name: str, kind: str, default: str):
    fallback = F.expr(default).cast(kind)
    if name not in df.columns:
        return fallback.alias(name)
    return F.coalesce(F.col(name).cast(kind), fallback).alias(name)


def with_defaults(contracts: DataFrame) -> DataFrame:
    """Fill absent or NULL contract fields; raise on a missing required one.

    A contract with a ``run_command`` has a code section; its defaults apply
    only then.  Other columns are kept.
    """
    fields = [_required(contracts, name) for name in CONTRACT_REQUIRED]
    fields += [
        _defaulted(contracts, name, *spec) for name, spec in CONTRACT_DEFAULTS.items()
    ]
    known = {*CONTRACT_REQUIRED, *CONTRACT_DEFAULTS}
    if "run_command" in contracts.columns:
        has_code = F.col("run_command").isNotNull()
        for name in CODE_SECTION_REQUIRED:
            fields.append(F.when(has_code, _required(contracts, name)).alias(name))
        for name, spec in CODE_SECTION_DEFAULTS.items():
            fields.append(
                F.when(has_code, _defaulted(contracts, name, *spec)).alias(name)
            )
        known |= {*CODE_SECTION_REQUIRED, *CODE_SECTION_DEFAULTS}
    others = [c for c in contracts.columns if c not in known]
    return contracts.select(*fields, *others)


def beat_plan(contracts: DataFrame) -> DataFrame:
    """Heartbeat interval per contract, and whether it can keep a lease alive."""
    ttl = F.col("claim_ttl_seconds")
    return contracts.select(
        "name", "claim_ttl_seconds",
        beat_seconds(ttl).alias("beat_seconds"),
        (beat_seconds(ttl) >= ttl).alias("first_beat_too_late"),
    )
