"""Metric direction, comparison and rounding as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trialframe.schemas import RANKABLE_STATUSES


def _unsupported(objective: Column, as_type: str) -> Column:
    # Fixed value: the error text that callers match.
    shown = F.coalesce(objective, F.lit("NULL"))
    return F.raise_error(
        F.concat(F.lit("Unsupported objective: "), shown)
    ).cast(as_type)


def cost(objective: Column, metric: Column) -> Column:
    """The metric turned so that smaller is better.

    NULL and NaN metrics give NULL (not rankable); an objective other than
    minimize or maximize raises.  ``0 - x`` keeps zero positive.
    """
    usable = F.when(~F.isnan(metric), metric)
    return (
        F.when(objective == "minimize", usable)
        .when(objective == "maximize", F.lit(0.0) - usable)
        .otherwise(_unsupported(objective, "double"))
    )


def metric_of(objective: Column, cost_value: Column) -> Column:
    """Inverse of :func:`cost`."""
    return F.when(objective == "maximize", F.lit(0.0) - cost_value).otherwise(
        cost_value
    )


def better(objective: Column, left: Column, right: Column) -> Column:
    """Strictly better under the objective; a tie is not better."""
    return (
        F.when(objective == "minimize", left < right)
        .when(objective == "maximize", left > right)
        .otherwise(_unsupported(objective, "boolean"))
    )


def is_rankable(status: Column) -> Column:
    """Statuses that take part in ranking."""
    return status.isin(*RANKABLE_STATUSES)


def stored_metric(metric: Column, scale: int = 6) -> Column:
    """Metric as a code run stores it."""
    return F.round(metric, scale)
