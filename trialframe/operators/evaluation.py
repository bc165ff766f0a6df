"""User functions over tables of configs.

``evaluate(config, prior) -> dict`` runs on Arrow batches inside Spark tasks.
An exception becomes a failed row and never stops the job.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialframe.functions.fingerprints import canonical_json
from trialframe.operators.decisions import as_results
from trialframe.schemas import FAILED
from trialframe.session import durable

Evaluate = Callable[[dict, list], dict]

_EVALUATED = T.StructType(
    [
        T.StructField("metric_name", T.StringType()),
        T.StructField("metric_value", T.DoubleType()),
        T.StructField("status", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField(
            "artifact_payload", T.MapType(T.StringType(), T.StringType())
        ),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("completed_at", T.TimestampType()),
    ]
)


def _as_text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, sort_keys=True, default=str)


def _outcome(evaluate: Evaluate, config: str, prior: list) -> dict:
    try:
        answer = evaluate(json.loads(config), prior)
        metric = answer["metric_value"]
        row = {
            "metric_name": answer["metric_name"],
            "metric_value": None if metric is None else float(metric),
            "status": answer["status"],
            "error": None,
            "artifact_payload": {
                str(k): _as_text(v)
                for k, v in answer.get("artifact_payload", {}).items()
            },
        }
    except Exception as problem:  # a failing config is a result, not a fault
        row = {
            "metric_name": None,
            "metric_value": None,
            "status": FAILED,
            "error": f"{type(problem).__name__}: {problem}",
            "artifact_payload": None,
        }
    return row


def _plain(prior) -> list:
    if prior is None:
        return []
    return [row.asDict() if hasattr(row, "asDict") else dict(row) for row in prior]


def evaluate_configs(
    configs: DataFrame, evaluate: Evaluate, tasks: int | None = None
) -> DataFrame:
    """Add the outcome of ``evaluate`` to each row of ``configs``.

    Reads the columns ``config`` (JSON object) and, if present, ``prior`` (an
    array of structs handed over as a list of dicts).  Results carry clock
    times: persist them before using them twice.

    ``tasks`` spreads the rows evenly.  Configs are small and their evaluation
    is slow, so partitions sized by bytes would leave most cores idle.
    """
    if tasks:
        configs = configs.repartition(tasks)
    kept = [f for f in configs.schema.fields if f.name != "prior"]
    schema = T.StructType(kept + _EVALUATED.fields)
    names = [f.name for f in kept]
    has_prior = "prior" in configs.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            priors = batch["prior"] if has_prior else [None] * len(batch)
            for config, prior in zip(batch["config"], priors):
                started = datetime.now(timezone.utc)
                row = _outcome(evaluate, config, _plain(prior))
                row["started_at"] = started
                row["completed_at"] = datetime.now(timezone.utc)
                rows.append(row)
            outcome = pd.DataFrame(rows, columns=_EVALUATED.names, index=batch.index)
            yield pd.concat([batch[names], outcome], axis=1)

    return configs.mapInPandas(run, schema)


def evaluate_with_own_history(
    configs: DataFrame,
    results: DataFrame,
    evaluate: Callable[[dict, Iterator[dict]], dict],
    keys: tuple[str, ...] = ("project", "fingerprint"),
    order: tuple[str, ...] = ("completed_at", "run_id"),
) -> DataFrame:
    """Add the outcome of ``evaluate(config, prior)`` to each row of ``configs``.

    ``prior`` is an iterator over *all* results of the config's own ``keys``,
    failed and discarded ones and all fields included, as dicts in ascending
    ``order``.  Only results of asked keys are shuffled; each config and its
    history stream past the function in sorted order, so a task holds one Arrow
    batch however long the history is.  The function need not read it all.
    """
    own = list(configs.schema.fields)
    names, fields = [f.name for f in own], results.columns
    schema = T.StructType(own + _EVALUATED.fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    # Numbered once: a lost executor must not deal other numbers.
    asked = durable(configs.withColumn("_row", F.monotonically_increasing_id()))
    config = asked.select("_row", F.lit(0).alias("_kind"), F.struct(*names).alias("_config"))
    wanted = asked.select("_row", *[F.col(k).alias(f"_key_{k}") for k in keys])
    same = [results[k].eqNullSafe(wanted[f"_key_{k}"]) for k in keys]
    history = results.join(wanted, same).select(
        "_row", F.lit(1).alias("_kind"), F.struct(*[results[c] for c in fields]).alias("_result")
    )
    sequence = [F.col(f"_result.{c}") for c in order]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groupby(rows(batches), key=lambda r: r[0]):
            _, config, _ = next(group)
            started = datetime.now(timezone.utc)
            row = _outcome(evaluate, config["config"], (result for _, _, result in group))
            row |= {"started_at": started, "completed_at": datetime.now(timezone.utc)}
            if row["artifact_payload"] is not None:
                row["artifact_payload"] = list(row["artifact_payload"].items())
            values = [config[n] for n in names] + [row[n] for n in _EVALUATED.names]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip(values, arrow, strict=True)], names=arrow.names
            )

    return (
        config.unionByName(history, allowMissingColumns=True)
        .repartition("_row")
        .sortWithinPartitions("_row", "_kind", *sequence)
        .select("_row", "_config", "_result")
        .mapInArrow(run, schema)
    )


def with_reduced_history(
    configs: DataFrame, results: DataFrame, reduce: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Attach as ``prior`` what the user's ``reduce`` makes of *all* results.

    ``reduce`` gets every stored result, failed and discarded ones and all
    fields included, and returns a few rows per ``project``; these reach the
    evaluation as a list of dicts.  The reduction runs on Spark, so the whole
    history counts without travelling to the function.
    """
    rows = reduce(results)
    entry = F.struct(*[c for c in rows.columns if c != "project"])
    history = rows.groupBy("project").agg(F.collect_list(entry).alias("prior"))
    return configs.join(history, "project", "left")


def with_history(configs: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Attach each project's best rows as ``prior``.

    The evaluation sees at most ``leaderboard_limit`` rows per project, not
    every stored result: its size does not grow with the results.
    """
    history = snapshot.select("project", F.col("top_k").alias("prior"))
    return configs.join(history, "project", "left")


def canonicalize_configs(
    configs: DataFrame, canonicalize: Callable[[dict], dict] | None
) -> DataFrame:
    """Replace ``config`` by its canonical text, after the user's own rewrite."""
    if canonicalize is None:
        return configs.withColumn("config", canonical_json(F.col("config")))
    if not callable(canonicalize):
        raise TypeError("canonicalize must be a function of one config")

    def rewrite(raw: str) -> str:
        return json.dumps(
            canonicalize(json.loads(raw)), sort_keys=True, separators=(",", ":")
        )

    @F.pandas_udf(T.StringType())
    def rewritten(raw: pd.Series) -> pd.Series:
        return raw.map(rewrite, na_action="ignore")

    return configs.withColumn("config", rewritten("config"))


def config_results(evaluated: DataFrame, contracts: DataFrame) -> DataFrame:
    """Result rows of evaluated configs (success and failure shapes)."""
    terms = contracts.select(
        F.col("name").alias("project"), "objective",
        F.col("metric").alias("_metric"),
    )
    rows = evaluated.drop("objective").join(terms, "project", "left")
    return as_results(
        rows.withColumn("metric_name", F.coalesce("metric_name", "_metric"))
    )


def artifact_rows(evaluated: DataFrame) -> DataFrame:
    """Artifacts of successful runs as one open map; user keys override."""
    # The fields of an artifact record.
    base_columns = (
        "agent_id", "branch", "completed_at", "config", "fingerprint",
        "metric_name", "metric_value", "run_id", "started_at",
    )
    pairs = []
    for name in base_columns:
        if name in evaluated.columns:
            pairs += [F.lit(name), F.col(name).cast("string")]
    own = F.coalesce(
        F.col("artifact_payload"), F.create_map().cast("map<string,string>")
    )
    known = "agent_id" in evaluated.columns
    agent = F.col("agent_id") if known else F.lit(None).cast("string")
    return evaluated.where(F.col("status") != FAILED).select(
        agent.alias("agent_id"), "run_id",
        override(F.create_map(*pairs), own).alias("artifact"),
    )


def override(base, extra):
    """Union of two maps in which ``extra`` wins, under any session setting."""
    kept = F.map_filter(base, lambda key, _: ~F.map_contains_key(extra, key))
    return F.map_concat(kept, extra)
