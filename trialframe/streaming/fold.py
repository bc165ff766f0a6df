"""A state machine per key over rows in order, as a parallel scan.

The rows are split into ranges of (key, order), so the rows of a busy key lie in
many chunks.  Of each chunk that a key shares with others, the machine composes
the events into one transition: what state it ends in, whatever state it began
in.  Transitions are applied along the chunks of a key, which gives the state at
the start of each; then all chunks are played at once, each from its own start.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialframe.session import durable

CHUNK, START, MORE = "_chunk", "_start", "_more"


class Fold(Protocol):
    """The machine of one key."""

    #: What later rows depend on; may be read and set.
    state: Any

    def row(self, *values) -> list[tuple]:
        """Take the next row (without its key); give output rows (without key)."""

    def finish(self) -> list[tuple]:
        """Output rows after the last row of the key."""


class Transition(Protocol):
    """The events of a chunk as one function of the state before them."""

    def after(self, state: Any) -> Any:
        """The state after the chunk, from the state before it."""


class Machine(Protocol):
    """Makes folds, and composes rows into transitions; sent to tasks."""

    def fold(self) -> Fold: ...

    def transition(self, rows: list[tuple]) -> Transition: ...


def _same(left: DataFrame, right: DataFrame, names: list[str]):
    both = None
    for k in names:
        one = left[k].eqNullSafe(right[f"_key_{k}"])
        both = one if both is None else both & one
    return both


def chunks(rows: DataFrame, keys: list[str], order: list[str], count: int) -> DataFrame:
    """``rows`` in ``count`` ranges of (keys, order), numbered in ``_chunk`` and written once."""
    ranged = rows.repartitionByRange(count, *keys, *order).sortWithinPartitions(*keys, *order)
    return durable(ranged.withColumn(CHUNK, F.spark_partition_id()))


def _split(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, tuple]]:
    """The first columns of each row, and the others."""
    for batch in batches:
        for values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            yield values[:width], values[width:]


def _records(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=schema.names)


def _starts(
    placed: DataFrame, spans: DataFrame, keys: list[str], order: list[str], fields: list[str],
    machine: Machine, count: int,
) -> DataFrame:
    """``keys, _chunk, _start``: the pickled state at the start of each chunk of a key but its first."""
    from pyspark.sql.pandas.types import to_arrow_schema

    key_fields = [placed.schema[k] for k in keys]
    schema = T.StructType([*key_fields, T.StructField(CHUNK, T.IntegerType()), T.StructField(START, T.BinaryType())])
    arrow = to_arrow_schema(schema)
    width = len(keys)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows = None, []

        def made() -> pa.RecordBatch:
            return _records([(*own[1:], own[0], pickle.dumps(machine.transition(rows)))], arrow)

        for key, values in _split(batches, width + 1):
            if key != own:
                if own is not None:
                    yield made()
                own, rows = key, []
            rows.append(values)
        if own is not None:
            yield made()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = None, None
        for key, (chunk, composed) in _split(batches, width):
            if key != own:
                own, state = key, machine.fold().state
            else:
                yield _records([(*key, chunk, pickle.dumps(state))], arrow)
            if composed is not None:
                state = pickle.loads(composed).after(state)

    named = spans.select(*[F.col(k).alias(f"_key_{k}") for k in keys], "_last")
    shared = placed.join(F.broadcast(named), _same(placed, named, keys)).where(F.col(CHUNK) < F.col("_last"))
    composed = (
        shared.select(CHUNK, *keys, *fields)
        .repartitionById(count, F.col(CHUNK))
        .sortWithinPartitions(CHUNK, *keys, *order)
        .mapInArrow(compose, schema)
    )
    # The last chunk of a key needs its start only.
    ends = spans.select(*keys, F.col("_last").alias(CHUNK), F.lit(None).cast("binary").alias(START))
    return composed.unionByName(ends).repartition(*keys).sortWithinPartitions(*keys, CHUNK).mapInArrow(apply, schema)


def fold_in_order(
    rows: DataFrame, keys: list[str], order: list[str], machine: Machine, schema: T.StructType,
    count: int | None = None,
) -> DataFrame:
    """Play the rows of each key in ascending ``order`` through a machine.

    A task holds one Arrow batch and one state while it plays; while it
    composes, the rows of a busy key in one of ``count`` chunks (the number of
    shuffle partitions by default).  At most one key of a chunk goes on in the
    next, so there are fewer transitions and starts than chunks.  ``schema`` is
    the keys' fields and those of the output rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, width = to_arrow_schema(schema), len(keys)
    spark = rows.sparkSession
    fields = [c for c in rows.columns if c not in keys]
    count = count or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = chunks(rows, keys, order, count)
    spans = durable(
        placed.groupBy(*keys).agg(F.min(CHUNK).alias("_first"), F.max(CHUNK).alias("_last")).where("_first < _last")
    )
    starts = durable(_starts(placed, spans, keys, order, fields, machine, count))
    named = spans.select(*[F.col(k).alias(f"_key_{k}") for k in keys], "_last")
    begun = placed.unionByName(starts, allowMissingColumns=True)
    flagged = begun.join(F.broadcast(named), _same(begun, named, keys), "left").select(
        CHUNK, *keys, F.coalesce(F.col(CHUNK) < F.col("_last"), F.lit(False)).alias(MORE), START, *fields
    )

    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, fold, more, out = None, None, False, []
        for key, (goes_on, start, *values) in _split(batches, width + 1):
            if key != own:
                if fold is not None and not more:
                    out += [(*own[1:], *r) for r in fold.finish()]
                own, fold, more = key, machine.fold(), goes_on
            if start is not None:
                fold.state = pickle.loads(start)
            else:
                out += [(*key[1:], *r) for r in fold.row(*values)]
            if len(out) >= 8192:
                yield _records(out, arrow)
                out = []
        if fold is not None and not more:
            out += [(*own[1:], *r) for r in fold.finish()]
        if out:
            yield _records(out, arrow)

    # A start sorts before the rows of its chunk.
    return (
        flagged.repartitionById(count, F.col(CHUNK))
        .sortWithinPartitions(CHUNK, *keys, F.col(START).isNull(), *order)
        .mapInArrow(play, schema)
    )


def touched(state: DataFrame, rows: DataFrame, keys: list[str], how: str) -> DataFrame:
    """State rows whose key is (``left_semi``) or is not (``left_anti``) among ``rows``."""
    asked = rows.select(*[rows[k].alias(f"_key_{k}") for k in keys]).distinct()
    return state.join(asked, _same(state, asked, keys), how)
