"""Running values over ordered groups, safe for very large groups.

A window over one key puts all rows of that key in one task.  Where the order
begins with a time, :func:`running_in_buckets` splits every key by time buckets:
one aggregate per bucket, a running value over these, and a window inside each
bucket that begins with what came before it.  It is one lazy plan for all sizes.

For other orders, and chains of running values: when the largest
group is above a row bound, the rows are range-partitioned by (keys, order)
instead, which splits a hot key over many tasks.  Each partition is a *chunk*:
running values are taken inside a chunk, and what came before it is added from
a small table with one row per (key, chunk).

The chunk number must not change between two reads of the rows, so chunked
rows are written once to the shared folder (range bounds come from sampling).
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from trialframe.session import durable

#: Most rows one task sorts: larger keys are split into chunks of this size.
MAX_GROUP_ROWS = 4_000_000

CHUNK = "_chunk"

_AGGREGATES = {"min": F.min, "max": F.max, "sum": F.sum, "xor": F.bit_xor}


def _plus(here: Column, before: Column) -> Column:
    return F.when(here.isNull(), before).otherwise(
        here + F.coalesce(before, F.lit(0))
    )


def _xor(here: Column, before: Column) -> Column:
    return F.when(here.isNull(), before).otherwise(
        here.bitwiseXOR(F.coalesce(before, F.lit(0)))
    )


_COMBINE = {"min": F.least, "max": F.greatest, "sum": _plus, "xor": _xor}


def time_bucket(time: Column, kind: DataType, seconds: int) -> Column:
    """Number of the bucket of ``seconds`` that a timestamp (with or without zone) is in; ascends with it."""
    since = time - F.lit("1970-01-01 00:00:00").cast(kind)
    parts = {"DAY": 86_400, "HOUR": 3_600, "MINUTE": 60, "SECOND": 1}
    whole = reduce(Column.__add__, [F.extract(F.lit(k), since).cast("long") * F.lit(n) for k, n in parts.items()])
    return F.floor(whole / F.lit(seconds)).cast("long")


def running_in_buckets(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column,
    name: str, how: str, value: Column, include_current: bool = False,
) -> DataFrame:
    """``df`` with the running ``how`` (min, max or sum) of ``value`` per ``keys`` as ``name``.

    ``bucket`` must not descend along ``order``; a task holds the rows of one
    bucket of one key.  What came before a bucket enters it as a row of its
    own that sorts first, so no join is needed.  NULL values are skipped;
    without any value the result is NULL.
    """
    aggregate = _AGGREGATES[how]
    rows = df.withColumns({"_bucket": bucket, "_value": value, "_own": F.lit(1)})
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_bucket").agg(aggregate("_value").alias("_total"))
    before = totals.select(
        *keys, "_bucket", aggregate("_total").over(earlier).alias("_value"), F.lit(0).alias("_own")
    ).where(F.col("_value").isNotNull())
    inside = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy("_own", *order)
        .rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    )
    return (
        rows.unionByName(before, allowMissingColumns=True)
        .withColumn(name, aggregate("_value").over(inside))
        .where("_own = 1")
        .drop("_bucket", "_value", "_own")
    )


def group_sizes(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """Rows of the most frequent key, and of all keys (reads the keys only)."""
    row = df.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first()
    return int(row[0] or 0), int(row[1] or 0)


@dataclass(frozen=True)
class OrderedGroups:
    """Rows with their group keys and a total order inside each group."""

    rows: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    chunked: bool
    #: Keys with rows in several chunks; there are fewer of them than chunks.
    spanning: DataFrame | None = None
    #: Chunked rows that a window still has to compute.
    pending: bool = False

    @property
    def group(self) -> list[str]:
        return [*self.keys, CHUNK] if self.chunked else list(self.keys)

    def with_columns(self, **columns: Column) -> OrderedGroups:
        """Row-wise columns; keys, order and chunking stay as they are."""
        return replace(self, rows=self.rows.withColumns(columns))

    def running(
        self, name: str, how: str, value: Column, include_current: bool = False
    ) -> OrderedGroups:
        """Add the running ``how`` (min, max, sum or xor) of ``value`` as ``name``.

        NULL values are skipped; without any earlier value the result is NULL.
        """
        aggregate = _AGGREGATES[how]
        window = (
            Window.partitionBy(*self.group)
            .orderBy(*self.order)
            .rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
        )
        local = aggregate(value).over(window)
        if not self.chunked:
            return replace(self, rows=self.rows.withColumn(name, local))
        # Chunked rows are read twice, so earlier windows are written first:
        # a chain of running values costs one pass each.
        rows = durable(self.rows) if self.pending else self.rows
        carried = self._carried(rows, aggregate, value)
        # The join follows the window, so the shuffle carries no extra column.
        rows = (
            self._attach(rows.withColumn("_local", local), carried)
            .withColumn(name, _COMBINE[how](F.col("_local"), F.col("_before")))
            .drop("_local", "_before")
        )
        return replace(self, rows=rows, pending=True)

    def _carried(self, rows: DataFrame, aggregate, value: Column) -> DataFrame:
        # One value per (key, chunk) whose key has a value in an earlier chunk.
        # Rows are sorted by key first, so at most one key per chunk qualifies:
        # the table has no more rows than there are chunks.
        earlier = (
            Window.partitionBy(*self.keys)
            .orderBy(CHUNK)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        needed = rows.join(
            F.broadcast(self.spanning), self._same_key(rows, self.spanning), "left_semi"
        )
        totals = needed.groupBy(*self.group).agg(aggregate(value).alias("_total"))
        return totals.select(
            *[F.col(key).alias(f"_key_{key}") for key in self.keys],
            F.col(CHUNK).alias("_in_chunk"),
            aggregate("_total").over(earlier).alias("_before"),
        ).where(F.col("_before").isNotNull())

    def _same_key(self, rows: DataFrame, keyed: DataFrame) -> Column:
        same = [
            rows[key].eqNullSafe(keyed[f"_key_{key}"]) for key in self.keys
        ]
        return reduce(Column.__and__, same)

    def _attach(self, rows: DataFrame, carried: DataFrame) -> DataFrame:
        here = self._same_key(rows, carried) & (rows[CHUNK] == carried["_in_chunk"])
        joined = rows.join(F.broadcast(carried), here, "left")
        return joined.drop("_in_chunk", *[f"_key_{key}" for key in self.keys])

    def result(self) -> DataFrame:
        return self.rows.drop(CHUNK) if self.chunked else self.rows


def ordered_groups(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    max_group_rows: int = MAX_GROUP_ROWS,
) -> OrderedGroups:
    """Prepare ``df`` for running values per ``keys`` in ascending ``order``.

    ``max_group_rows`` of 0 splits at the default size whatever the largest key.
    ``order`` must be unique inside a group.  Pass only columns that are
    needed: a chunked frame is written to the shared folder.
    """
    largest, total = group_sizes(df, keys)
    if largest <= max_group_rows:
        return OrderedGroups(df, tuple(keys), tuple(order), False)
    at_least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(at_least, -(-total // (max_group_rows or MAX_GROUP_ROWS)))
    ranged = df.repartitionByRange(chunks, *keys, *order).withColumn(
        CHUNK, F.spark_partition_id()
    )
    rows = durable(ranged)
    spanning = (
        rows.groupBy(*keys)
        .agg(F.min(CHUNK).alias("_first"), F.max(CHUNK).alias("_last"))
        .where("_first < _last")
        .select(*[F.col(key).alias(f"_key_{key}") for key in keys])
    )
    return OrderedGroups(rows, tuple(keys), tuple(order), True, durable(spanning))
