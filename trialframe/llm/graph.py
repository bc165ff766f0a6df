"""Connected components by star contraction, and grouped work in sorted partitions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.session import durable


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every end of the edges ``(a, b)``.

    The component is the smallest id that links reach.  Edges with a null end
    are ignored, as are loops.  Each round turns the edges towards the
    smallest neighbour, first of the larger ends and then of the smaller
    ones; only minima per id are aggregated, so a hub is combined before it
    is shuffled.  A round is written to the shared folder.
    """
    stars = durable(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
    )
    before = None
    while True:
        mark = tuple(
            stars.agg(
                F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.hash("hi", "lo"))
            ).first()
        )
        if mark == before or mark[0] == 0:
            break
        before = mark
        both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            stars.select("lo", "hi")
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u"), F.least("u", "m").alias("m")
        )
        large = both.join(least, "u").where("v > u and v <> m").select(
            F.col("v").alias("hi"), F.col("m").alias("lo")
        )
        floor = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(floor, "hi").select(
            F.explode(
                F.array(
                    F.struct(F.col("hi"), F.col("m").alias("lo")),
                    F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")),
                )
            ).alias("e")
        )
        stars = durable(small.select("e.hi", "e.lo").where("hi <> lo").distinct())
    ends = stars.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    roots = stars.select(F.col("lo").alias("id"), F.col("lo").alias("component"))
    return ends.union(roots).distinct()


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables with all rows of one key, from batches sorted by the first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = [batch.column(k).to_pylist() for k in range(keys)]
        marks = list(zip(*parts, strict=True))
        begin = 0
        for i, mark in enumerate(marks):
            if mark != last:
                if last is not None:
                    if i > begin:
                        held.append(batch.slice(begin, i - begin))
                    yield pa.Table.from_batches(held)
                held, begin, last = [], i, mark
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


#: A table is broadcast only if its rows are known to take no more than this.
BROADCAST_BYTES = 32 << 20


def fitting(table: DataFrame, row_bytes: int) -> DataFrame:
    """``table`` (read from storage) with a broadcast hint where its counted rows fit.

    A larger table goes without the hint, so that the join shuffles; the
    result is the same.
    """
    return F.broadcast(table) if table.count() * row_bytes <= BROADCAST_BYTES else table
