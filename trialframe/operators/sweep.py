"""Parameter sweeps whose evaluation is a Spark aggregation.

The data is scanned once, however many points the grid has.  A general sweep
takes the points in blocks: inside the scan each row meets every block, whose
points are side-by-side aggregates that are combined before anything is
shuffled.  A threshold sweep counts rows once per gap between thresholds.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from datetime import date, datetime

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Grid points that are aggregates of the same row; more than some ten make the generated code too long.
POINTS_PER_ROW = 8


def _kind(values: list) -> T.DataType:
    """Type of a parameter, as a literal of each of its values would have it."""
    found = {type(v) for v in values if v is not None}
    if found <= {bool}:
        return T.BooleanType()
    if found <= {int}:
        small = all(-(1 << 31) <= v < 1 << 31 for v in values if v is not None)
        return T.IntegerType() if small else T.LongType()
    if found <= {int, float}:
        return T.DoubleType()
    for python, kind in ((str, T.StringType()), (datetime, T.TimestampNTZType()), (date, T.DateType())):
        if found <= {python}:
            return kind
    raise TypeError(f"parameter values of types {sorted(t.__name__ for t in found)}")


def _literal(value: list, kind: T.DataType) -> Column:
    """A nested list as one literal (not an expression per element)."""
    text = json.dumps(value, default=lambda x: x.isoformat())
    return F.from_json(F.lit(text), T.ArrayType(kind))


def sweep_aggregate(
    data: DataFrame,
    grid: Sequence[dict],
    measures: Callable[[dict[str, Column]], dict[str, Column]],
    points_per_row: int = POINTS_PER_ROW,
) -> DataFrame:
    """One row per grid point: its parameters and its aggregate measures.

    ``measures`` turns a grid point, whose values are columns, into named
    aggregate columns over ``data``.  All points have the same parameters, of
    one type each (bool, int, float, str, date or datetime; None is null).
    """
    if not grid:
        raise ValueError("the grid is empty")
    names = list(grid[0])
    if any(list(point) != names for point in grid):
        raise ValueError("grid points differ in their parameters")
    point = T.StructType([T.StructField(n, _kind([p[n] for p in grid])) for n in names])
    width = min(points_per_row, len(grid))
    blocks = [list(grid[i : i + width]) for i in range(0, len(grid), width)]
    every = _literal(blocks, T.ArrayType(point))
    one = len(blocks) == 1
    block = F.lit(0) if one else F.col("_block")
    # Only the block's number goes into the rows; its points stay in the literal.
    wide = data if one else data.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(blocks) - 1))).alias("_block"))

    def cell(i: int) -> Column:
        own = F.get(F.get(every, block), F.lit(i))
        found = measures({n: own[n] for n in names})
        return F.struct(*[column.alias(name) for name, column in found.items()]).alias(f"_cell_{i}")

    cells = [cell(i) for i in range(width)]
    summed = wide.agg(*cells) if one else wide.groupBy("_block").agg(*cells)
    rows = F.array(*[F.struct(F.lit(i).alias("_i"), F.col(f"_cell_{i}").alias("_m")) for i in range(width)])
    told = summed.select(block.alias("_block"), F.inline(rows))
    if not one:
        # Blocks that met no row have what the measures give on no rows.
        none = data.where(F.lit(False)).withColumn("_block", F.lit(0))
        empty = none.agg(cells[0]).select(F.col("_cell_0").alias("_none"))
        spark = data.sparkSession
        all_rows = spark.range(len(blocks)).select(F.col("id").cast("int").alias("_block"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("_i"))
        told = (
            all_rows.join(told, ["_block", "_i"], "left")
            .join(F.broadcast(empty), F.lit(True), "left")
            .withColumn("_m", F.coalesce("_m", "_none"))
        )
    own = F.get(F.get(every, F.col("_block")), F.col("_i"))
    return told.select(own.alias("_p"), "_m").where("_p is not null").select("_p.*", "_m.*")


def sweep_thresholds(
    data: DataFrame, value: str, label: str, thresholds: Sequence[float]
) -> DataFrame:
    """Accuracy counts of ``value > threshold`` as predictor of a 0/1 label.

    Returns threshold, hits, n for each threshold.  Rows with a NULL value or
    label are left out; NaN is above every threshold.  Values are compared as
    doubles.
    """
    bounds = sorted(set(thresholds))
    # Buckets are closed below, a threshold is passed above: hence the negative values.
    gaps = Bucketizer(
        splits=[float("-inf"), *[-float(b) for b in reversed(bounds)], float("inf")],
        inputCol="_below", outputCol="_gap", handleInvalid="keep",
    )
    known = data.where(F.col(value).isNotNull() & F.col(label).isNotNull()).select(
        (-F.col(value).cast("double")).alias("_below"), F.col(label).alias("_label")
    )
    passed = F.when(F.isnan("_below"), len(bounds)).otherwise(F.lit(len(bounds)) - F.col("_gap").cast("int"))
    counted = (
        gaps.transform(known)
        .groupBy(passed.alias("gap"))
        .agg(
            F.count_if(F.col("_label") == 1).alias("ones"),
            F.count_if(F.col("_label") == 0).alias("zeros"),
            F.count("*").alias("rows"),
        )
    )
    # Few rows from here on: one per gap and one per threshold.
    points = data.sparkSession.range(1).select(
        F.posexplode(_literal(bounds, _kind(bounds))).alias("gap", "threshold")
    )
    everything = counted.unionByName(points, allowMissingColumns=True)
    whole = Window.partitionBy(F.lit(1))
    upto = whole.orderBy("gap", F.col("threshold").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, 0
    )
    zeros_below = F.coalesce(F.sum("zeros").over(upto), F.lit(0))
    ones_below = F.coalesce(F.sum("ones").over(upto), F.lit(0))
    all_ones = F.coalesce(F.sum("ones").over(whole), F.lit(0))
    return everything.select(
        "threshold",
        (zeros_below + all_ones - ones_below).alias("hits"),
        F.coalesce(F.sum("rows").over(whole), F.lit(0)).alias("n"),
    ).where(F.col("threshold").isNotNull())


def expand_seeds(configs: DataFrame, contracts: DataFrame) -> DataFrame:
    """Each config once per seed of its project's pool."""
    pools = contracts.select(F.col("name").alias("project"), "default_seed_pool")
    return configs.join(pools, "project", "inner").select(
        *configs.columns, F.explode("default_seed_pool").alias("seed")
    )


def expand_grid(base: DataFrame, parameters: dict[str, Sequence]) -> DataFrame:
    """Every combination of parameter values, for each row of ``base``."""
    for name, values in parameters.items():
        base = base.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return base
