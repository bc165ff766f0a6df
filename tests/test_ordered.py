"""Running values: the plain window and the chunked path agree with a loop."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from trialframe.operators.ordered import group_sizes, ordered_groups, running_in_buckets, time_bucket

SCHEMA = "k string, t long, id long, v double"


def rows_with_hot_key(n=600, seed=3):
    rng = random.Random(seed)
    return [
        ("hot" if rng.random() < 0.6 else f"k{rng.randrange(6)}",
         rng.randrange(4) if rng.random() < 0.5 else rng.randrange(1000), i,
         None if rng.random() < 0.2 else float(rng.randrange(50)))
        for i in range(n)
    ]


def loop(rows, how, inclusive):
    fold = {"min": min, "max": max, "sum": lambda a, b: a + b}[how]
    state, out = {}, {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        before = state.get(k)
        after = before if v is None else v if before is None else fold(before, v)
        out[i] = after if inclusive else before
        state[k] = after
    return out


@pytest.mark.parametrize("bound", [10**6, 0])
@pytest.mark.parametrize("how", ["min", "max", "sum"])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_values(spark, bound, how, inclusive):
    rows = rows_with_hot_key()
    df = spark.createDataFrame(rows, SCHEMA)
    groups = ordered_groups(df, ["k"], ["t", "id"], bound)
    if bound == 0:
        chunks = groups.rows.where("k = 'hot'").select("_chunk").distinct().count()
        assert chunks > 2, "the hot key must be split"
    got = groups.running("r", how, F.col("v"), inclusive).result().select("id", "r").collect()
    assert {r.id: r.r for r in got} == loop(rows, how, inclusive)


def test_hot_timestamp_is_split(spark):
    """All rows at one instant: the id breaks ties and chunks still split."""
    rows = [("hot", 0, i, float((i * 7919) % 1000)) for i in range(800)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    groups = ordered_groups(df, ["k"], ["t", "id"], 0)
    sizes = [r["count"] for r in groups.rows.groupBy("_chunk").count().collect()]
    got = groups.running("r", "min", F.col("v")).result().select("id", "r").collect()
    assert max(sizes) < 400
    assert {r.id: r.r for r in got} == loop(rows, "min", False)


def test_group_sizes(spark):
    df = spark.createDataFrame(rows_with_hot_key(), SCHEMA)
    assert group_sizes(df, ["k"]) == (df.where("k = 'hot'").count(), 600)
    assert group_sizes(df.where("false"), ["k"]) == (0, 0)


def test_carried_table_is_no_larger_than_the_chunks(spark):
    """What is broadcast is bounded by the number of chunks, not of keys."""
    rows = [(f"k{i % 400:03d}", i, i, 1.0) for i in range(2000)] + [
        ("hot", i, 5000 + i, 1.0) for i in range(1000)]
    groups = ordered_groups(spark.createDataFrame(rows, SCHEMA), ["k"], ["t", "id"], 0)
    chunks = groups.rows.select("_chunk").distinct().count()
    carried = groups._carried(groups.rows, F.sum, F.col("v"))
    assert 2 < carried.count() <= chunks
    assert groups.spanning.count() < chunks


def test_null_keys_form_a_group(spark):
    rows = [(None, i, i, float(100 - i)) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    groups = ordered_groups(df, ["k"], ["t", "id"], 0)
    got = groups.running("r", "min", F.col("v")).result().select("id", "r").collect()
    assert {r.id: r.r for r in got} == loop([("", *r[1:]) for r in rows], "min", False)


@pytest.mark.parametrize("width", [1, 7, 5000])
@pytest.mark.parametrize("how", ["min", "max", "sum"])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_values_in_buckets(spark, width, how, inclusive):
    rows = rows_with_hot_key() + [(None, i % 9, 1000 + i, float(90 - i)) for i in range(40)]
    rows += [("k1", None, 2000, 3.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    bucket = F.floor(F.col("t") / width)
    got = running_in_buckets(df, ["k"], ["t", "id"], bucket, "r", how, F.col("v"), inclusive)
    assert got.columns == [*df.columns, "r"]
    filled = [(k or "", -1 if t is None else t, i, v) for k, t, i, v in rows]
    assert {r.id: r.r for r in got.collect()} == loop(filled, how, inclusive)


def test_buckets_are_one_lazy_plan(spark):
    """No job before the result is asked for, no table in between, a key's buckets apart."""
    df = spark.createDataFrame(rows_with_hot_key(), SCHEMA)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "")
    out = running_in_buckets(df, ["k"], ["t", "id"], F.floor(F.col("t") / 7), "r", "min", F.col("v"))
    assert not tracker.getJobIdsForGroup("lazy")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning(k" in plan and "_bucket" in plan


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_time_buckets_ascend(spark, kind):
    times = ["1969-12-31 22:10:00", "1969-12-31 23:59:59.5", "1970-01-01 00:00:00", "2024-03-31 01:59:59", "2024-03-31 03:00:00", None]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast(kind).alias("t"))
    got = [r[0] for r in df.orderBy("t").select(time_bucket(F.col("t"), df.schema["t"].dataType, 3600)).collect()]
    assert got[0] is None and got[1:] == sorted(got[1:]) and got[-1] - got[-2] == 2
