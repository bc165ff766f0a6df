"""Shards of nearly equal bytes by Karmarkar-Karp differencing (operator 11).

Rows of equal text form a group that no shard boundary may cut.  A partial
partition is a list of part sizes; the two of largest spread are combined again
and again, the largest part of one with the smallest of the other, until one is
left.

The number of items stays bounded whatever the data: a group of at least
``1 / SINGLES`` of all bytes is an item of its own (at most ``SINGLES`` of them),
the others are summed into bundles by their hash.  Bundles come in levels, each
with half the groups of the one before, down to bundles of about one group, so
that there are large items for most of the bytes and ever smaller ones to even
out what is left.  That makes at most ``BUNDLES * 60`` further items; their sizes
are the only rows that the driver sees.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialframe.llm import graph
from trialframe.session import durable

SHARDS = 40
#: Bytes that a row takes beside its text.
ROW_BYTES = 16
SINGLES = 20_000
BUNDLES = 1024


def differencing(sizes: np.ndarray, parts: int) -> np.ndarray:
    """The part of each item, by largest differencing; ties go by position.

    An item of at least an equal share of what is left gets a part of its own
    first: no partition can do better by adding to it.
    """
    label = np.zeros(len(sizes), np.int64)
    order = np.argsort(-sizes, kind="stable")
    rest, begin = int(sizes.sum()), 0
    while parts - begin > 1 and begin < len(order) and int(sizes[order[begin]]) * (parts - begin) >= rest > 0:
        label[order[begin]] = begin
        rest -= int(sizes[order[begin]])
        begin += 1
    order, free = order[begin:], parts - begin
    if not len(order):
        return label
    heap: list[tuple[int, int, np.ndarray]] = []
    for node, item in enumerate(order):
        sums = np.zeros(free, np.int64)
        sums[0] = sizes[item]
        # Sums descend; equal spreads are combined in order of making.
        heap.append((-int(sums[0] - sums[-1]), node, sums))
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, left, a = heapq.heappop(heap)
        _, right, b = heapq.heappop(heap)
        joined = a + b[::-1]
        turn = np.argsort(-joined, kind="stable")
        joined = joined[turn]
        heapq.heappush(heap, (-int(joined[0] - joined[-1]), len(order) + len(merges), joined))
        merges.append((left, right, turn.astype(np.int32)))
    # Undo the combinations: which final part each position of a partial partition is in.
    at = {len(order) + len(merges) - 1: np.arange(free)}
    for k in range(len(merges) - 1, -1, -1):
        left, right, turn = merges[k]
        final = np.empty(free, np.int64)
        final[turn] = at.pop(len(order) + k)
        at[left], at[right] = final, final[::-1]
    for node, item in enumerate(order):
        label[item] = begin + at[node][0]
    return label


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs``.

    ``docs`` has ``doc_id`` and ``text``; other columns are not read.  Ids may
    be null or repeat; every row is placed.  A null text counts as the empty
    one, in its group and as 0 bytes.  Law ``bytes`` holds, so ``grown_shard``
    is null.  Slots of a shard have no gaps.  No rows give no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = durable(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("group"),
        )
    )
    groups = durable(rows.groupBy("group").agg(F.sum("size").alias("bytes")))
    total, count = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    levels = max(0, math.ceil(math.log2(max(count, 1) / BUNDLES)))
    zeros = F.lit(64) - F.length(F.bin(F.xxhash64("group", F.lit(1))))
    level = F.least(zeros, F.lit(levels)).cast("int").alias("level")
    bundle = F.pmod(F.xxhash64("group", F.lit(2)), F.lit(BUNDLES)).cast("int").alias("bundle")
    alone = F.col("bytes") * F.lit(SINGLES).cast("decimal(20,0)") >= F.lit(total)
    single = groups.where(alone).select("group", "bytes").toArrow().sort_by("group")
    summed = groups.where(~alone).groupBy(level, bundle).agg(F.sum("bytes").alias("bytes")).toArrow()
    summed = summed.sort_by([("level", "ascending"), ("bundle", "ascending")])
    sizes = np.concatenate([single.column("bytes").to_numpy(), summed.column("bytes").to_numpy()]).astype(np.int64)
    part = differencing(sizes, shards)
    of_bundle = np.zeros((levels + 1, BUNDLES), np.int64)
    of_bundle[summed.column("level").to_numpy(), summed.column("bundle").to_numpy()] = part[len(single) :]
    shared = docs.sparkSession.sparkContext.broadcast(
        (single.column("group").to_numpy().astype(np.int64), part[: len(single)], of_bundle)
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own, of_bundle = shared.value
        seen, task = np.zeros(shards, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            keys = batch.column("group").to_numpy()
            place = of_bundle[batch.column("level").to_numpy(), batch.column("bundle").to_numpy()]
            if len(group):
                at = np.minimum(np.searchsorted(group, keys), len(group) - 1)
                place = np.where(group[at] == keys, own[at], place)
            order = np.argsort(place, kind="stable")
            begin = np.searchsorted(place[order], np.arange(shards))
            rank = np.empty(len(keys), np.int64)
            rank[order] = np.arange(len(keys)) - begin[place[order]] + seen[place[order]]
            seen += np.bincount(place, minlength=shards)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "size", "text_crc32")), pa.array(place.astype(np.int32)),
                 pa.array(np.full(len(keys), task, np.int32)), pa.array(rank)],
                names=["doc_id", "size", "text_crc32", "shard", "task", "rank"],
            )

    fields = "doc_id long, size long, text_crc32 long, shard int, task int, rank long"
    placed = durable(rows.select("*", level, bundle).mapInArrow(place, fields))
    # Ranks count within a task: what its shard holds from earlier tasks comes before.
    earlier = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    held = placed.groupBy("shard", "task").agg(F.count("*").alias("n"))
    before = durable(held.select("shard", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")))
    return placed.join(graph.fitting(before, 24), ["shard", "task"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.col("rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
