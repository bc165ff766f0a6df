"""Sharding against plain differencing, and its own rules."""

from __future__ import annotations

import heapq
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.data import SCHEMA, awkward, corpus, documents
from trialframe.llm import sharding


def plain(sizes, parts):
    """Loads by differencing on lists of members."""
    order = sorted(sizes, reverse=True)
    loads, rest = [], sum(order)
    while parts > 1 and order and rest > 0 and order[0] * parts >= rest:
        loads.append(order[0])
        rest -= order.pop(0)
        parts -= 1
    heap = [(-x, k, [x] + [0] * (parts - 1)) for k, x in enumerate(order)]
    heapq.heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        both = sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True)
        heapq.heappush(heap, (both[-1] - both[0], count, both))
        count += 1
    return sorted(loads + (heap[0][2] if heap else [0] * parts))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=60), st.integers(1, 9))
def test_differencing_equals_plain(sizes, parts):
    label = sharding.differencing(np.array(sizes, np.int64), parts)
    loads = np.bincount(label, weights=sizes, minlength=parts).astype(int) if sizes else np.zeros(parts, int)
    assert sorted(loads.tolist()) == plain(sizes, parts)


def check(rows, out, shards):
    assert len(out) == len(rows)
    key = lambda r: (str(r[0]), len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode()))
    assert Counter(map(key, rows)) == Counter((str(r.doc_id), r["size"], r.text_crc32) for r in out)
    slots, homes = defaultdict(list), defaultdict(set)
    for r in out:
        assert (r.law, r.grown_shard) == ("bytes", None) and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        homes[r.text_crc32, r["size"]].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())
    loads = [0] * shards
    for r in out:
        loads[r.shard] += r["size"]
    return loads


@pytest.mark.parametrize("rows", [awkward(), corpus(n=400), []], ids=["awkward", "corpus", "empty"])
def test_rows_groups_slots_and_loads(spark, rows):
    docs = documents(spark, rows, clashing=True)
    loads = check(rows, sharding.shard(docs.repartition(5), 7).collect(), 7)
    groups = Counter()
    for r in rows:
        groups[r[1] or ""] += len((r[1] or "").encode()) + 16
    assert sorted(loads) == plain(list(groups.values()), 7)


def test_bundles_keep_groups_and_balance(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SINGLES", 20)
    monkeypatch.setattr(sharding, "BUNDLES", 16)
    rnd = random.Random(2)
    rows = [(k, "x" * rnd.randint(0, 300) + str(rnd.randint(0, 1500)), "", "", 0) for k in range(3000)]
    rows += [(5000 + k, "hot text " * 40, "", "", 0) for k in range(1500)]
    loads = check(rows, sharding.shard(spark.createDataFrame(rows, SCHEMA), 6).collect(), 6)
    hot = 1500 * (16 + 9 * 40)
    assert max(loads) == hot
    rest = sorted(loads)[:-1]
    assert max(rest) - min(rest) < 200
