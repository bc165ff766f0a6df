"""The prefix trie against plain dictionaries."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tests.llm.data import words
from trialframe.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, x) for _, r, x in sorted(t)] for c, t in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        turns = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].add(c)
        ends[turns].append(c)
    children, total = defaultdict(int), defaultdict(lambda: [0, 0])
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, who in members.items():
        saved = (len(who) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            total[node[:d]][0] += node not in children
            total[node[:d]][1] += saved
    return sorted(
        (min(who), len(node), min(members[node[:-1]]) if node else -1, len(who), children.get(node, 0), *total[node],
         hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest())
        for node, who in members.items()
    )


def talks(seed, longest, n=60):
    rnd = random.Random(seed)
    openings = [words(rnd, 3) for _ in range(3)]
    rows, stock = [], []
    for c in range(n):
        if stock and rnd.random() < 0.5:
            turns = list(rnd.choice(stock))[: rnd.randint(1, longest)] + [words(rnd, 2)] * rnd.randint(0, 2)
        else:
            turns = [rnd.choice(openings)] + [words(rnd, 2) for _ in range(rnd.randint(0, longest - 1))]
        stock.append(turns)
        rows += [(c * rnd.choice([1, 1, 3]), i, ["user", "assistant"][i % 2], x) for i, x in enumerate(turns)]
    return list({(r[0], r[1]): r for r in rows}.values())


AWKWARD = [
    (None, 1, "user", "lost"), (0, None, "user", "first"), (0, 1, None, None), (0, 2, "user", ""), (0, 2, "user", ""),
    (7, 5, "a", "é" * 5000), (7, None, None, "x"), (5, 1, "user", "same"), (6, 1, "user", "same"), (12, 1, "", "b"),
    (10**12, 0, "user", "same"), (-4, 1, "user", "same"),
]


@pytest.mark.parametrize(
    "rows", [AWKWARD, talks(1, 6), talks(2, 70, 30), []], ids=["awkward", "short", "deep", "empty"]
)
def test_nodes_equal_plain(spark, rows):
    from pyspark.sql import functions as F

    table = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("p", "depth", "path", "conv")])
    rows = [r for r in rows if r[0] is None or r[0] >= 0]
    out = prefixes.trie(table.where("conv_id >= 0 or conv_id is null").repartition(4)).collect()
    assert sorted(tuple(-1 if x is None else x for x in r) for r in out) == plain(rows)


def test_negative_ids_do_not_fail(spark):
    out = prefixes.trie(spark.createDataFrame(AWKWARD, SCHEMA)).collect()
    assert [r.n_convs for r in out if r.depth == 0] == [7]


def test_bands_of_any_height_and_split_ids(spark, monkeypatch):
    rows = talks(3, 40, 25) + [(1000 + k, 0, "user", "hot") for k in range(0, 400)]
    for band, ids in ((2, 3), (5, 64)):
        monkeypatch.setattr(prefixes, "BAND", band)
        monkeypatch.setattr(prefixes, "IDS", ids)
        out = prefixes.trie(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
        assert sorted(tuple(-1 if x is None else x for x in r) for r in out) == plain(rows)
