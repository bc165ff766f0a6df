"""Near-duplicate vectors by robust-pruned flat graphs on overlapping shards (operator 1).

Every label's vectors are dealt to their two nearest centroids (fitted on a
bounded sample; none lies within ``APART`` link angles of another, so that a
group of near vectors stays together).  Each shard gives a robust-pruned neighbour graph; a vector's
adjacency lists from all its shards are united.  A search starts from the
shard's medoid and the vector itself, greedily finds the nearest ones, and then
expands through every vertex within range.  The links found are exact (cosine in
double precision); an audit by brute force measures how many were missed.

Skew: equal vectors collapse first.  A shard of more than ``SHARD`` vectors is
dealt into blocks, and each pair of blocks is built and searched on its own, so
a task holds at most about ``SHARD`` vectors.  Tasks return counts and a spanning
forest, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialframe.llm import graph
from trialframe.session import durable

THRESHOLD = 0.98
#: Vectors a shard should have, and may have before it is dealt into blocks.
TARGET = 1000
SHARD = 2000
#: Centroids of all labels together, and sampled vectors for each.
MAX_CENTROIDS = 1024
SAMPLE = 16
APART = 2
DEGREE = 24
CANDIDATES = 128
FAR = 16
ALPHA = 1.2
BEAM = 16
RECALL = 0.9
AUDIT_EVERY = 100
_QUERIES = 256
_ROWS = 4096

_GROUP = ("label", "dim")


def _finite() -> Column:
    """Whether no component of ``v`` is null, NaN or infinite."""
    return F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def usable(vectors: DataFrame) -> DataFrame:
    """Classes of equal vectors: ``label, dim, h1, h2, id, copies, asked, vec`` (unit length, doubles).

    ``asked``: whether a row of the class has an id that the audit takes.
    """
    values = F.col("embedding").cast("array<double>")
    largest = F.array_max(F.transform("v", lambda x: F.abs(x)))
    length = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("id"), "label", values.alias("v"))
        .where("id is not null and label is not null and v is not null and size(v) > 0")
        .where(_finite())
        .withColumn("big", largest)
        .where("big > 0")
        .select("id", "label", F.transform("v", lambda x: x / F.col("big")).alias("s"))
        .withColumn("len", length)
        .select(
            "id", "label", F.size("s").alias("dim"),
            F.xxhash64("s").alias("h1"), F.xxhash64(F.lit("~"), "s").alias("h2"),
            F.transform("s", lambda x: x / F.col("len")).alias("vec"),
        )
        .groupBy(*_GROUP, "h1", "h2")
        .agg(
            F.min("id").alias("id"), F.count("*").alias("copies"),
            F.max(F.col("id") % AUDIT_EVERY == 0).alias("asked"), F.first("vec").alias("vec"),
        )
    )


def _drawn(classes: DataFrame, share: dict[tuple, int]) -> DataFrame:
    """``label, dim, at, vec``: ``SAMPLE`` vectors of each label for each of its centroids, cut on Spark."""
    kind = classes.schema["label"].dataType.simpleString()
    wanted = classes.sparkSession.createDataFrame(
        [(label, dim, n * SAMPLE) for (label, dim), n in share.items()], f"label {kind}, dim int, own long"
    )
    order = Window.partitionBy(*_GROUP).orderBy(F.xxhash64("id"))
    # The bound that holds for every label lets Spark cut inside tasks, before it shuffles.
    at = F.row_number().over(order).alias("at")
    rows = classes.select(*_GROUP, "vec", at).where(F.col("at") <= max(share.values()) * SAMPLE)
    return rows.join(F.broadcast(wanted), list(_GROUP)).where("at <= own").drop("own")


def centroids(classes: DataFrame, threshold: float = THRESHOLD) -> dict[tuple, np.ndarray]:
    """Centroids of the labels with more than ``TARGET`` vectors; at most ``MAX_CENTROIDS``.

    A centroid within ``APART`` link angles of one before it is left out.
    """
    apart = np.cos(min(np.pi, APART * np.arccos(threshold)))
    sizes = classes.groupBy(*_GROUP).count().where(F.col("count") > TARGET)
    sizes = sizes.orderBy(F.desc("count"), *_GROUP).limit(MAX_CENTROIDS // 2).collect()
    if not sizes:
        return {}
    total = sum(r["count"] for r in sizes)
    share = {(r["label"], r["dim"]): max(2, min(-(-r["count"] // TARGET), MAX_CENTROIDS * r["count"] // total)) for r in sizes}
    by: dict[tuple, list] = {k: [] for k in share}
    for r in _drawn(classes, share).collect():
        by[r["label"], r["dim"]].append((r["at"], r["vec"]))
    found = {}
    for key, rows in by.items():
        x = np.array([v for _, v in sorted(rows)])
        c = x[: share[key]]
        for _ in range(5):
            near = (x @ c.T).argmax(1)
            c = np.stack([x[near == k].mean(0) if (near == k).any() else c[k] for k in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        kept: list[int] = []
        for k in range(len(c)):
            if not kept or (c[kept] @ c[k]).max() < apart:
                kept.append(k)
        found[key] = c[kept]
    return found


def _shards(classes: DataFrame, centres: dict[tuple, np.ndarray], nearest: int = 2) -> DataFrame:
    """``label, dim, id, copies, vec, shards``: numbers of the ``nearest`` centroids (or just 0)."""
    shared = classes.sparkSession.sparkContext.broadcast(centres)
    kind = classes.schema["label"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            own: list[list[int]] = [[0]] * len(keys)
            for key in set(keys) & set(centres):
                rows = [k for k, x in enumerate(keys) if x == key]
                vec = np.stack([batch.column(4)[k].values.to_numpy() for k in rows])
                near = np.argsort(-(vec @ centres[key].T), axis=1)[:, :nearest]
                for k, x in zip(rows, near, strict=True):
                    own[k] = sorted(int(c) for c in x)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(own, pa.list_(pa.int32()))], names=[*batch.schema.names, "shards"]
            )

    return classes.select(*_GROUP, "id", "copies", "vec").mapInArrow(
        assign, f"label {kind}, dim int, id long, copies long, vec array<double>, shards array<int>"
    )


def _dealt(members: DataFrame) -> DataFrame:
    """One row for each task a member belongs to: ``key, i, j`` and its block and the parts."""
    rows = members.withColumn("shard", F.explode("shards"))
    parts = rows.groupBy(*_GROUP, "shard").agg(F.count("*").alias("n")).withColumn(
        "parts", F.when(F.col("n") <= SHARD, 1).otherwise(F.ceil(F.col("n") / (SHARD // 2))).cast("int")
    )
    other = F.expr("filter(sequence(0, parts - 1), x -> parts = 1 or x <> block)")
    return (
        rows.join(parts.drop("n"), [*_GROUP, "shard"])
        .withColumn("block", F.pmod(F.xxhash64("id", "shard"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(other))
        .select(
            F.xxhash64("label", "dim", "shard").alias("key"),
            F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
            *_GROUP, "shard", "parts", "block", "id", "copies", "vec", "shards",
        )
    )


def _matrix(group: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The group with one row for each id, its ids and vectors."""
    ids, first = np.unique(group.column("id").to_numpy(), return_index=True)
    group = group.take(pa.array(first))
    flat = group.column("vec").combine_chunks().flatten().to_numpy()
    return group, ids, flat.reshape(len(ids), -1)


def prune(x: np.ndarray, degree: int = DEGREE) -> list[np.ndarray]:
    """Robust-pruned out-neighbours of each row among its nearest and some far rows, made mutual."""
    n = len(x)
    if n == 1:
        return [np.zeros(0, np.int64)]
    d = np.sqrt(np.maximum(2 - 2 * (x @ x.T), 0)).astype(np.float32)
    np.fill_diagonal(d, np.inf)
    near = min(CANDIDATES, n - 1)
    pool = np.argpartition(d, near - 1, axis=1)[:, :near]
    far = np.random.default_rng(n).integers(0, n, (n, FAR))
    pool = np.concatenate([pool, far], axis=1)
    own = np.take_along_axis(d, pool, 1)
    row, edges = np.arange(n), []
    for _ in range(degree):
        at = own.argmin(1)
        live = np.isfinite(own[row, at])
        if not live.any():
            break
        chosen = pool[row, at]
        edges.append(np.stack([row[live], chosen[live]], 1))
        own[row, at] = np.inf
        # What the chosen neighbour already covers is reached through it.
        own[ALPHA * d[chosen[:, None], pool] <= own] = np.inf
    pairs = np.concatenate(edges)
    pairs = np.unique(np.concatenate([pairs, pairs[:, ::-1]]), axis=0)
    return np.split(pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(1, n)))


def _build(degree: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in graph.runs(batches, 3):
            _, ids, x = _matrix(group)
            lists = [ids[k] for k in prune(x, degree)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array([k.tolist() for k in lists], pa.list_(pa.int64()))], names=["id", "near"]
            )

    return build


def search(x: np.ndarray, near: list[np.ndarray], threshold: float, beam: int = BEAM) -> np.ndarray:
    """Which rows each row finds within range: greedy from the medoid and itself, then expanding."""
    n = len(x)
    found = np.zeros((n, n), bool)
    medoid = int((x @ x.mean(0)).argmax())
    for q in range(n):
        point = x[q]
        seen = np.zeros(n, bool)
        start = np.unique([medoid, q])
        seen[start] = True
        pool, cosine = start, x[start] @ point
        done = np.zeros(len(pool), bool)
        while True:
            top = np.argsort(-cosine, kind="stable")[:beam]
            ahead = np.zeros(len(pool), bool)
            ahead[top] = True
            ahead |= cosine >= threshold
            ahead &= ~done
            if not ahead.any():
                break
            done |= ahead
            new = np.unique(np.concatenate([near[k] for k in pool[ahead]]))
            new = new[~seen[new]]
            seen[new] = True
            pool = np.concatenate([pool, new])
            cosine = np.concatenate([cosine, x[new] @ point])
            done = np.concatenate([done, np.zeros(len(new), bool)])
        found[q, pool[cosine >= threshold]] = True
    found |= found.T
    np.fill_diagonal(found, False)
    return found


def _search(threshold: float, beam: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in graph.runs(batches, 3):
            group, ids, x = _matrix(group)
            shard, parts = group.column("shard")[0].as_py(), group.column("parts")[0].as_py()
            block = group.column("block").to_numpy()
            near = []
            for k in group.column("near").to_pylist():
                at = np.searchsorted(ids, k)
                at = np.minimum(at, len(ids) - 1)
                near.append(at[ids[at] == k] if len(at) else np.zeros(0, np.int64))
            linked = search(x, near, threshold, beam)
            label = np.arange(len(ids))
            while True:
                low = np.minimum(label, np.where(linked, label[None, :], len(ids)).min(1, initial=len(ids)))
                if (low == label).all():
                    break
                label = low
            some = linked.any(1)
            # A pair counts in its first common shard, and there in one pair of blocks.
            lists = group.column("shards").to_pylist()
            for earlier in {x for k in lists for x in k if x < shard}:
                there = np.array([earlier in k for k in lists])
                linked &= ~(there[:, None] & there[None, :])
            if parts > 1:
                i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
                own = {b for b in (i, j) if {b, (b + 1) % parts} == {i, j}}
                inside = block[:, None] == block[None, :]
                counted = np.isin(block, list(own))
                linked &= ~inside | counted[:, None]
            links = linked @ group.column("copies").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[some]), pa.array(links[some].astype(np.int64)), pa.array(ids[label[some]])],
                names=["id", "links", "root"],
            )

    return run


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _find(members: DataFrame, threshold: float, degree: int, beam: int) -> DataFrame:
    dealt = _dealt(members)
    built = _grouped(dealt.select("key", "i", "j", "id", "vec")).mapInArrow(_build(degree), "id long, near array<long>")
    near = built.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    members = members.join(durable(near), "id")
    rows = _dealt(members.select(*_GROUP, "id", "copies", "vec", "shards")).join(
        members.select("id", "near"), "id"
    )
    rows = rows.select("key", "i", "j", "shard", "parts", "block", "id", "copies", "vec", "shards", "near")
    return durable(_grouped(rows).mapInArrow(_search(threshold, beam), "id long, links long, root long"))


def _asked(classes: DataFrame) -> DataFrame:
    """``id, asked``: the classes to audit; if no id is divisible, others by hash, and of a small table all."""
    mine = classes.select("id", "asked")
    by_hash = F.pmod(F.xxhash64("id"), F.lit(AUDIT_EVERY)) == 0
    for ask in (F.col("asked"), by_hash):
        if not mine.where(ask).isEmpty():
            return mine.select("id", ask.alias("asked"))
    return mine.select("id", F.lit(True).alias("asked"))


def audited_links(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(id, audit_links)`` by brute force, of the classes ``asked`` for, against all rows.

    Queries of a label form blocks of ``_QUERIES`` and its vectors chunks of
    ``_ROWS``; a task compares one block with one chunk.
    """
    size = members.groupBy(*_GROUP).agg(
        F.ceil(F.count_if("asked") / _QUERIES).cast("int").alias("blocks"),
        F.ceil(F.count("*") / _ROWS).cast("int").alias("chunks"),
    )
    rows = members.select(*_GROUP, "id", "copies", "vec", "asked").join(size.where("blocks > 0"), list(_GROUP))
    hashed = F.xxhash64("id")
    asked = rows.where("asked").select(
        "*", F.pmod(hashed, F.col("blocks")).alias("i"), F.explode(F.expr("sequence(0, chunks - 1)")).alias("j"), F.lit(1).alias("ask")
    )
    held = rows.select(
        "*", F.explode(F.expr("sequence(0, blocks - 1)")).alias("i"), F.pmod(hashed, F.col("chunks")).alias("j"), F.lit(0).alias("ask")
    )
    columns = [F.xxhash64(*_GROUP).alias("key"), F.col("i").cast("int"), F.col("j").cast("int"), "ask", "id", "copies", "vec"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in graph.runs(batches, 3):
            ask = group.column("ask").to_numpy() == 1
            ids = group.column("id").to_numpy()
            x = group.column("vec").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            hit = (x[ask] @ x[~ask].T >= threshold) & (ids[ask][:, None] != ids[~ask][None, :])
            links = hit @ group.column("copies").to_numpy()[~ask]
            yield pa.RecordBatch.from_arrays([pa.array(ids[ask]), pa.array(links.astype(np.int64))], names=["id", "n"])

    both = _grouped(asked.select(*columns).union(held.select(*columns)))
    return both.mapInArrow(compare, "id long, n long").groupBy("id").agg(F.sum("n").alias("audit_links"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``vectors``: ``vec_id, n_links, component_id, kept, audit_links``.

    ``vectors`` has ``vec_id`` (an integer), ``embedding`` and ``label``; other
    columns are not read.  Vectors are compared within a label and a number of
    dimensions.  ``n_links`` counts the other rows with cosine of at least
    ``threshold`` (equal vectors included), ``component_id`` is the smallest
    vec_id that links reach, ``kept`` whether it is the row's own.  A null,
    empty or zero vector, one with null or non-finite components, and a null
    label link with nothing; a null vec_id also has a null component and is
    kept.  Rows that share a vec_id count as one vector.  No rows give no rows.

    ``audit_links`` is the number of links by brute force of the rows whose id is
    divisible by ``AUDIT_EVERY`` (without any, of others by hash; of a small table
    of all), and of the smallest id equal to such a row, else null.  Where less than
    ``RECALL`` of these were found, over all links or on average over the ids,
    vectors are dealt to twice as many shards, the graph is built and searched
    again with twice the degree and beam, and then again; if that does not help,
    it raises.
    """
    classes = durable(usable(vectors))
    centres = centroids(classes, threshold)
    members = durable(_shards(classes, centres))
    truth = durable(audited_links(members.join(_asked(classes), "id"), threshold))
    copies = classes.select("id", "copies")
    for factor in (1, 2, 4):
        if factor > 1:
            members = durable(_shards(classes, centres, 2 * factor))
        found = _find(members, threshold, DEGREE * factor, BEAM * factor)
        linked = found.groupBy("id").agg(F.sum("links").alias("links"))
        hit = F.least("audit_links", F.coalesce("links", F.lit(0)))
        hits, all_, mean = truth.join(linked, "id", "left").where("audit_links > 0").agg(
            F.sum(hit), F.sum("audit_links"), F.avg(hit / F.col("audit_links"))
        ).first()
        # A group with most of the links must not hide what all other ids miss.
        if not all_ or hits >= RECALL * all_ and mean >= RECALL:
            break
    else:
        raise RuntimeError(f"the search found {hits} of {all_} audited links, {mean:.3f} of an id's on average")
    component = graph.components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    by_class = (
        classes.select("label", "dim", "h1", "h2", "id", "copies")
        .join(linked, "id", "left")
        .join(component, "id", "left")
        .join(truth.join(copies.groupBy("id").agg(F.max("copies").alias("c")), "id").select(
            "id", (F.col("audit_links") + F.col("c") - 1).alias("audit_links")), "id", "left")
        .select(
            F.col("label").alias("__label"), F.col("dim").alias("__dim"), F.col("h1").alias("__h1"), F.col("h2").alias("__h2"),
            F.col("id").alias("__class"), "copies", "links", "component", "audit_links",
        )
    )
    values = F.col("embedding").cast("array<double>")
    largest = F.array_max(F.transform("v", lambda x: F.abs(x)))
    # Hashes skip null components: only vectors that are compared get any.
    scaled = F.when(F.col("fit") & (F.col("big") > 0), F.transform("v", lambda x: x / F.col("big")))
    rows = (
        vectors.select(F.col("vec_id").cast("long"), "label", values.alias("v"))
        .withColumns({"big": largest, "fit": _finite()})
        .select("vec_id", "label", scaled.alias("s"))
        .select(
            "vec_id", "label", F.size("s").alias("dim"), F.when(F.col("s").isNotNull(), F.xxhash64("s")).alias("h1"),
            F.xxhash64(F.lit("~"), "s").alias("h2"),
        )
    )
    same = (
        (F.col("label") == F.col("__label")) & (F.col("h1") == F.col("__h1")) & (F.col("h2") == F.col("__h2"))
        & (F.col("dim") == F.col("__dim")) & F.col("vec_id").isNotNull()
    )
    return rows.join(by_class, same, "left").select(
        "vec_id",
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "__class", "vec_id")).alias("component_id"),
        F.when((F.col("vec_id") == F.col("__class")) | (F.col("vec_id") % AUDIT_EVERY == 0), F.col("audit_links")).alias("audit_links"),
    ).select(
        "vec_id", "n_links", "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"), "audit_links",
    )
