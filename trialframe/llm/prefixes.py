"""Prefix trie of conversations with totals by depth bands (operator 12).

A node is a sequence of first turns, named by its depth and two hashes that
combine the hashes of (turn, position).  Totals over subtrees go up in bands of
``BAND`` depths: a node adds its numbers only to the ancestors in its own band.
The tops of the bands form a trie of a ``BAND``-th of the depth, treated the same
way; then each completed top adds its total to the nodes of the band above.  So
there are as many rounds as the depth has digits in base ``BAND``, and a node
makes fewer than ``BAND`` rows in each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialframe.operators.ordered import ordered_groups
from trialframe.session import durable

BAND = 16
#: Conversations of one family may begin with the first turns of its first member.
FAMILY = 5
#: One more than the most turns that are lent.
HEADS = 9
#: Conversation ids in one row on their way to a digest.
IDS = 512

NODE = ["depth", "p", "q"]
_MEASURES = ["n_leaves", "saved_tokens"]


def _placed(conversations: DataFrame) -> DataFrame:
    """``conv, pos, bytes, a, b``: every turn with its place, the size of its text and two hashes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), F.substring(text, 1, 64).alias("start"),
        F.octet_length(text).cast("long").alias("bytes"),
        F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), text, role).alias("b"),
    )
    # The texts stay behind; turns of one number come by role, start of the text and hash.
    ordered = ordered_groups(turns, ["conv"], ["turn", "role", "start", "a", "b"])
    return ordered.running("pos", "sum", F.lit(1).cast("long"), include_current=True).result().select(
        "conv", "pos", "bytes", "a", "b"
    )


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns ``(conv, depth, bytes, a, b)`` of the rebuilt conversations, and ``(conv, length)`` of each.

    Conversation c begins with the first h turns of the first member of its
    family, c - c % FAMILY, and goes on with its own after its first h;
    h is crc32 of c in decimal, modulo HEADS.
    """
    placed = durable(_placed(conversations))
    sizes = durable(placed.groupBy("conv").agg(F.max("pos").alias("n")))
    convs = sizes.select(
        "conv", "n", (F.col("conv") - F.col("conv") % FAMILY).alias("lender"),
        (F.crc32(F.col("conv").cast("string")) % HEADS).alias("h"),
    )
    lenders = sizes.select(F.col("conv").alias("lender"), F.col("n").alias("lent"))
    convs = durable(
        convs.join(lenders, "lender", "left").withColumn("lent", F.least("h", F.coalesce("lent", F.lit(0).cast("long"))))
    )
    own = placed.join(convs, "conv").where("pos > h").select(
        "conv", (F.col("pos") - F.col("h") + F.col("lent")).alias("depth"), "bytes", "a", "b"
    )
    heads = placed.where((F.col("pos") < HEADS) & (F.col("conv") % FAMILY == 0)).withColumnRenamed("conv", "lender")
    borrowed = heads.join(convs.select("conv", "lender", "h"), "lender").where("pos <= h").select(
        "conv", F.col("pos").alias("depth"), "bytes", "a", "b"
    )
    length = (F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")
    return own.unionByName(borrowed), convs.select("conv", length)


def _named(turns: DataFrame) -> DataFrame:
    """``turns`` with the node of each (``p, q``) and the hashes of the node above (``up_p, up_q``)."""
    p, q = F.xxhash64("a", "depth"), F.xxhash64(F.lit(1), "b", "depth")
    rows = ordered_groups(turns, ["conv"], ["depth"])
    rows = rows.running("p", "xor", p, include_current=True).running("q", "xor", q, include_current=True).result()
    return rows.select(
        "conv", "depth", "bytes", "p", "q", F.col("p").bitwiseXOR(p).alias("up_p"), F.col("q").bitwiseXOR(q).alias("up_q")
    )


def _with_paths(rows: DataFrame) -> DataFrame:
    """Rows with ``path``: the nodes above each, from the top of the band of the next above."""
    band = Window.partitionBy("conv", F.expr(f"(depth - 1) div {BAND}")).orderBy("depth")
    path = F.collect_list(F.struct(F.col("up_p").alias("p"), F.col("up_q").alias("q")))
    return rows.withColumn("path", path.over(band.rowsBetween(Window.unboundedPreceding, 0)))


def _upwards(rows: DataFrame, first: int) -> DataFrame:
    """The measures of each row once for every node of its path from place ``first`` on."""
    found = rows.select(F.posexplode("path").alias("i", "node"), F.size("path").alias("n"), "depth", *_MEASURES)
    return found.where(F.col("i") >= first).select(
        (F.col("depth") - F.col("n") + F.col("i")).alias("depth"), "node.p", "node.q", *_MEASURES
    )


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*NODE).agg(*[F.sum(c).alias(c) for c in _MEASURES])


def totals(nodes: DataFrame, rows: DataFrame, deepest: int) -> DataFrame:
    """``depth, p, q`` with the measures of ``nodes`` summed over their subtrees.

    ``nodes``: depth, p, q, path and the measures, the root (depth 0) included;
    ``rows``: conv, depth, p, q, path of every conversation.
    """
    columns = [*NODE, *_MEASURES]
    inner = nodes.where(F.col("depth") % BAND != 0)
    here = durable(_summed(nodes.select(*columns).union(_upwards(inner, 0))))
    if deepest < BAND:
        return here
    top = F.col("depth") % BAND == 0
    tops = rows.where(top & (F.col("depth") > 0)).select(
        "conv", (F.col("depth") / BAND).cast("long").alias("depth"), "p", "q",
        F.col("path")[0]["p"].alias("up_p"), F.col("path")[0]["q"].alias("up_q"),
    )
    tops = durable(_with_paths(tops))
    paths = tops.groupBy(*NODE).agg(F.first("path").alias("path"))
    higher = here.where(top).withColumn("depth", (F.col("depth") / BAND).cast("long"))
    done = totals(higher.join(paths, NODE, "left").select(*NODE, "path", *_MEASURES), tops, deepest // BAND)
    done = done.withColumn("depth", F.col("depth") * BAND)
    # The top of the band above has all of it already; the nodes between get it now.
    below = done.join(nodes.where(top).select(*NODE, "path"), NODE)
    return durable(_summed(here.where(~top).select(*columns).union(done.select(*columns)).union(_upwards(below, 1))))


def _digests(ends: DataFrame) -> DataFrame:
    """``depth, p, q, ends_sha256`` from ``(depth, p, q, conv)``: digest of a node's ids in ascending order.

    Sorted ranges of ids are joined into rows of up to ``IDS`` of them, which
    then pass in order through one running digest per node.
    """
    fields = "depth long, p long, q long, conv long, ids binary"
    digest = "depth long, p long, q long, ends_sha256 string"

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = []
            node, ids = None, None
            for *own, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != node or len(ids) == IDS:
                    node, ids = own, []
                    out.append([*own, conv, ids])
                ids.append(str(conv))
            if out:
                columns = list(zip(*out, strict=True))
                joined = [",".join(x).encode() for x in columns.pop()]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in columns), pa.array(joined, pa.binary())],
                    names=[*NODE, "conv", "ids"],
                )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None

        def rows(done: list[list]) -> pa.RecordBatch:
            *keys, found = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in keys), pa.array(found)], names=[*NODE, "ends_sha256"]
            )

        for batch in batches:
            done = []
            for *own, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != node:
                    if node is not None:
                        done.append([*node, state.hexdigest()])
                    node, state = own, hashlib.sha256(ids)
                else:
                    state.update(b"," + ids)
            if done:
                yield rows(done)
        if node is not None:
            yield rows([[*node, state.hexdigest()]])

    order = [*NODE, "conv"]
    joined = durable(ends.repartitionByRange(*order).sortWithinPartitions(*order).select(*order).mapInArrow(join, fields))
    return joined.repartition(*NODE).sortWithinPartitions(*order).mapInArrow(hashed, digest)


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the prefix trie of the rebuilt conversations.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (the parent's;
    null at the root), ``n_convs`` (members), ``n_children``, ``n_leaves``
    (childless nodes in its subtree), ``saved_tokens`` (summed over its subtree:
    members less one, times the bytes of the node's last text) and
    ``ends_sha256`` (of the ids of members that end here, ascending, joined by
    commas).

    ``conversations`` has ``conv_id, turn, role, text``; other columns are not
    read.  Turns come by ``turn``, null first, then by role, text and hash;
    repeated rows are turns of their own.  A null role or text is empty.  Rows
    with a null conv_id belong to no conversation.  No rows give no rows.
    """
    turns, lengths = rebuilt(conversations)
    rows = durable(_with_paths(_named(turns)))
    lengths = durable(lengths)
    n, first, deepest = lengths.agg(
        F.count("*"), F.min("conv"), F.coalesce(F.max("length"), F.lit(0).cast("long"))
    ).first()
    found = rows.groupBy(*NODE).agg(
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"),
        F.first("path").alias("path"),
    )
    spark = conversations.sparkSession
    path = rows.schema["path"].dataType.simpleString()
    root = spark.createDataFrame(
        [(0, 0, 0, first, n, 0, [])] if n else [],
        f"depth long, p long, q long, conv_id long, n_convs long, bytes long, path {path}",
    )
    nodes = durable(found.unionByName(root))
    above = F.try_element_at("path", F.lit(-1))
    children = nodes.where("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), above["p"].alias("p"), above["q"].alias("q")
    ).agg(F.count("*").alias("n_children"))
    nodes = durable(
        nodes.join(children, NODE, "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
        .withColumn("n_leaves", (F.col("n_children") == 0).cast("long"))
        .withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("bytes"))
    )
    summed = totals(nodes.select(*NODE, "path", *_MEASURES), rows.select("conv", *NODE, "path"), deepest)
    last = rows.join(lengths, "conv").where("depth = length").select(*NODE, "conv")
    zero = F.lit(0).cast("long")
    turnless = lengths.where("length = 0").select(zero.alias("depth"), zero.alias("p"), zero.alias("q"), "conv")
    digests = _digests(last.union(turnless))
    parents = nodes.where("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("p").alias("up_p"), F.col("q").alias("up_q"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    none = hashlib.sha256(b"").hexdigest()
    return (
        nodes.select(*NODE, "conv_id", "n_convs", "n_children", above["p"].alias("up_p"), above["q"].alias("up_q"))
        .join(summed, NODE)
        .join(digests, NODE, "left")
        .join(parents, ["depth", "up_p", "up_q"], "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
        )
    )
