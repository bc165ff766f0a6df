"""Merkle fixity audit of WARC replicas (operator 9).

Records are hashed, and the hashes of each archive form a tree over ordered
offset ranges: a leaf covers ``RANGE`` bytes of the archive, a node ``FANOUT``
nodes below.  Replicas whose roots agree are done; otherwise only the branches
that differ are followed down to the records.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialframe.session import durable

PER_ARCHIVE = 1024
RANGE = 1 << 18
FANOUT = 16

_KEYS = ("archive", "node")


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A page as one WARC response record; nulls are empty."""
    url, html = F.coalesce(url.cast("string"), F.lit("")), F.coalesce(html.cast("string"), F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Length: "), F.octet_length(html).cast("string"),
        F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"),
    )


def manifest(pages: DataFrame, stored: Column | None = None) -> DataFrame:
    """``archive, offset, length, copies, page_id, digest, stored`` of every distinct record.

    ``PER_ARCHIVE`` consecutive page ids share an archive (rows without an id
    have one of their own), in the order of id and digest; equal records lie
    side by side, as one row with their number.  ``digest`` is the SHA-256 of
    the record as written.  ``stored`` (a column over ``page_id, text, digest``,
    the record as a replica holds it, null where it is lost) gives the digest
    of that; without it, ``stored`` is ``digest``.  Only digests are shuffled.
    Offsets are summed in parts by id and digest, so no id's records meet in
    one task.
    """
    text = record(F.col("page_id"), F.col("url"), F.col("html")).alias("text")
    rows = pages.select(F.col("page_id").cast("long"), text).withColumn("digest", F.sha2("text", 256))
    rows = rows.select(
        F.coalesce(F.floor(F.col("page_id") / PER_ARCHIVE), F.lit(-(1 << 63))).alias("archive"),
        "page_id",
        "digest",
        F.octet_length("text").cast("long").alias("length"),
        (F.col("digest") if stored is None else F.sha2(stored, 256)).alias("stored"),
    )
    part = F.substring("digest", 1, 3).alias("part")
    rows = durable(
        rows.groupBy("archive", "page_id", "digest", "length", "stored").agg(F.count("*").alias("copies"))
        .select("*", part)
    )
    size = F.sum(F.col("length") * F.col("copies"))
    before = Window.partitionBy("archive").orderBy("page_id", "part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        rows.groupBy("archive", "page_id", "part").agg(size.alias("size"))
        .select("archive", F.col("page_id").alias("p_id"), F.col("part").alias("p_part"),
                F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    )
    own = Window.partitionBy("archive", "page_id", "part").orderBy("digest", "stored").rowsBetween(
        Window.unboundedPreceding, -1
    )
    inner = rows.withColumn("inner", F.coalesce(F.sum(F.col("length") * F.col("copies")).over(own), F.lit(0)))
    return inner.join(
        parts.withColumnRenamed("archive", "p_archive"),
        (F.col("archive") == F.col("p_archive")) & F.col("page_id").eqNullSafe(F.col("p_id"))
        & (F.col("part") == F.col("p_part")),
    ).select(
        "archive", (F.col("base") + F.col("inner")).alias("offset"), "length", "copies", "page_id", "digest", "stored"
    )


def trees(records: DataFrame, levels: int) -> list[DataFrame]:
    """The nodes ``archive, node, hash`` of each level, leaves first; the last has the roots.

    ``records`` has ``archive, offset, length, copies, digest``.  A leaf holds
    at most ``RANGE`` bytes' worth of records, a node at most ``FANOUT`` nodes.
    """
    line = F.concat_ws(":", "offset", "length", "copies", "digest")
    joined = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), ";"), 256)
    level = durable(
        records.select("archive", F.floor(F.col("offset") / RANGE).alias("node"), F.col("offset").alias("at"), line.alias("line"))
        .groupBy(*_KEYS).agg(joined.alias("hash"))
    )
    found = [level]
    for _ in range(levels):
        level = durable(
            level.select("archive", F.floor(F.col("node") / FANOUT).alias("node"), F.col("node").alias("at"),
                         F.concat_ws(":", "node", "hash").alias("line"))
            .groupBy(*_KEYS).agg(joined.alias("hash"))
        )
        found.append(level)
    return found


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys of the nodes that only one side has or whose hashes differ."""
    other = b.select(*_KEYS, F.col("hash").alias("other"))
    return a.join(other, list(_KEYS), "full").where("not (hash <=> other)").select(*_KEYS)


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """The records that differ: ``archive, offset, length, copies, page_id, kind, primary_digest, replica_digest``.

    Both sides have ``archive, offset, length, copies, page_id, digest`` with
    the digest of the bytes they hold now.  ``kind`` is ``altered`` (another
    digest at the offset), ``missing`` (only the primary has a record there) or
    ``extra``.  Equal replicas and empty tables give no rows.
    """
    primary, replica = durable(primary), durable(replica)
    last = max(x.agg(F.max("offset")).first()[0] or 0 for x in (primary, replica))
    levels = math.ceil(math.log(last // RANGE + 1, FANOUT)) if last >= RANGE else 0
    ours, theirs = trees(primary, levels), trees(replica, levels)
    marks = durable(_differing(ours[-1], theirs[-1]))
    for level in range(levels - 1, -1, -1):
        above = marks.select("archive", F.col("node").alias("above"))

        def below(side: DataFrame, above: DataFrame = above) -> DataFrame:
            return side.withColumn("above", F.floor(F.col("node") / FANOUT)).join(above, ["archive", "above"], "left_semi")

        marks = durable(_differing(below(ours[level]), below(theirs[level])))

    def inside(side: DataFrame, name: str) -> DataFrame:
        rows = side.withColumn("node", F.floor(F.col("offset") / RANGE)).join(marks, list(_KEYS), "left_semi")
        return rows.select("archive", "offset", F.struct("length", "copies", "page_id", "digest").alias(name))

    rows = inside(primary, "p").join(inside(replica, "r"), ["archive", "offset"], "full").where("not (p <=> r)")
    kind = F.when(F.col("r").isNull(), "missing").when(F.col("p").isNull(), "extra").otherwise("altered")
    return rows.select(
        "archive", "offset",
        *[F.coalesce(f"p.{c}", f"r.{c}").alias(c) for c in ("length", "copies", "page_id")],
        kind.alias("kind"), F.col("p.digest").alias("primary_digest"), F.col("r.digest").alias("replica_digest"),
    )
