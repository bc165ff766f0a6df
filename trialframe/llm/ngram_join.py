"""N-gram Jaccard join by MinHash banding (operator 5).

Documents with the same word sequence form one class.  A class is signed by
``BANDS x ROWS`` minima over the hashes of its word n-grams; classes that share
a band hash meet in a bucket, and each pair of a bucket is verified on the full
n-gram sets.  At similarity 0.8 a pair shares no band with probability
``(1 - 0.8 ** 4) ** 20``, about 3e-5.

Skew: copies collapse before anything is paired.  Buckets with the same members
are verified once.  A bucket of more than ``BLOCK`` classes is dealt into
blocks, and each pair of blocks is a task's work of its own, so neither a pair
nor a large group is ever a row set: tasks return counts and a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.llm import arrowtext, graph
from trialframe.session import durable

WORDS = 5
THRESHOLD = 0.8
ROWS = 4
BANDS = 20
BLOCK = 512

_A = np.random.default_rng(5).integers(1, 1 << 63, ROWS * BANDS, dtype=np.uint64) | np.uint64(1)
_B = np.random.default_rng(6).integers(1, 1 << 63, ROWS * BANDS, dtype=np.uint64)
_STEP = np.uint64(0xD1B54A32D192ED03)


def signatures(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """``(doc_id, c1, c2, bands)``: hash of the word sequence, band hashes.

    A text that is null or has no words has null hashes.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for block in arrowtext.blocks(batch.column(1)):
                n = len(block)
                words = arrowtext.Words(block)
                hashes, text = arrowtext.shingles(words, size)
                bands = np.zeros((n, BANDS), np.uint64)
                top = np.iinfo(np.uint64).max
                for band in range(BANDS):
                    mark = np.full(n, np.uint64(band + 1))
                    for k in range(band * ROWS, (band + 1) * ROWS):
                        low = arrowtext.per_text(np.minimum, hashes * _A[k] + _B[k], text, n, top)
                        mark = arrowtext.mix(mark * _STEP ^ low)
                    bands[:, band] = mark
                place = (np.arange(len(words.hash)) - words.span[words.text]).astype(np.uint64)
                c1 = arrowtext.per_text(np.add, arrowtext.mix(words.hash + place * _STEP), words.text, n, 0)
                c2 = arrowtext.per_text(
                    np.add, arrowtext.mix(words.hash ^ arrowtext.mix(place + np.uint64(99))), words.text, n, 0
                )
                none = np.diff(words.span) == 0
                lists = arrowtext.int_lists(bands)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(block.first, n),
                        pa.array(c1.view(np.int64), mask=none),
                        pa.array(c2.view(np.int64), mask=none),
                        lists,
                    ],
                    names=["doc_id", "c1", "c2", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        sign, "doc_id long, c1 long, c2 long, bands array<long>"
    )


def _sets(column: pa.ChunkedArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of all texts and the text of each, by text."""
    text = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    found_h, found_t = [], []
    for block in arrowtext.blocks(text):
        h, t = arrowtext.shingles(arrowtext.Words(block), size)
        order = np.lexsort((h, t))
        h, t = h[order], t[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
        found_h.append(h[new])
        found_t.append(t[new] + block.first)
    if not found_h:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(found_h), np.concatenate(found_t)


def _overlaps(hashes: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Sizes of all intersections of ``n`` sets, a range of distinct hashes at a time."""
    inter = np.zeros((n, n), np.float32)
    _, where, count = np.unique(hashes, return_inverse=True, return_counts=True)
    shared = count[where] > 1
    if not shared.any():
        return inter
    _, column = np.unique(where[shared], return_inverse=True)
    row = text[shared]
    width = max(1024, (1 << 22) // n)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    for low in range(0, int(column[-1]) + 1, width):
        i, j = np.searchsorted(column, [low, low + width])
        part = np.zeros((n, min(width, int(column[-1]) + 1 - low)), np.float32)
        part[row[i:j], column[i:j] - low] = 1
        inter += part @ part.T
    return inter


def _verify(size: int, threshold: float):
    def links(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, i, j = (group.column(k)[0].as_py() for k in range(3))
        ids = group.column("id").to_numpy()
        # One row per document, although ids may repeat.
        ids, first = np.unique(ids, return_index=True)
        group = group.take(pa.array(first))
        n = len(ids)
        weight = group.column("copies").to_numpy()
        block = group.column("block").to_numpy()
        hashes, text = _sets(group.column("text"), size)
        sizes = np.bincount(text, minlength=n).astype(np.float32)
        inter = _overlaps(hashes, text, n)
        union = sizes[:, None] + sizes[None, :] - inter
        linked = (inter > 0) & (inter >= np.float32(threshold) * union - 1e-3)
        linked &= inter.astype(np.float64) >= threshold * union.astype(np.float64) - 1e-9
        np.fill_diagonal(linked, False)
        if i != j:
            linked &= block[:, None] != block[None, :]
        # A pair counts in the smallest bucket that both are in.
        own = [np.asarray(x, dtype=np.int64) for x in group.column("keys").to_pylist()]
        own = [x[x < key] for x in own]
        if sum(len(x) > 0 for x in own) > 1:
            inverse = np.unique(np.concatenate(own), return_inverse=True)[1]
            member = np.zeros((n, int(inverse.max()) + 1), np.float32)
            member[np.repeat(np.arange(n), [len(x) for x in own]), inverse] = 1
            linked &= (member @ member.T) == 0
        label = np.arange(n)
        while True:
            low = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1, initial=n))
            if (low == label).all():
                break
            label = low
        some = linked.any(axis=1)
        return ids[some], (linked @ weight)[some], ids[label[some]]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in graph.runs(batches, 3):
            ids, found, root = links(group)
            if len(ids):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array(found.astype(np.int64)), pa.array(root)],
                    names=["id", "links", "root"],
                )

    return verify


def jaccard_join(
    docs: DataFrame, threshold: float = THRESHOLD, size: int = WORDS, block: int = BLOCK
) -> DataFrame:
    """One row per document: ``doc_id, class_id, copies, n_links, component_id, kept``.

    ``docs`` has ``doc_id`` (an integer) and ``text``; other columns are not
    read.  ``class_id`` is the smallest doc_id with the same words in the same
    order, ``copies`` the number of such rows, ``n_links`` the number of other
    rows whose word n-gram set has at least ``threshold`` Jaccard similarity
    (copies included), ``component_id`` the smallest doc_id that links reach,
    and ``kept`` tells whether the row's doc_id is that id.

    Words are split at space and 0x09-0x0D.  A text of one to ``size - 1``
    words has one n-gram, of all its words.  A null text or one without words
    links with nothing.  Rows with a null doc_id have null class and component,
    no link, and are kept.  Rows that share a doc_id count as one document of
    the join.  No rows give no rows.
    """
    signed = durable(signatures(docs, size))
    usable = signed.where("c1 is not null and doc_id is not null")
    classes = durable(
        usable.groupBy("c1", "c2").agg(
            F.min("doc_id").alias("class_id"),
            F.count("*").alias("copies"),
            F.min_by("bands", "doc_id").alias("bands"),
        )
    )
    in_band = classes.select(F.col("class_id").alias("id"), F.explode("bands").alias("key"))
    buckets = (
        in_band.groupBy("key")
        .agg(
            F.count("*").alias("n"),
            F.bit_xor(F.xxhash64("id")).alias("s1"),
            F.sum(F.xxhash64(F.col("id") + 1).bitwiseAND(0xFFFFFFFF)).alias("s2"),
        )
        .where("n > 1")
        .groupBy("n", "s1", "s2")
        .agg(F.min("key").alias("key"))
    )
    members = durable(in_band.join(buckets.select("key", "n"), "key").select("id", "key", "n"))
    own = members.groupBy("id").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string"))
    wide = (
        own.join(
            classes.groupBy(F.col("class_id").alias("id")).agg(F.sum("copies").alias("copies")), "id"
        )
        .join(texts, "id")
    )
    parts = F.ceil(F.col("n") / block).cast("int")
    dealt = (
        members.withColumn("parts", parts)
        .withColumn("block", F.pmod(F.xxhash64("id", "key"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
        .select(
            "id", "key", "block",
            F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        )
    )
    grouped = (
        dealt.join(wide, "id")
        .select("key", "i", "j", "id", "block", "copies", "keys", "text")
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
    )
    found = durable(grouped.mapInArrow(_verify(size, threshold), "id long, links long, root long"))
    linked = found.groupBy("id").agg(F.sum("links").alias("links"))
    component = graph.components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    by_class = (
        classes.select("c1", "c2", "class_id", "copies")
        .join(linked.withColumnRenamed("id", "class_id"), "class_id", "left")
        .join(component.withColumnRenamed("id", "class_id"), "class_id", "left")
        .select("c1", "c2", "class_id", "copies", "links", "component")
    )
    return (
        signed.select("doc_id", "c1", "c2")
        .join(by_class, ["c1", "c2"], "left")
        .select(
            "doc_id",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"),
            F.coalesce("copies", F.lit(1)).alias("copies"),
            (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
            F.when(
                F.col("doc_id").isNotNull(), F.coalesce("component", "class_id", "doc_id")
            ).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
    )


def first_of_groups(docs: DataFrame, threshold: float = THRESHOLD, size: int = WORDS) -> DataFrame:
    """``docs`` with one document of each group of linked ones; columns as they were.

    The smallest doc_id of a group stays.  Here texts without a word (nulls
    too) are copies of each other.  Rows with a null doc_id stay.
    """
    gone = jaccard_join(docs, threshold, size).where("not kept").select(F.col("doc_id").alias("__id"))
    solid = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[ \t\n\x0B\f\r]+", "")
    bare = durable(docs.where((solid == "") & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("__id")))
    more = bare.join(F.broadcast(bare.agg(F.min("__id").alias("least"))), F.col("__id") != F.col("least")).select("__id")
    gone = graph.fitting(durable(gone.union(more).distinct()), 24)
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__id"], "left_anti")
