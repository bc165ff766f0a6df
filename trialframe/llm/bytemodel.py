"""Per-class byte context models: counted on Spark, frozen into one bounded table.

Counts of byte windows are combined inside tasks and summed on Spark; all of them
stay, as a Spark table.  ``freeze`` computes the code length of every byte after
the most frequent contexts for every class, which is one table look-up per byte
in a task.  What a text has after other contexts is counted, and its code lengths
are computed from the whole table and joined.  The size of the table in memory
decides where a code length comes from, not what it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialframe.llm import arrowtext, graph
from trialframe.session import durable

ORDER = 3
#: Size of the part in memory: windows fetched, and numbers in the table of one order.
MAX_WINDOWS = 1_000_000
MAX_CELLS = 12_000_000
_FLUSH = 4_000_000


def _windows(block: arrowtext.Block) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a block after ``ORDER`` zero bytes for each text, and the bytes' places."""
    n = len(block.data)
    text = np.repeat(np.arange(len(block)), np.diff(block.at))
    place = np.arange(n) + ORDER * (text + 1)
    wide = np.zeros(n + ORDER * len(block), np.uint8)
    wide[place] = block.data
    return wide, place


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, count = key[order], count[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[at], np.add.reduceat(count, at)


def window_counts(labelled: DataFrame) -> DataFrame:
    """``(kind, gram, n)``: how often each byte with the three before it occurs, by class.

    ``labelled`` has ``kind`` and ``text``; null texts count as empty, and rows
    of null kind are left out.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list, list]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for kind, (keys, counts) in held.items():
                key, n = _merge(keys, counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind] * len(key), pa.string()), pa.array(key.astype(np.int64)), pa.array(n)],
                    names=["kind", "gram", "n"],
                )

        for batch in batches:
            kinds = np.array(batch.column(0).to_pylist(), dtype=object)
            for block in arrowtext.blocks(batch.column(1)):
                wide, place = _windows(block)
                gram = np.zeros(len(place), np.uint32)
                for back in range(ORDER, -1, -1):
                    gram = (gram << np.uint32(8)) | wide[place - back]
                names, own = np.unique(kinds[block.first : block.first + len(block)].astype(str), return_inverse=True)
                own = np.repeat(own, np.diff(block.at))
                for k, name in enumerate(names):
                    key, n = np.unique(gram[own == k], return_counts=True)
                    if not len(key):
                        continue
                    keys, counts = held.setdefault(str(name), ([], []))
                    keys.append(key)
                    counts.append(n)
                    size += len(key)
                if size > _FLUSH:
                    for name, (keys, counts) in held.items():
                        key, n = _merge(keys, counts)
                        held[name] = ([key], [n])
                    size = sum(len(x[0][0]) for x in held.values())
                    if size > _FLUSH // 2:
                        yield from out()
                        held, size = {}, 0
        yield from out()

    return (
        labelled.where("kind is not null")
        .select(F.col("kind").cast("string"), F.col("text").cast("string"))
        .mapInArrow(count, "kind string, gram long, n long")
        .groupBy("kind", "gram")
        .agg(F.sum("n").alias("n"))
    )


class Model:
    """Frozen code lengths: ``table[context, symbol, class]`` in bits.

    ``index`` is negative for contexts that are not in the table; ``rest`` then
    holds all counts, and ``whole`` is false.  A copy for tasks has no ``rest``.
    """

    def __init__(
        self, kinds: list[str], symbol: np.ndarray, index: np.ndarray, table: np.ndarray, rest: Rest | None = None
    ) -> None:
        self.kinds, self.symbol, self.index, self.table, self.rest = kinds, symbol, index, table, rest

    @property
    def whole(self) -> bool:
        return self.rest is None

    def _rows(self, wide: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The table row (or a negative number) and symbol of each byte of a block."""
        code = self.symbol[wide]
        size = self.table.shape[1]
        context = (code[place - 3] * size + code[place - 2]) * size + code[place - 1]
        return self.index[context].astype(np.int64), code[place]

    def bits(self, block: arrowtext.Block) -> np.ndarray:
        """Code length of each text of a block under each class (texts x classes).

        Bytes after contexts outside the table add nothing.
        """
        out = np.zeros((len(block), len(self.kinds)))
        if not len(block.data):
            return out
        row, code = self._rows(*_windows(block))
        cost = self.table.reshape(-1, len(self.kinds))[np.maximum(row, 0) * self.table.shape[1] + code]
        cost[row < 0] = 0
        there = np.flatnonzero(np.diff(block.at))
        out[there] = np.add.reduceat(cost, block.at[there], axis=0, dtype=np.float64)
        return out

    def outside(self, block: arrowtext.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, window and number of the distinct windows of each text that ``bits`` leaves out."""
        wide, place = _windows(block)
        row, _ = self._rows(wide, place)
        out = np.flatnonzero(row < 0)
        gram = np.zeros(len(out), np.int64)
        for back in range(ORDER, -1, -1):
            gram = (gram << 8) | wide[place[out] - back]
        text = np.searchsorted(block.at, out, side="right") - 1
        # A block has fewer than 2 ** 31 texts.
        pair, n = np.unique((text.astype(np.int64) << 32) | gram, return_counts=True)
        return pair >> 32, pair & 0xFFFFFFFF, n


class Rest:
    """All counts of a model, and the code lengths that they give to any window."""

    def __init__(self, counts: DataFrame, kinds: list[str], short: np.ndarray, smoothing: str) -> None:
        #: ``short[class, byte before, byte]`` counts pairs of bytes.
        self.counts, self.kinds, self.short, self.smoothing = counts, kinds, short, smoothing

    def costs(self, wanted: DataFrame) -> DataFrame:
        """``(gram, bits)`` of the distinct windows ``(gram)``.

        The windows that agree in the two middle bytes form a group, of at most
        65536 windows for each class: all that their contexts of two and three
        bytes have.
        """
        middle = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF)).cast("int").alias("middle")
        asked = wanted.select(middle, "gram", F.lit(None).cast("string").alias("kind"), F.lit(0).cast("long").alias("n"))
        have = self.counts.select(middle, "gram", "kind", "n")
        have = have.join(F.broadcast(asked.select("middle").distinct()), "middle", "left_semi")
        shared = self.counts.sparkSession.sparkContext.broadcast(self.short)
        kinds, smoothing = self.kinds, SMOOTHING[self.smoothing]

        def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            short = shared.value
            place = {kind: k for k, kind in enumerate(kinds)}
            for group in graph.runs(batches, 1):
                gram, n = group.column("gram").to_numpy(), group.column("n").to_numpy()
                own = np.array([place.get(k, -1) for k in group.column("kind").to_pylist()])
                ask = np.sort(gram[own < 0])
                first, at = np.unique(ask >> 24, return_inverse=True)
                last = (int(gram[0]) >> 8) & 255
                bits = np.empty((len(ask), len(kinds)), np.float32)
                for k in range(len(kinds)):
                    here = own == k
                    flat = ((gram[here] >> 24) << 8) | (gram[here] & 255)
                    long = np.bincount(flat, n[here], 65536).reshape(256, 256)
                    lower = [long.sum(0), short[k, last], short[k].sum(0)]
                    chain = [long[first], *[np.broadcast_to(x, (len(first), 256)) for x in lower]]
                    bits[:, k] = smoothing(chain)[at, ask & 255]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(ask) + 1, dtype=np.int32) * len(kinds)), pa.array(bits.reshape(-1))
                )
                yield pa.RecordBatch.from_arrays([pa.array(ask), lists], names=["gram", "bits"])

        rows = have.unionByName(asked).repartition("middle").sortWithinPartitions("middle")
        return rows.mapInArrow(cost, "gram long, bits array<float>")


def _ppm(levels: list[np.ndarray]) -> np.ndarray:
    """Code lengths by partial matching (method C) with exclusion.

    ``levels`` holds the counts (rows x symbols) from the longest context down.
    A symbol new to a context pays the escape, ``distinct / (total + distinct)``,
    and is then coded by the next shorter context without the symbols excluded
    so far; at last all remaining byte values are equally likely.
    """
    rows, size = levels[0].shape
    cost = np.zeros((rows, size))
    escape = np.zeros((rows, 1))
    out = np.zeros((rows, size), bool)
    for counts in levels:
        c = np.where(out, 0, counts).astype(np.float64)
        total, distinct = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
        new = c > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            cost = np.where(new, escape + np.log2(total + distinct) - np.log2(c), cost)
            escape = escape + np.where(total > 0, np.log2((total + distinct) / distinct), 0)
        out |= new
    rest = np.maximum(256 - out.sum(1, keepdims=True), 1)
    return np.where(out, cost, escape + np.log2(rest))


def _witten_bell(levels: list[np.ndarray]) -> np.ndarray:
    """Code lengths by interpolation: each context adds ``distinct`` parts of the shorter one."""
    rows, size = levels[0].shape
    p = np.full((rows, size), 1 / 256)
    for counts in reversed(levels):
        c = counts.astype(np.float64)
        total, distinct = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
        p = np.where(total > 0, (c + distinct * p) / np.maximum(total + distinct, 1), p)
    return -np.log2(p)


SMOOTHING = {"ppm": _ppm, "witten_bell": _witten_bell}


def _contexts(counts: DataFrame, most: int, max_windows: int) -> tuple[np.ndarray, bool]:
    """Contexts of three bytes for the table in memory, and whether these are all.

    A context ranks by its largest share of any class.
    """
    totals = counts.groupBy("kind").agg(F.sum("n").alias("all"))
    ranked = (
        counts.groupBy("kind", F.shiftright("gram", 8).alias("context"))
        .agg(F.sum("n").alias("n"), F.count("*").alias("windows"))
        .join(F.broadcast(totals), "kind")
        .groupBy("context")
        .agg(F.max(F.col("n") / F.col("all")).alias("share"), F.sum("windows").alias("windows"))
        .orderBy(F.desc("share"), "context")
        .limit(most + 1)
        .toArrow()
    )
    context = ranked.column("context").to_numpy()
    fits = np.cumsum(ranked.column("windows").to_numpy()) <= max_windows
    fits[most:] = False
    return np.sort(context[fits]), bool(fits.all())


def freeze(counts: DataFrame, smoothing: str, max_windows: int = MAX_WINDOWS, max_cells: int = MAX_CELLS) -> Model | None:
    """The model of ``window_counts``; None where there are no counts.

    ``max_windows`` and ``max_cells`` bound the part in memory, for any input:
    contexts of three bytes with at most ``max_windows`` windows, and as many as
    make a table of at most ``max_cells`` numbers.  Code lengths always come from
    all counts, those of other contexts by ``Rest``.
    """
    counts = durable(counts)
    kinds = [r["kind"] for r in counts.select("kind").distinct().orderBy("kind").collect()]
    if not kinds:
        return None
    kinds = sorted(kinds)

    def fetched(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        got = rows.toArrow()
        kind = np.searchsorted(np.array(kinds), np.array(got.column("kind").to_pylist(), dtype=str))
        return kind, got.column("gram").to_numpy(), got.column("n").to_numpy()

    def by(width: int) -> DataFrame:
        return counts.groupBy("kind", F.col("gram").bitwiseAND(F.lit((1 << width) - 1)).alias("gram")).agg(F.sum("n").alias("n"))

    pairs = fetched(by(16))
    # Bytes of windows are bytes of texts (or the zero before one), so they all occur as a last byte.
    seen = np.unique(pairs[1] & 255)
    seen = seen[seen > 0]
    # Code 0 is the zero byte, also before a text; 1 is any byte that was never seen.
    symbol = np.ones(256, np.int32)
    symbol[0] = 0
    symbol[seen] = np.arange(2, len(seen) + 2)
    size = len(seen) + 2
    context, whole = _contexts(counts, max(256, max_cells // (size * len(kinds))), max_windows)
    spark = counts.sparkSession

    def only(rows: DataFrame, contexts: np.ndarray) -> DataFrame:
        if whole:
            return rows
        chosen = spark.createDataFrame(pa.table({"context": pa.array(contexts, pa.int64())}))
        return rows.join(F.broadcast(chosen), F.shiftright("gram", 8) == F.col("context"), "left_semi")

    wide = {1: pairs, 2: fetched(only(by(24), np.unique(context & 0xFFFF))), 3: fetched(only(counts, context))}
    wide[0] = pairs

    def key_of(order: int, before: np.ndarray) -> np.ndarray:
        """The bytes before the last one in codes, for contexts of ``order`` bytes."""
        key = np.zeros(len(before), np.int64)
        for back in range(order - 1, -1, -1):
            key = key * size + symbol[(before >> 8 * back) & 255]
        return key

    known: dict[int, np.ndarray] = {3: np.unique(key_of(3, context))}
    for order in (2, 1, 0):
        known[order] = np.unique(np.concatenate([key_of(order, wide[order][1] >> 8), known[order + 1] % size**order]))
    levels: dict[int, np.ndarray] = {}
    for order in (3, 2, 1, 0):
        kind, gram, n = wide[order]
        row = np.searchsorted(known[order], key_of(order, gram >> 8))
        flat = (kind * len(known[order]) + row) * size + symbol[gram & 255]
        cells = len(kinds) * len(known[order]) * size
        levels[order] = np.bincount(flat, n, cells).astype(np.float32).reshape(len(kinds), -1, size)
    up = {k: np.searchsorted(known[k - 1], known[k] % size ** (k - 1)) for k in (3, 2, 1)}
    tables, base, first = [], {}, 0
    for order in (0, 1, 2, 3) if whole else (3,):
        rows = len(known[order])
        base[order], first = first, first + rows
        table = np.empty((rows, size, len(kinds)), np.float32)
        for low in range(0, rows, 2048):
            here = np.arange(low, min(rows, low + 2048))
            for k in range(len(kinds)):
                chain, at = [], here
                for lower in range(order, -1, -1):
                    chain.append(levels[lower][k][at])
                    if lower:
                        at = up[lower][at]
                table[here, :, k] = SMOOTHING[smoothing](chain)
        tables.append(table)
    index = np.full((size, size, size), 0 if whole else -1, np.int32)
    if whole:
        index[:, :, known[1]] = (base[1] + np.arange(len(known[1]))).astype(np.int32)
        index[:, known[2] // size, known[2] % size] = (base[2] + np.arange(len(known[2]))).astype(np.int32)
    index.reshape(-1)[known[3]] = (base[3] + np.arange(len(known[3]))).astype(np.int32)
    rest = None
    if not whole:
        # One row at least, so that look-ups outside the table have a place to point to.
        tables = tables if first else [np.zeros((1, size, len(kinds)), np.float32)]
        short = np.zeros((len(kinds), 256, 256), np.float32)
        short[pairs[0], pairs[1] >> 8, pairs[1] & 255] = pairs[2]
        rest = Rest(counts, kinds, short, smoothing)
    return Model(kinds, symbol, index.reshape(-1), np.concatenate(tables), rest)


def _outside_bits(df: DataFrame, model: Model, shared) -> DataFrame | None:
    """``(__h1, __h2, __more)``: bits of the texts' windows outside the table; None if there are none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for block in arrowtext.blocks(batch.column(2)):
                text, gram, n = own.outside(block)
                at = pa.array(block.first + text)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(gram), pa.array(n)],
                    names=["__h1", "__h2", "gram", "n"],
                )

    # Equal texts have equal windows.
    left = durable(
        df.select("__h1", "__h2", "__text").mapInArrow(count, "__h1 long, __h2 long, gram long, n long")
        .groupBy("__h1", "__h2", "gram").agg(F.max("n").alias("n"))
    )
    grams = durable(left.groupBy("gram").agg(F.count("*").alias("texts")))
    total = grams.agg(F.sum("texts")).first()[0]
    if not total:
        return None
    costs = durable(model.rest.costs(grams.select("gram")))
    # Windows of a thousandth of the rows each are broadcast, so that none of them fills a task.
    hot = durable(grams.where(F.col("texts") > total / 1000).select("gram"))
    rows = left.join(F.broadcast(costs.join(F.broadcast(hot), "gram")), "gram").unionByName(
        left.join(F.broadcast(hot), "gram", "left_anti").join(graph.fitting(costs, 16 + 8 * len(model.kinds)), "gram")
    )
    sums = [F.sum(F.col("n") * F.col("bits")[k].cast("double")) for k in range(len(model.kinds))]
    more = durable(rows.groupBy("__h1", "__h2").agg(F.array(*sums).alias("__more")))
    return graph.fitting(more, 32 + 8 * len(model.kinds))


def scored(df: DataFrame, text: str, model: Model | None) -> DataFrame:
    """``df`` without column ``text``, plus ``n_bytes`` and ``bits`` (one per class)."""
    rest = [f for f in df.schema.fields if f.name != text]
    own = F.col(text).cast("string")
    hashes = [] if model is None or model.whole else ["__h1", "__h2"]
    hashed = [T.StructField(h, T.LongType()) for h in hashes]
    schema = T.StructType(
        [*rest, *hashed, T.StructField("n_bytes", T.LongType()), T.StructField("bits", T.ArrayType(T.DoubleType()))]
    )
    for_tasks = model and Model(model.kinds, model.symbol, model.index, model.table)
    shared = df.sparkSession.sparkContext.broadcast(for_tasks)
    names = [f.name for f in schema.fields]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for block in arrowtext.blocks(batch.column(len(names) - 2)):
                n = len(block)
                bits = own.bits(block) if own else np.zeros((n, 0))
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(n + 1, dtype=np.int32) * bits.shape[1]), pa.array(bits.reshape(-1))
                )
                kept = [batch.column(k).slice(block.first, n) for k in range(len(names) - 2)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(block.at)), lists], names=names)

    name = [F.xxhash64(own).alias("__h1"), F.xxhash64(F.lit("~"), own).alias("__h2")] if hashes else []
    rows = df.select(*[F.col(f.name) for f in rest], *name, own.alias("__text"))
    out = rows.mapInArrow(score, schema)
    more = _outside_bits(rows, model, shared) if hashes else None
    if more is not None:
        both = F.zip_with("bits", "__more", lambda a, b: a + b)
        out = out.join(more, hashes, "left").withColumn("bits", F.coalesce(both, "bits"))
    return out.select(*[f.name for f in rest], "n_bytes", "bits")
