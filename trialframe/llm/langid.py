"""Language identification by prediction by partial matching (operator 10).

For every language a tree of byte contexts (orders 3 to 0) is counted over all
labelled documents outside the held-out quarter.  Escape probabilities follow
method C with exclusion.  The statistics are then frozen, and a text's score is
its exact code length under each language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialframe.llm import bytemodel

UNDETERMINED = "und"
#: A flat code spends eight bits on every byte.
FLAT_BITS = 8.0


def held_out(doc_id: Column) -> Column:
    """The quarter of the documents that nothing is learned from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame) -> bytemodel.Model | None:
    """Frozen statistics of all labelled documents that are not held out."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return bytemodel.freeze(
        bytemodel.window_counts(labelled.select(F.col("lang").cast("string").alias("kind"), "text")), "ppm"
    )


def identify(docs: DataFrame, model: bytemodel.Model | None) -> DataFrame:
    """``doc_id, lang_pred, score, bits_per_byte`` for every row, from its text alone.

    ``lang_pred`` is the language of the shortest code (the first by name on a
    tie), ``und`` for a text that is null or has no letter, or when nothing was
    learned.  ``score`` is that language's share of ``2 ** -bits`` over all
    languages, 0 for ``und``.
    """
    kinds = model.kinds if model else []
    rows = docs.select(
        F.col("doc_id"),
        F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)).alias("letters"),
        F.col("text").cast("string").alias("text"),
    )
    out = bytemodel.scored(rows, "text", model)
    best = F.array_min("bits")
    names = F.array(*[F.lit(k) for k in kinds]) if kinds else F.array(F.lit(UNDETERMINED))
    known = F.col("letters") & F.lit(bool(kinds))
    share = F.aggregate(
        F.transform("bits", lambda b: F.pow(F.lit(2.0), F.greatest(best - b, F.lit(-1000.0)))),
        F.lit(0.0),
        lambda a, b: a + b,
    )
    place = F.array_position("bits", best).cast("int")
    return out.select(
        "doc_id",
        F.when(known, F.get(names, place - 1)).otherwise(F.lit(UNDETERMINED)).alias("lang_pred"),
        F.when(known, 1.0 / share).otherwise(F.lit(0.0)).alias("score"),
        F.when(known, best / F.col("n_bytes")).alias("bits_per_byte"),
    )


def languages(docs: DataFrame) -> DataFrame:
    """Learn from ``docs`` and identify each row: ``doc_id, held_out, lang_pred, score, bits_per_byte``.

    ``docs`` has ``doc_id``, ``text`` and ``lang``; other columns are not read.
    Repeated rows and ids each get their own row; no rows give no rows.
    """
    return identify(docs, learn(docs)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte"
    )


def keep_language(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text is in no learned language; columns as they were.

    A row goes if it is undetermined, or if its best language needs at least
    ``FLAT_BITS`` per byte.  Where nothing was learned, all rows stay.  Scores
    come from the row itself, so rows with equal or null ids are judged alone.
    """
    model = learn(docs)
    if model is None:
        return docs
    text = F.col("text").cast("string")
    plain = [docs[c].alias(f"c{k}") for k, c in enumerate(docs.columns)]
    rows = docs.select(*plain, F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"), text.alias("text"))
    out = bytemodel.scored(rows, "text", model)
    out = out.where(F.col("letters") & (F.array_min("bits") < FLAT_BITS * F.col("n_bytes")))
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
