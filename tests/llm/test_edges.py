"""Every document operator and stage on awkward rows, empty tables and clashing columns."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
import pytest

from tests.llm.data import SCHEMA, awkward, documents
from trialframe.llm import bpe, langid, licences, lines, ngram_join, packing, quality

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")

OPERATORS = {
    "bpe": lambda d: bpe.round_trip(d, RANKS, public_tokenizers.PATTERN),
    "lines": lambda d: lines.dedup_lines(d.select("doc_id", "text")),
    "quality": quality.rejected,
    "ngram_join": ngram_join.jaccard_join,
    "packing": lambda d: packing.pack(d, VOCABULARY),
    "licences": licences.licences,
    "langid": langid.languages,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows_give_defined_results(spark, name):
    rows = awkward()
    out = OPERATORS[name](documents(spark, rows, clashing=True)).toPandas()
    ids = sorted(out.drop_duplicates(["doc_id", "piece"]).doc_id if name == "packing" else out.doc_id, key=str)
    if name == "packing":
        assert set(map(str, ids)) >= {"1.0", "2.0", "-100.0"}
    else:
        assert len(out) == len(rows)
    plain = OPERATORS[name](documents(spark, rows)).toPandas()
    order = [c for c in plain.columns if c not in ("sequence_id", "offset", "removed")]
    assert sorted(map(str, plain[order].to_numpy().tolist())) == sorted(map(str, out[order].to_numpy().tolist()))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_give_no_rows(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]], ids=[n for n, _ in corpus_pipeline.STAGES[:-1]])
@pytest.mark.parametrize("rows", [awkward(), []], ids=["awkward", "empty"])
def test_stages_keep_the_columns(spark, stage, rows):
    docs = documents(spark, rows, clashing=True)
    out = stage(spark, docs, "")
    assert out.dtypes == docs.dtypes
    assert {r.doc_id for r in out.collect()} <= {r[0] for r in rows}


def test_results_of_awkward_rows(spark):
    docs = documents(spark, awkward())
    joined = {r.doc_id: r for r in ngram_join.jaccard_join(docs).collect()}
    assert joined[1].n_links == joined[2].n_links == joined[3].n_links == 0
    assert joined[4].n_links == 4 and joined[4].component_id == -100 and not joined[4].kept
    assert joined[None].component_id is None and joined[None].kept
    found = {r.doc_id: r for r in langid.languages(docs).collect()}
    assert [found[k].lang_pred for k in (1, 2, 3, 11)] == ["und"] * 4 and found[1].score == 0
    assert {r.doc_id: r.families for r in licences.licences(docs).collect()}[10] == "reserved"
    left = {r.doc_id: r for r in lines.dedup_lines(docs).collect()}
    assert left[1].left is None and left[200].n_removed == 4 and left[200].left == "same line here now"
    assert left[-100].n_removed == 0 and left[4].n_removed == 2 and left[None].n_removed == 0
