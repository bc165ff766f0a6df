"""The n-gram join against all pairs."""

from __future__ import annotations

import re
from itertools import combinations

import pytest

from tests.llm.data import corpus, documents
from trialframe.llm import ngram_join
from trialframe.llm.arrowtext import blocks, shingles, span_hash
from trialframe.llm.arrowtext import Words


def grams(text: str, size: int = 5) -> set:
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def expected(rows):
    sets = {r[0]: grams(r[1]) for r in rows}
    links = {k: set() for k in sets}
    for a, b in combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if common and common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
            links[a].add(b)
            links[b].add(a)
    group = {}
    for k in sets:
        seen, todo = {k}, [k]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        group[k] = min(seen)
    return links, group


@pytest.mark.parametrize("block", [512, 4])
def test_links_and_groups_are_those_of_all_pairs(spark, block):
    rows = corpus(n=90)
    base = rows[0][1].split(" ")
    # A large group of near copies, for which buckets are dealt into blocks.
    rows += [(1000 + k, " ".join([*base[: len(base) // 2], f"w{k}", *base[len(base) // 2 :]]), "en", "a", 0) for k in range(25)]
    links, group = expected(rows)
    out = ngram_join.jaccard_join(documents(spark, rows), block=block).collect()
    assert {r.doc_id: r.n_links for r in out} == {k: len(v) for k, v in links.items()}
    assert {r.doc_id: r.component_id for r in out} == group
    assert all(r.kept == (r.doc_id == group[r.doc_id]) for r in out)


def test_stage_keeps_one_of_each_group(spark):
    rows = corpus() + [(900, "", "en", "a", 0), (901, " ", "en", "a", 0), (None, "", "en", "a", 0)]
    _, group = expected(corpus())
    kept = {r.doc_id for r in ngram_join.first_of_groups(documents(spark, rows)).collect()}
    assert kept == {k for k in group if group[k] == k} | {900, None}


def test_hashes_do_not_depend_on_place():
    import pyarrow as pa

    texts = ["ab cd ef gh ij kl", "x ab cd ef gh ij kl", None, "", "\u00e9t\u00e9 ab"]
    own = [set(shingles(Words(b), 5)[0].tolist()) for t in texts for b in blocks(pa.array([t]))]
    block = next(blocks(pa.array(texts)))
    hashes, text = shingles(Words(block), 5)
    together = [set(hashes[text == k].tolist()) for k in range(len(texts))]
    assert own == together and own[0] < own[1] and not own[2] and len(own[4]) == 1
    assert len(span_hash(block.data, block.at[:1], block.at[1:2])) == 1
