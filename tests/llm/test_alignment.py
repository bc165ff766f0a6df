"""Alignment of two tokenizers against loops over the libraries."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.data import SCHEMA, awkward, corpus, documents
from trialframe.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LIBRARY_A = Tokenizer.from_file(A)
LIBRARY_A.encode_special_tokens = True
LIBRARY_B = sentencepiece.SentencePieceProcessor(model_file=B)
BOTH = alignment.Tokenizers(A, B)
ODD = ["a  b", "tab\tx", " lead", "end ", "▁x", "<s>x</s><|endoftext|>", "café 中\U0001f600", "\x00\x01", "\n\n", "=" * 5000]


def byte_table():
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in keep)}


def tokens(text):
    """``(id, begin, end)`` of both kinds, or none."""
    table = byte_table()
    a = [(i, bytes(table[c] for c in LIBRARY_A.id_to_token(i))) for i in LIBRARY_A.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in LIBRARY_B.encode(text):
        piece = LIBRARY_B.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if LIBRARY_B.is_byte(i) else piece.replace("▁", " ").encode()))
    out = []
    for kind in (a, b):
        if not text or b"".join(x for _, x in kind) != (" " + text).encode():
            return [], []
        at, spans = 0, []
        for i, x in kind:
            spans.append((i, at, at + len(x)))
            at += len(x)
        out.append(spans)
    return out


def plain(rows):
    found = []
    for doc, text, *_ in rows:
        a, b = tokens(text or "")
        links = [(x[0], y[0]) for x in a for y in b if x[2] == y[2]] if len(a) < 2000 else []
        if len(a) >= 2000:
            ends = {y[2]: y[0] for y in b}
            links = [(x[0], ends[x[2]]) for x in a if x[2] in ends]
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        parts, low, i, j = [], 0, 0, 0
        for cut in cuts:
            left, right = [], []
            while i < len(a) and a[i][2] <= cut:
                left.append(str(a[i][0]))
                i += 1
            while j < len(b) and b[j][2] <= cut:
                right.append(str(b[j][0]))
                j += 1
            parts.append(",".join(left) + "|" + ",".join(right))
        digest = hashlib.sha256(";".join(parts).encode()).hexdigest() if a else ""
        found.append((doc, len(a), len(b), len(cuts), links, digest))
    count = Counter(pair for f in found for pair in f[4])
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return sorted(
        (str(doc), n_a, n_b, cuts, len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), digest)
        for doc, n_a, n_b, cuts, links, digest in found
    )


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(st.sampled_from(list("ab'sé1.\n\t \u00a0\u180e\u200b\u3000\x1c\x85▁<s>")), max_size=30)))
def test_units_encode_as_whole_texts(text):
    assert BOTH.cuts
    whole = BOTH.whole([text])[0]
    assert BOTH.encode([text]) == [whole and tuple(x.tobytes() for x in whole)]
    a, b = tokens(text)
    assert whole is None and not a or [x[0] for x in a] == whole[0].tolist() and [x[0] for x in b] == whole[1].tolist()


@pytest.mark.parametrize("hot", [1 << 18, 40, 0])
def test_documents_equal_plain(spark, hot):
    rows = awkward() + corpus(n=30) + [(500 + k, x, "en", "a", 1) for k, x in enumerate(ODD)]
    out = alignment.align(documents(spark, rows, clashing=True).repartition(3), A, B, hot).collect()
    got = sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in out)
    assert got == plain(rows)


def test_no_rows(spark):
    assert alignment.align(spark.createDataFrame([], SCHEMA), A, B).count() == 0


@pytest.mark.parametrize("kind", ["overlap", "group", "end"])
def test_links_of_every_kind(spark, kind):
    rows = [(k, x, "", "", 0) for k, x in enumerate(["Hello wonderful worlds", "naïve cafés 12.5", "", None, "unalignable things"])]
    out = {tuple(r) for r in alignment.links(documents(spark, rows), A, B, kind).collect()}
    want = set()
    for doc, text, *_ in rows:
        a, b = tokens(text or "")
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                common = min(x[2], y[2]) - max(x[1], y[1])
                group = np.searchsorted(cuts, x[2]) == np.searchsorted(cuts, y[2])
                weight = {"overlap": max(common, 0), "group": int(group), "end": int(x[2] == y[2])}[kind]
                if weight:
                    want.add((doc, i, x[0], j, y[0], weight))
    assert out == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=4), max_size=8), st.lists(st.lists(st.integers(0, 6), max_size=4), min_size=6, max_size=6))
def test_product_equals_dense(left, right):
    def csr(lists, width):
        at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        return alignment.Csr(at, np.array([y for x in lists for y in x], np.int64), width)

    def dense(lists, width):
        out = np.zeros((len(lists), width), int)
        for i, x in enumerate(lists):
            for y in x:
                out[i, y] += 1
        return out

    got = np.zeros((len(left), 7), int)
    for i, j, v in csr(left, 6).product(csr(right, 7)):
        got[i, j] += v
    assert (got == dense(left, 6) @ dense(right, 7)).all()
    assert (dense(left, 6).T.sum(1) == np.diff(csr(left, 6).transposed().at)).all()
