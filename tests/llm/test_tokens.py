"""BPE and word ids against their libraries; packing against its rules."""

from __future__ import annotations

import base64
import hashlib
import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.data import awkward, corpus, documents
from trialframe.llm import bpe, packing

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
with open(RANKS, "rb") as _lines:
    _TABLE = {base64.b64decode(a): int(b) for a, b in map(bytes.split, _lines)}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_TABLE, special_tokens={})
OWN = bpe.ByteBpe(RANKS, public_tokenizers.PATTERN)
WORDS = packing.WordIds(VOCABULARY)
ODD = st.text(st.sampled_from(list("aBé ß'stre\n\t²½ſİΣς_-中́\x1c\x85÷ŉǅ<|endotx>Ÿﬁй😀!1")), max_size=40)


def test_every_token_encodes_itself():
    """The join of two halves relies on it."""
    assert all(OWN.merge(token) == (rank,) for token, rank in _TABLE.items())


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=200), ODD, st.text("ab ", max_size=300), st.text("=-", max_size=300)))
def test_bpe_equals_the_library(text):
    ids = OWN.encode(text).tolist()
    assert ids == LIBRARY.encode_ordinary(text)
    assert OWN.decode(ids) == text.encode()


def test_long_pieces_are_joined_by_halves():
    rnd = random.Random(5)
    for text in ("a" * 3000, " " * 5000, "".join(rnd.choice("etaoin") for _ in range(4000))):
        assert OWN.encode(text).tolist() == LIBRARY.encode_ordinary(text)


def test_word_ids_of_every_character_equal_the_library():
    """All assigned code points and 10,000 others, behind a sign, a letter and a digit."""
    rest = [c for c in range(0x80, 0x110000) if unicodedata.category(chr(c)) == "Cn"]
    some = {c for c in range(0x80, 0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")}
    chosen = sorted(some | set(random.Random(1).sample(rest, 10_000)))
    for low in range(0, len(chosen), 500):
        texts = [f"\u00a1{chr(c)} a{chr(c)}B 1{chr(c)}" for c in chosen[low : low + 500]]
        assert WORDS.encode(texts) == [WORDS.library(x) for x in texts]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=100), ODD))
def test_word_ids_equal_the_library(text):
    assert WORDS.encode([text])[0] == WORDS.library(text)


def test_digests(spark):
    rows = awkward() + corpus()
    out = bpe.round_trip(documents(spark, rows), RANKS, public_tokenizers.PATTERN).collect()
    want = []
    for doc, text, *_ in rows:
        ids = LIBRARY.encode_ordinary(text or "")
        want.append((doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("capacity", [2048, 50])
def test_pieces_and_sequences(spark, capacity):
    rows = awkward() + corpus()
    library = Tokenizer.from_file(VOCABULARY)
    want = []
    for doc, text, *_ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for n, low in enumerate(range(0, len(ids), capacity)):
            part = ids[low : low + capacity]
            want.append((doc, n, low, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    out = packing.pack(documents(spark, rows), VOCABULARY, capacity, with_ids=True).toPandas()
    got = [(None if np.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out.itertuples()]
    assert sorted(got, key=str) == sorted(want, key=str)
    for _, sequence in out.groupby("sequence_id"):
        sequence = sequence.sort_values("offset")
        assert sequence.offset.tolist() == [0, *sequence.length.cumsum().tolist()[:-1]]
        assert sequence.length.sum() <= capacity
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in out.itertuples())


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 400), max_size=40))
def test_plan_holds_exactly_the_histogram(histogram):
    held: dict[int, int] = {}
    runs = packing.plan(histogram, 100, groups=8)
    for many, lengths in runs:
        assert many > 0 and sum(lengths) <= 100
        for x in lengths:
            held[x] = held.get(x, 0) + many
    assert held == histogram
    total, count = sum(k * n for k, n in histogram.items()), sum(n for n, _ in runs)
    # First fit decreasing never needs more than 11/9 of the best plus one.
    assert count >= total / 100
    order = sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True)[:3000]
    if len(order) == sum(histogram.values()):
        bins: list[int] = []
        for k in order:
            at = next((i for i, room in enumerate(bins) if room >= k), None)
            if at is None:
                bins.append(100 - k)
            else:
                bins[at] -= k
        assert count <= 1.05 * len(bins) + 8


def test_plan_is_near_the_bound_on_many_lengths():
    rnd = random.Random(1)
    histogram: dict[int, int] = {}
    for _ in range(50_000):
        k = min(2048, int(rnd.expovariate(1 / 700)) + 1)
        histogram[k] = histogram.get(k, 0) + 1
    total = sum(k * n for k, n in histogram.items())
    assert sum(n for n, _ in packing.plan(histogram)) <= 1.01 * -(-total // 2048)
