"""The tokenization automaton against plain merging, and the query against the library."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterjobs.llm import bpe, common, queries


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer())


@pytest.fixture(scope="module")
def encoder():
    return bpe.AutomatonEncoder(bpe.load(queries.tokenizer()))


def _merge(word, merges):
    """Plain merging: the earliest merge that fits anywhere, at its leftmost place, until none fits."""
    ids, rank = list(word), {(a, b): (r, c) for r, (a, b, c) in reversed(list(enumerate(merges)))}
    while True:
        fits = [(rank[p][0], i) for i, p in enumerate(zip(ids[:-1], ids[1:])) if p in rank]
        if not fits:
            return ids
        _, i = min(fits)
        ids[i : i + 2] = [rank[ids[i], ids[i + 1]][1]]


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_any_merges_against_plain_merging(data):
    letters = data.draw(st.integers(1, 3))
    labels, merges, seen = [bytes([97 + i]) for i in range(letters)], [], set()
    for _ in range(data.draw(st.integers(0, 12))):  # also merges that no text can reach
        a, b = (data.draw(st.integers(0, len(labels) - 1)) for _ in "ab")
        if labels[a] + labels[b] not in labels and (a, b) not in seen and len(labels[a] + labels[b]) <= 8:
            seen.add((a, b))
            labels.append(labels[a] + labels[b])
            merges.append((a, b, len(labels) - 1))
    walker = bpe.Walker(bpe.compile_merges(labels, merges))
    words = data.draw(st.lists(st.lists(st.integers(0, letters - 1), max_size=14), max_size=6))
    ids, n = walker.encode([bytes(97 + i for i in w) for w in words])
    got = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] if len(words) else []
    assert got == [_merge(w, merges) for w in words]


TEXTS = ["", "y" * 20_000, " " * 300, "-" * 1000, "<|endoftext|>", "a<|endoftext|> <|endoftext|>b ", "x <|endoftext", "don't we'll  go\t\n\n now", "naïve 日本語 한글 😀️   x\x1cy\x85z", "1234 56,78.9%", "aaaa" * 50, "꟎! ͸a", "a\n b\n\nc  d"]


def test_awkward_texts_equal_the_library(encoder, library):
    want = [library.encode(t, add_special_tokens=False).ids for t in TEXTS]
    got = encoder.batch(TEXTS)
    assert [g.tolist() for g in got] == want == encoder._encode(TEXTS)
    assert encoder.decode(got) == [library.decode(w, skip_special_tokens=False) for w in want] == TEXTS


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_text_equals_the_library(encoder, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert encoder.batch([text])[0].tolist() == ids and encoder.decode([np.array(ids)]) == [text]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=12))
def test_any_ids_decode_as_in_the_library(encoder, library, ids):
    assert encoder.decode([np.array(ids, np.int64)]) == [library.decode(ids, skip_special_tokens=False)]


def test_op12_equals_the_library(spark, sf, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op12_bpe_automaton(spark, sf).collect()}
    for r in common.table(spark, sf, "documents").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert got.pop(r.doc_id) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert not got


def test_tables(spark, library):
    rows = [*enumerate(TEXTS), (None, "x"), (3, None), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("id", "ids", "n_tokens"):
        df = df.withColumn(c, F.lit("clash"))
    tokens = bpe.encode(df, queries.tokenizer())
    want = sorted((repr(i), library.encode(t or "", add_special_tokens=False).ids) for i, t in rows)
    assert sorted((repr(r.doc_id), r.ids) for r in tokens.collect()) == want
    assert sorted((repr(r.doc_id), r.text) for r in bpe.decode(tokens, queries.tokenizer()).collect()) == sorted((repr(i), t or "") for i, t in rows)
    assert bpe.round_trip(df, queries.tokenizer()).count() == len(rows)
    assert bpe.round_trip(df.limit(0), queries.tokenizer()).count() == 0
