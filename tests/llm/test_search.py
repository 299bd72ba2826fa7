"""Ranked search against brute force and SQL."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from rasterjobs.llm import queries, search

TERM = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def _terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def _brute(docs, items, k=10):
    words = [(i, _terms(t)) for i, t in docs]
    words = [(i, w) for i, w in words if w]
    n_docs, n_words = len(words), sum(len(w) for _, w in words)
    out = []
    for item, text in items:
        found = []
        for i, w in words:
            m = 25 + 75 * len(w) * n_docs // n_words
            score = 0
            for t in _terms(text):
                tf = w.count(t)
                if tf:
                    df = sum(t in x for _, x in words)
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            if score > 0:
                found.append((-score, i is not None, i or 0))
        out += [(item, r, i if known else None, -s) for r, (s, known, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def _got(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_search_against_brute_force(spark, monkeypatch, block_bytes):
    rng = random.Random(3)
    vocabulary = ["the", "a1", "É", "é", "Été", "x", "xx", "日本", "42", *(f"w{i}" for i in range(30))]
    docs = [(i, rng.choice([" ", "-", "\n", "\0", "!"]).join(rng.choices(vocabulary, k=rng.randrange(1, 25)))) for i in range(300)]
    docs += [(500 + i, "The w1 same text") for i in range(40)]  # ties, dealt over tasks
    docs += [(7, "the w2"), (7, "the w2"), (None, "The w1 same text"), (None, None), (900, ""), (901, "?!"), (902, "w3 " * 5000)]
    items = [(1, "the W1 w1 é"), (2, "xx 日本 missing"), (3, None), (4, "..."), (None, "w2 w3"), (5, "nowhere"), (6, "the the"), (6, "the the"), (7, " ".join(vocabulary))]
    df, t = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    for c in ("item", "rank", "n", "score", "block", "terms", "salt"):
        df, t = df.withColumn(c, F.lit("clash")), t.withColumn(c, F.lit("clash"))
    assert _got(search.search(df, t, block_bytes=block_bytes)) == _brute(docs, items)


def test_small_bounds_within_a_task(monkeypatch):
    import numpy as np

    monkeypatch.setattr(search, "CANDIDATES", 5)
    rng = np.random.RandomState(1)
    scores, ids = rng.randint(-3, 6, (200, 4)), rng.randint(0, 50, 200)
    best = search.Best(3, 4)
    for lo in range(0, 200, 7):
        best.add(scores[lo : lo + 7], np.ones(len(ids[lo : lo + 7]), int), ids[lo : lo + 7])
    best.trim()
    item, score, _, found = best.held
    want = [(i, s, d) for i in range(4) for s, d in sorted(((s, d) for s, d in zip(scores[:, i].tolist(), ids.tolist()) if s > 0), key=lambda x: (-x[0], x[1]))[:3]]
    assert list(zip(item.tolist(), score.tolist(), found.tolist())) == want


def test_empty_tables(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "benchmark"))
    for a, b in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0))):
        out = search.search(a, b)
        assert out.collect() == [] and out.columns == ["item_id", "rank", "doc_id", "score"]


def test_op13_matches_sql(same):
    same(queries.op13_ranked_search, queries.OP13)
