"""What the join of near copies does for large inputs: pairs that large groups make, and the filter of repeated keys."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rasterjobs.llm import common, ngram_join

LINE = " ".join(f"c{i}" for i in range(14))


def _sets(spark, texts, n=5):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("text", F.col("text").cast("binary"))
    return ngram_join._sets(docs, docs.select(F.col("doc_id").alias("id")), n)


def _group(spark, n):
    return spark.createDataFrame([(1, i, n, 0) for i in range(n)], "key long, rep long, size long, l1 long"), spark.createDataFrame([], "id long, component long")


def test_a_line_in_many_documents_makes_no_pairs(spark, monkeypatch):
    own = [[f"w{i}x{j}" for j in range(30)] for i in range(300)]
    own.append([*own[-1][:-1], "other"])  # the only near copy
    texts = [f"{LINE} {' '.join(x)}" for x in own]
    monkeypatch.setattr(ngram_join, "_room", lambda *_: F.lit(True))  # all pairs that meet, also those ruled out
    groups, label = _group(spark, len(texts))
    pairs = ngram_join._open_pairs(groups, _sets(spark, texts), label, 80, 100)
    found = {tuple(r) for r in pairs.collect()}
    assert (299, 300) in found and len(found) < len(texts)


def test_open_pairs_hold_all_that_link(spark, monkeypatch):
    for few, shared in ((16, 1_000), (2, 3)):  # also with frequent tokens dealt out
        monkeypatch.setattr(ngram_join, "FEW", few)
        monkeypatch.setattr(ngram_join, "SHARED", shared)
        rng, texts = random.Random(few), []
        for cloud in range(4):
            base = [f"v{cloud}x{i}" for i in range((7, 20, 60, 200)[cloud])]
            for _ in range(30):
                words = list(base)
                for _ in range(rng.randint(0, 1 + len(base) // 15)):
                    words[rng.randrange(len(words))] = f"e{rng.randrange(40)}"
                texts.append(" ".join(words) + f" {LINE}" * (cloud % 2))
        sets = [set(x.tolist()) for x in ngram_join.token_sets(pa.array(texts).cast(pa.binary()), 5)]
        want = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
        groups, label = _group(spark, len(texts))
        found = {tuple(r) for r in ngram_join._open_pairs(groups, _sets(spark, texts), label, 80, 100).collect()}
        assert len(want) > 100 and want <= found
        parts = {r.parts for r in ngram_join._rarest(_sets(spark, texts).withColumn("c", F.col("id")), 80, 100).select("parts").collect()}
        assert (max(parts) > 1) == (few == 2)


def test_the_filter_grows_with_the_repeated_keys(spark):
    def keys(batch):  # a third in two rows each, the others in one
        return [common.mix64(np.concatenate([np.arange(3 * i, 3 * i + 3) << 20, [(i // 2 << 1) + 1]]).astype(np.uint64)) for i in batch.column("i").to_pylist()]

    rows = spark.range(60_000).select(F.col("id").alias("i"))
    found = common.Repeated(rows, keys, 240_000)
    twice = common.mix64((np.arange(30_000) * 2 + 1).astype(np.uint64))
    once = common.mix64((np.arange(180_000) << 20).astype(np.uint64))
    assert 30_000 <= found.n < 30_020  # the first bits of keys may agree by chance
    assert 8 * len(found.bitmap.value) <= 24 * found.n  # not more than the keys ask for
    probe = found.probe()
    assert probe(twice).all() and probe(once).mean() < 0.02
    full = common.Repeated(rows, keys, 240_000, 17)  # over four bits a key are enough
    probe = full.probe()
    assert full.bitmap is not None and probe(twice).all() and probe(once).mean() < 0.3
    assert common.Repeated(rows, keys, 240_000, 16).bitmap is None
    assert common.FULL * 100_000_000 <= 1 << common.FILTER_BITS  # over twice those of 6 GB of documents
