"""What a Python worker holds at once, and what it keeps for later tasks."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterjobs.llm import common, decontaminate, queries, tokenpack


def _batch_sizes(spark) -> list[tuple[int, int]]:
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["rows", "bytes"])

    rows = spark.range(0, 4000, 1, 1).select(F.expr("repeat('x', 5000)").alias("text"))  # 20 MB in one task
    return [tuple(r) for r in common.stage(rows.mapInArrow(run, "rows long, bytes long"), "sizes").collect()]


@pytest.mark.parametrize(("set_", "most"), [("64m", common.BATCH_BYTES), ("1m", 1 << 20)])
def test_staged_tasks_get_small_batches(spark, set_, most):
    before = spark.conf.get(common._BATCH)
    spark.conf.set(common._BATCH, set_)
    try:
        sizes = _batch_sizes(spark)
        assert sum(rows for rows, _ in sizes) == 4000
        assert max(bytes_ for _, bytes_ in sizes) < 1.25 * most
        assert spark.conf.get(common._BATCH) == set_
    finally:
        spark.conf.set(common._BATCH, before)


def test_sizes_of_settings():
    assert [common._size(x) for x in ("67108864b", "64m", "64MB", "1k", "7", "-1")] == [64 << 20, 64 << 20, 64 << 20, 1024, 7, -1]


def _windows(n: int) -> pa.StructArray:
    words = [b" ".join(b"w%d" % (i + j) for j in range(13)) for i in range(n)]
    hashes = [decontaminate.ngram_hashes(decontaminate.text_words(pa.array([w]), decontaminate.ALNUM_LOWER)[0][0], 13)[0].view(np.int64) for w in words]
    return pa.StructArray.from_arrays([pa.array([13] * n, pa.int32()), pa.array(hashes, pa.int64()), pa.array(words, pa.binary()), pa.array([["a"]] * n)], ["len", "window", "words", "items"])


def test_item_windows_take_about_their_bytes():
    windows = _windows(5_000)
    held = pa.total_allocated_bytes()
    tracemalloc.start()
    known = decontaminate._by_length(windows)
    took = tracemalloc.get_traced_memory()[1] + pa.total_allocated_bytes() - held
    tracemalloc.stop()
    assert took < 3 * windows.nbytes  # as tuples of words they took over ten times that
    text = b"x " + windows.field("words")[77].as_py() + b" y"
    hashes = decontaminate.text_words(pa.array([text]), decontaminate.ALNUM_LOWER)[0][0]
    assert decontaminate._extend(pa.scalar(text), hashes, known) == (13, ["a"])


def test_windows_with_one_hash_are_told_apart_by_their_words():
    text = b"p q r"
    hashes = decontaminate.text_words(pa.array([text]), decontaminate.ALNUM_LOWER)[0][0]
    same = int(decontaminate.ngram_hashes(hashes, 2)[1].view(np.int64))
    rows = [(2, same, b"o o", ["other"]), (2, same, b"q r", ["b", "a"]), (1, 5, b"z", ["z"])]
    windows = pa.array([dict(zip(("len", "window", "words", "items"), r, strict=True)) for r in rows], pa.struct([("len", pa.int32()), ("window", pa.int64()), ("words", pa.binary()), ("items", pa.list_(pa.string()))]))
    assert decontaminate._extend(pa.scalar(text), hashes, decontaminate._by_length(windows)) == (2, ["a", "b"])
    assert decontaminate._extend(pa.scalar(text), hashes, decontaminate._by_length(windows[:1])) == (0, [])
    assert decontaminate._by_length(windows[:0]) == decontaminate._by_length(None) == {}


def test_an_encoder_keeps_no_words_for_the_next_task():
    path = queries.tokenizer()
    with tokenpack.encoding(path) as enc:
        first = [x.tolist() for x in enc.batch(["some words of a task"])]
        assert enc.words
    assert not enc.words and len(enc.ids) == 0
    with tokenpack.encoding(path) as again:
        assert again is enc and [x.tolist() for x in again.batch(["some words of a task"])] == first
