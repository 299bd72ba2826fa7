"""Long entropy data decoded in chunks, and DC values summed in segments."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterjobs.operators import coefficients, huffman, segments
from rasterjobs.plans import fixtures as X
from rasterjobs.plans.decode import decode


def _units(seed, down, across, h=2, v=2, dense=0.05):
    rng, out = np.random.RandomState(seed), {}
    for r in range(down + down % v):
        for c in range(across + across % h):
            for k in (1, 2, 3) if r % v == 0 and c % h == 0 else (1,):
                out[k, r, c] = (rng.randint(-90, 90, 64) * (rng.rand(64) < dense)).astype(int).tolist()
    return out


CELLS = [(k, huffman.lookup(tuple(12 if x == 4 else 0 for x in range(1, 17)), tuple(X.DC_SYMBOLS)), huffman.lookup(tuple(162 if x == 8 else 0 for x in range(1, 17)), tuple(X.AC_SYMBOLS))) for k in (1, 1, 1, 1, 2, 3)]


def _chunked(data, size, units):
    """What the rounds of ``beginnings`` do, without Spark."""
    n = -(-len(data) // size)
    chunks = [data[i * size : (i + 1) * size + huffman.TAIL] for i in range(n)]
    guesses = [huffman.guess(chunks[i], CELLS, 8 * size) for i in range(n - 1)]
    out, at, first, right = [], (0, 0), 0, 0
    for i in range(n):
        end = 8 * size if i < n - 1 else None
        out += huffman.decode_interval(chunks[i], CELLS, units - first, start=at[0], cell=at[1], end=end)
        if i == n - 1:
            break
        entries = {at} | (guesses[i - 1] if i else set())
        right += at in (guesses[i - 1] if i else {at})
        found = huffman.walk(chunks[i], CELLS, 8 * size, entries)
        for e in entries:  # walks that meet agree with walks alone
            assert found[e] == huffman.walk(chunks[i], CELLS, 8 * size, [e])[e]
        bit, cell, done = found[at]
        first += done
        if bit < 0 or first >= units:
            break
        at = (bit, cell)
    return out, right / max(1, n - 1)


@pytest.mark.parametrize("broken", [False, True])
def test_cuts_at_every_byte_give_equal_units(broken):
    content = X.encode(_units(1, 6, 4), 32, 48, h=2, v=2, restart=0)
    (_, data, error), = segments.split_intervals(content, content.index(b"\xff\xda") + 14)
    assert error is None
    if broken:
        data = data[: len(data) // 2] + b"\xcc" * 4 + data[len(data) // 2 :]
    units = 6 * 4 + 12
    want = list(huffman.decode_interval(data, CELLS, units))
    assert (want[-1][-1] is not None) == broken
    for size in range(1, len(data) + 1):
        assert _chunked(data, size, units)[0] == want, size


def test_guesses_are_mostly_right():
    content = X.encode(_units(2, 40, 20), 160, 320, h=2, v=2, restart=0)
    (_, data, _), = segments.split_intervals(content, content.index(b"\xff\xda") + 14)
    assert _chunked(data, 1024, 1200)[1] > 0.8


def test_a_large_unmarked_image_is_many_tasks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")}
    for k, v in zip(before, ("false", "0", "20000"), strict=True):
        spark.conf.set(k, v)
    try:
        rows, want = [], {}
        for k, (down, across, gap) in enumerate([(60, 30, 0), (5, 5, 0), (12, 9, 7), (1, 1, 0)]):
            want[k] = _units(k, down, across)
            rows.append((k, bytearray(X.encode(want[k], 8 * across, 8 * down, h=2, v=2, restart=gap))))
        cut = rows[0][1][: len(rows[0][1]) // 2]
        df = spark.createDataFrame([*rows, (9, cut)], "image_id long, content binary")
        done = decode(df, chunk_bytes=300)
        got = {}
        for r in done.coefficients.collect():
            got.setdefault(r.image_id, {})[r.component, r.du_row, r.du_col] = list(r.coef)
        assert got == want
        assert {r.image_id for r in done.errors.collect()} == {9}
        segs = segments.segments(df)
        spread = huffman.decode_units(segments.entropy_intervals(df.filter("image_id = 0"), segs), _tables(df.filter("image_id = 0")), 300)
        tasks = spread.withColumn("task", F.spark_partition_id()).groupBy("task").count().count()
        assert tasks >= 3 and spread.count() == 60 * 30 + 2 * 30 * 15
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _tables(df):
    from rasterjobs.plans.decode import _scan_tables, image_table

    segs = segments.segments(df)
    return _scan_tables(segs, image_table(segs))


@pytest.mark.parametrize("known", [True, False])
def test_a_long_interval_is_summed_in_segments(spark, known):
    rng = np.random.RandomState(5)
    rows = [(i % 2 or None, i % 3, 0, i, int(rng.randint(-50, 50))) for i in range(3000)]
    df = spark.createDataFrame(rows, "image_id long, component int, interval_no int, seq long, dc_diff int")
    out = coefficients.dc_predict(df, "seq", segment=F.floor(F.col("seq") / 100) if known else None)
    sums, want = {}, {}
    for image, component, _, seq, diff in rows:
        want[seq] = sums[image, component] = sums.get((image, component), 0) + diff
    assert {r.seq: r.dc for r in out.collect()} == want and out.columns == [*df.columns, "dc"]
    plan = out._jdf.queryExecution().toString()
    assert "windowspecdefinition(image_id" not in plan and "_slice" in plan
