"""Work and its place grow with the input, and no faster."""

import tracemalloc

import numpy as np
import test_chunks as chunks

from rasterjobs import queries
from rasterjobs.operators import coefficients, mcus, segments
from rasterjobs.plans import fixtures as X


def test_a_scan_plan_is_summed_where_its_images_are(spark, sf, same, monkeypatch):
    monkeypatch.setattr(coefficients, "PLAN_UNITS", 10_000, raising=False)
    done = queries.scan_plan(spark, sf)
    plan = done._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Generate")]
    assert "HashAggregate" in above and "Exchange" not in above  # no unit is dealt out
    assert done.rdd.getNumPartitions() > done.agg({"units": "sum"}).first()[0] / 20_000
    same(queries.scan_plan, queries.PLAN_SQL)


def test_every_chunk_is_guessed_where_tables_are_flat():
    content = X.encode(chunks._units(3, 64, 4, dense=1.0), 32, 512, h=2, v=2, restart=0)
    (_, data, _), = segments.split_intervals(content, content.index(b"\xff\xda") + 14)
    assert chunks._chunked(data, 256, 64 * 4 * 6 // 4)[1] == 1


def test_bits_are_put_aside_as_they_come():
    rng, w, want = np.random.RandomState(1), X.BitWriter(), ""
    for k in rng.randint(0, 17, 3000).tolist():
        v = int(rng.randint(0, 1 << 17))
        w.put(v, k)
        want += format(v & ((1 << k) - 1), f"0{k}b") if k else ""
        assert w.value.bit_length() < 1024
    want += "1" * (-len(want) % 8)
    assert w.data() == int(want, 2).to_bytes(len(want) // 8, "big").replace(b"\xff", b"\xff\x00")


def test_a_slice_of_blocks_takes_little_memory():
    coef = np.ones((mcus.UNITS, 1, 64), np.int16)
    tracemalloc.start()
    try:
        mcus._planes(coef, coef, [1], 1, 1)
        assert tracemalloc.get_traced_memory()[1] < 24 << 20
    finally:
        tracemalloc.stop()
