"""MCU rows: chunks of any size, pixels by projection, tables carried once, DC values that wrap around."""

import re

import numpy as np
from pyspark.sql import functions as F

from rasterjobs.operators import huffman, mcus, segments, transform
from rasterjobs.plans import fixtures as X
from rasterjobs.plans.decode import _scan_tables, decode, image_table


def _units(seed, down, across, h, v, dc=None):
    rng, out = np.random.RandomState(seed), {}
    for r in range(down + down % v):
        for c in range(across + across % h):
            for k in (1, 2, 3) if r % v == 0 and c % h == 0 else (1,):
                out[k, r, c] = (rng.randint(-90, 90, 64) * (rng.rand(64) < 0.1)).astype(int).tolist()
                if dc:
                    out[k, r, c][0] = dc(r, c)
    return out


def _parts(spark, rows):
    df = spark.createDataFrame(rows, "image_id long, content binary")
    segs = segments.segments(df)
    return segments.entropy_intervals(df).persist(), _scan_tables(segs, image_table(segs)).persist()


def test_chunks_of_any_size_give_equal_rows(spark):
    rows = []
    for k, (h, v) in enumerate([(2, 2), (2, 1), (1, 2), (1, 1)]):
        content = X.encode(_units(k, 4, 6, h, v), 48, 32, h=h, v=v, restart=0)
        rows.append((k, bytearray(content)))
        head = len(content) // 2 + 150
        rows.append((10 + k, bytearray(content[:head] + b"\xcc" * 4 + content[head:])))
    intervals, tables = _parts(spark, rows)

    def got(size):
        out = mcus.decode_mcus(intervals, tables, size).collect()
        assert len({(r.image_id, r.mcu) for r in out}) == len(out)
        return {(r.image_id, r.mcu): r.asDict() for r in out}

    want = got(1 << 20)
    assert {i for i, m in want if want[i, m]["error"]} <= {10, 11, 12, 13} and any(r["error"] for r in want.values())
    for size in (3, 40, 217):
        assert got(size) == want, size


def test_from_decoder_to_rgb_is_a_projection(spark):
    rows = [(k, bytearray(X.encode(_units(k, 4, 4, h, v), 30, 27, h=h, v=v, restart=gap))) for k, (h, v, gap) in enumerate([(2, 2, 0), (2, 1, 3), (1, 2, 0), (1, 1, 1)])]
    done = decode(spark.createDataFrame(rows, "image_id long, content binary"))
    # the same by way of a table of blocks, joined with steps and paired by a join
    intervals, tables = _parts(spark, rows)
    units = mcus.decode_mcus(intervals, tables)
    steps = tables.select("image_id", F.explode("cells").alias("c")).select("image_id", "c.component", "c.q").distinct()
    plain = transform.samples(mcus.blocks(units).join(steps, ["image_id", "component"]))
    plain = transform.rgb_blocks(transform.pair_chroma(plain, done.images))
    assert sorted(map(str, done.rgb.collect())) == sorted(map(str, plain.collect()))
    plan = mcus.rgb(units)._jdf.queryExecution().executedPlan().toString()
    after = plan.split("MapInArrow")[1]  # from RGB down to the decoder
    assert not any(x in after for x in ("Exchange", "Join", "Aggregate", "Window"))


def test_missing_rows_and_chroma_alone(spark):
    row = "image_id long, mcu long, du_row int, du_col int, h int, v int, components array<int>, coef array<short>, quant binary"
    steps, dc = bytes([1, 0]) * 64, [8 * 50] + [0] * 63
    df = spark.createDataFrame([(1, 0, 0, 0, 2, 1, [1, 1, 2, 3], None, None), (2, 0, 4, 2, 2, 2, [3], dc, steps), (None, 0, 0, 0, 1, 1, [1], dc, steps), (3, 0, 0, 0, 2, 2, [1], dc, None)], row)
    got = {(r.image_id, r.du_row, r.du_col): (set(r.r), set(r.g), set(r.b)) for r in mcus.rgb(df).collect()}
    gray = ({128},) * 3
    assert {k for k, x in got.items() if x == gray} == {(1, 0, 0), (1, 0, 1), (3, 0, 0)}
    y, = got[None, 0, 0][0]
    assert got[None, 0, 0] == ({y},) * 3 and y > 128
    reds = [got[2, r, c] for r in (4, 5) for c in (2, 3)]
    assert len(got) == 8 and all(x == reds[0] for x in reds) and reds[0][2] == {128} and min(reds[0][0]) > 128 > max(reds[0][1])
    assert mcus.rgb(df.limit(0)).collect() == []


def test_entropy_bytes_are_dealt_out_once(spark):
    intervals, tables = _parts(spark, [(1, bytearray(X.encode(_units(1, 20, 8, 1, 1), 64, 160, h=1, v=1, restart=1)))])
    df = huffman.with_tables(intervals.select("image_id", "interval_no", "data"), tables.select("image_id", "mcus"))
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert len(re.findall(r"\) Exchange\nInput \[\d+\]: \[[^\]]*\bdata#", plan)) == 1
    assert not re.findall(r"\) BroadcastExchange\nInput \[\d+\]: \[[^\]]*\bdata#", plan)
    got = df.collect()
    assert sorted(r.interval_no for r in got) == list(range(160))


def test_dc_values_wrap_around(spark):
    units = _units(1, 6, 6, 1, 1, dc=lambda r, c: 2000 * (6 * r + c))
    done = decode(spark.createDataFrame([(1, bytearray(X.encode(units, 48, 48, h=1, v=1, restart=0)))], "image_id long, content binary"))
    got = {(r.component, r.du_row, r.du_col): r.coef for r in done.coefficients.collect()}
    assert {p: x[0] for p, x in got.items()} == {p: (x[0] + 32768) % 65536 - 32768 for p, x in units.items()}
    assert done.rgb.count() == 36 and done.errors.count() == 0
