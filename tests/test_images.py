import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterjobs.functions import arrays as A
from rasterjobs.operators import batches, huffman, raster, segments, transform, validate
from rasterjobs.plans import fixtures as X
from rasterjobs.plans.decode import decode, triage
from rasterjobs.sources import files


def test_zigzag_is_a_permutation():
    assert sorted(A.ZIGZAG) == list(range(64))
    assert A.ZIGZAG[:6] == [0, 1, 8, 16, 9, 2] and A.ZIGZAG[48] == 58


def test_idct_of_a_flat_block_is_flat_and_near_the_float_transform():
    rng = np.random.RandomState(1)
    x = rng.randint(-200, 200, (50, 64))
    c = np.array([[np.cos((2 * i + 1) * k * np.pi / 16) * (np.sqrt(1 / 8) if not k else 0.5) for k in range(8)] for i in range(8)])
    want = np.einsum("ik,nkl,jl->nij", c, x.reshape(-1, 8, 8), c).reshape(-1, 64)
    assert np.abs(transform.idct8x8(x) - want).max() < 8
    flat = np.zeros((1, 64), int)
    flat[0, 0] = 80
    assert len(set(transform.idct8x8(flat)[0])) == 1


def test_colour_corners(spark):
    rows = spark.createDataFrame([(0, 0, 0), (127, 0, 0), (-128, 0, 0), (0, 0, 127), (0, 127, 0), (127, -300, 400)], "y int, cb int, cr int")
    got = rows.select(A.red(F.col("y"), F.col("cb"), F.col("cr")).alias("r"), A.blue(F.col("y"), F.col("cb"), F.col("cr")).alias("b")).collect()
    assert [tuple(r) for r in got] == [(128, 128), (255, 255), (0, 0), (255, 128), (128, 255), (255, 0)]


def _units(h, v, width, height, components, seed=3):
    rng = np.random.RandomState(seed)
    out = {}
    down, across = -(-height // 8), -(-width // 8)
    for r in range(down + down % v):
        for c in range(across + across % h):
            out[1, r, c] = rng.randint(-60, 60, 64).tolist()
            if components == 3 and r % v == 0 and c % h == 0:
                for k in (2, 3):
                    out[k, r, c] = (rng.randint(-30, 30, 64) * (rng.rand(64) < 0.3)).astype(int).tolist()
    return out


def test_round_trip_over_samplings_and_restarts(spark):
    rows, want = [], {}
    for k, (h, v, gap, comps) in enumerate([(h, v, gap, c) for h in (1, 2) for v in (1, 2) for gap in (0, 2) for c in (1, 3)]):
        units = _units(h, v, 37, 21, comps) if comps == 3 else _units(1, 1, 37, 21, 1)
        rows.append((k, bytearray(X.encode(units, 37, 21, h=h, v=v, restart=gap, components=comps))))
        want[k] = units
    done = decode(spark.createDataFrame(rows, "image_id long, content binary"))
    got = {}
    for r in done.coefficients.collect():
        got.setdefault(r.image_id, {})[r.component, r.du_row, r.du_col] = list(r.coef)
    for k, units in want.items():
        assert {p: x for p, x in got[k].items() if p in units} == {p: x for p, x in units.items() if p in got[k]}
        assert len(got[k]) >= 15
    bmps = {r.image_id: bytes(r.bmp) for r in done.bmps.collect()}
    assert len(bmps) == len(rows) and all(len(b) == 26 + 21 * 37 * 3 + 21 for b in bmps.values())
    assert bmps[0][:2] == b"BM" and bmps[0][10] == 26
    assert done.errors.count() == 0


def test_an_image_too_large_for_a_row_is_reported_and_exported(spark, monkeypatch, tmp_path):
    sizes = [(1, 37, 21), (2, 8, 8)]
    data = [(k, bytearray(X.encode(_units(1, 1, w, h, 3), w, h, h=1, v=1, restart=2, components=3))) for k, w, h in sizes]
    df = spark.createDataFrame(data, "image_id long, content binary")
    whole = {r.image_id: bytes(r.bmp) for r in decode(df).bmps.collect()}
    monkeypatch.setattr(raster, "MOST_BYTES", 1000)
    done = decode(df)
    assert [r.image_id for r in done.bmps.collect()] == [2] and {r.image_id for r in done.images.collect()} == {1, 2}
    assert [(r.image_id, r.code, r.detail) for r in done.errors.collect()] == [(1, "bmp_too_large", str(len(whole[1])))]
    files.export_rows(done.bmp_rows.withColumn("out_path", F.concat(F.lit("x/"), F.col("image_id"), F.lit(".bmp"))), str(tmp_path))
    assert {p.name: p.read_bytes() for p in tmp_path.iterdir()} == {"1.bmp": whole[1]}


def test_a_bmp_header_keeps_the_low_bytes_of_its_size(spark):
    side, size = 65_535, 26 + 65_535 * (3 * 65_535 + 3)
    head = spark.range(1).select(raster.bmp_header(F.lit(side).cast("bigint"), F.lit(side).cast("bigint")).alias("h")).first().h
    assert bytes.fromhex(head)[2:6] == (size % (1 << 32)).to_bytes(4, "little")


def _mutations():
    good = X.encode(_units(2, 2, 16, 16, 3), 16, 16, h=2, v=2, restart=0, quant=[[1] * 64, [1] * 64])
    sof, sos, dht, dqt = (good.index(bytes([0xFF, m])) for m in (0xC0, 0xDA, 0xC4, 0xDB))

    def put(at, *values):
        return good[:at] + bytes(values) + good[at + len(values) :]

    dri = b"\xff\xdd\x00\x05\x00\x01\x00"
    yield None, good
    yield "bad_soi", b"\xff\xd9" + good[2:]
    yield "expected_marker", good[:2] + b"\x00" + good[2:]
    yield "truncated", good[: sof + 6]
    yield "sos_before_sof", good[:2] + good[sos:]
    yield "multiple_sof", good[:sos] + good[sof : dht] + good[sos:]
    yield "bad_precision", put(sof + 4, 12)
    yield "bad_dimensions", put(sof + 5, 0, 0)
    yield "cmyk", put(sof + 9, 4)
    yield "no_components", put(sof + 9, 0)
    yield "yiq", put(sof + 10, 4)
    yield "bad_component_id", put(sof + 13, 9)
    yield "dup_component", put(sof + 13, 1)
    yield "bad_sampling", put(sof + 11, 0x31)
    yield "bad_quant_ref", put(sof + 12, 7)
    yield "bad_sof_length", good[:sof] + b"\xff\xc0\x00\x12" + good[sof + 4 : sof + 19] + b"\x00" + good[sof + 19 :]
    yield "bad_quant_id", put(dqt + 4, 5)
    yield "bad_dqt_length", good[:dqt] + b"\xff\xdb\x00\x10" + bytes(14) + good[dqt:]
    yield "bad_huffman_id", put(dht + 4, 4)
    yield "huffman_too_many", put(dht + 5, 200)
    yield "bad_dht_length", good[:dht] + b"\xff\xc4\x00\x05\x00\x00\x00" + good[dht:]
    yield "bad_dri_length", good[:sos] + dri + good[sos:]
    yield "empty_scan", put(sos + 4, 0)
    yield "bad_scan_component", put(sos + 5, 9)
    yield "dup_scan_component", put(sos + 7, 1)
    yield "bad_dc_table_id", put(sos + 6, 0x40)
    yield "bad_ac_table_id", put(sos + 6, 0x04)
    yield "bad_spectral", put(sos + 12, 62)
    yield "bad_approx", put(sos + 13, 1)
    yield "unset_quant", good[:2] + good[sof:]
    yield "unset_dc", put(sos + 6, 0x10)
    yield "unset_ac", put(sos + 6, 0x01)
    yield "bad_sos_length", good[:sos] + b"\xff\xda\x00\x0d" + good[sos + 4 : sos + 14] + b"\x00" + good[sos + 14 :]
    yield "expected_marker", good[:2] + b"\xff\xc1\x00\x02" + good[2:]  # an unknown marker, then its length
    yield "marker_in_scan", good[:-2] + b"\xff\xda" + good[-2:]
    yield "incomplete", good[: sos + 30] + b"\xff\xd9"


def test_each_rule_fires(spark):
    cases = list(_mutations())
    df = spark.createDataFrame([(i, bytearray(b)) for i, (_, b) in enumerate(cases)], "image_id long, content binary")
    done = decode(df)
    first = {r.image_id: r.code for r in validate.first_error(done.errors).collect()}
    for i, (code, _) in enumerate(cases):
        if code == "incomplete":
            assert first[i] in ("exhausted", "bad_ac_symbol", "bad_dc_symbol", "incomplete_scan", "zero_run")
        else:
            assert first.get(i) == code, (i, code, first.get(i))
    assert {r.image_id for r in done.images.select("image_id").collect()} == {0}
    assert triage(df, slots=0).report.filter("code = 'oversized'").count() == 1
    assert "unknown_marker" in {r.code for r in done.errors.select("code").collect()}


def test_null_and_empty_files(spark):
    df = spark.createDataFrame([(1, None), (2, bytearray(b""))], "image_id long, content binary")
    t = triage(df)
    assert {r.code for r in validate.first_error(t.errors).collect()} == {"bad_soi"}
    assert decode(df.limit(0)).bmps.count() == 0


def _flat(symbols, length):
    return huffman.lookup(tuple(len(symbols) if k == length else 0 for k in range(1, 17)), tuple(symbols))


def test_progressive_scans():
    w = X.BitWriter()
    w.put(2, 2), w.put(3, 2)  # DC size 2, value 3
    w.put(0, 2)
    units = list(huffman.decode_interval(w.data(), [(1, _flat([0, 1, 2], 2), None)], 2, True, 0, 0, 0, 1))
    assert [u[1] for u in units] == [3, 0] and not any(u[4] for u in units)
    ac = _flat([0x00, 0x11, 0x10, 0xF0], 2)
    w = X.BitWriter()
    w.put(1, 2), w.put(1, 1)  # one zero, then +1
    w.put(2, 2), w.put(1, 1)  # end of band for this and two more units
    units = list(huffman.decode_interval(w.data(), [(1, None, ac)], 4, True, 1, 63, 0, 2))
    assert units[0][2:4] == ([2], [4]) and [u[3] for u in units[1:]] == [[], [], []]
    assert units[3][4] is None or units[3][4] == "exhausted"
    w = X.BitWriter()
    w.put(1, 2), w.put(0, 1), w.put(0, 2)
    refined = list(huffman.decode_interval(w.data(), [(1, None, ac)], 1, True, 1, 63, 2, 1))
    assert refined[0][2:4] == ([2], [-2])


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(-1023, 1023), min_size=64, max_size=64), st.integers(-1000, 1000))
def test_units_round_trip(coef, before):
    coef[0] = max(-1000, min(1000, coef[0]))
    w = X.BitWriter()
    X._unit(w, coef, before)
    data = w.data().replace(b"\xff\x00", b"\xff")
    flat_dc, flat_ac = _flat(X.DC_SYMBOLS, 4), _flat(X.AC_SYMBOLS, 8)
    (_, diff, pos, vals, error), = huffman.decode_interval(data, [(1, flat_dc, flat_ac)], 1)
    got = [0] * 64
    for p, v in zip(pos, vals):
        got[A.ZIGZAG[p]] = v
    got[0] = diff + before
    assert error is None and got == coef


def test_next_fit_is_tight(spark):
    rows = [(i, f"p{i}", 100 + i * 7 % 50, 1 + i * 13 % 30) for i in range(200)]
    got = batches.pack_batches(spark.createDataFrame(rows, "image_id long, path string, length long, units int"), 40).orderBy("length", "path").collect()
    sums, first = {}, {}
    for r in got:
        sums[r.batch_id] = sums.get(r.batch_id, 0) + r.units
        first.setdefault(r.batch_id, r.units)
    assert max(sums.values()) <= 40
    assert all(sums[b] + first[b + 1] > 40 for b in sums if b + 1 in first)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 14), min_size=1, max_size=40), st.integers(1, 12))
def test_transitions_equal_the_fold(units, slots):
    opened, left = batches._transitions(np.array(units), slots)
    for free in range(-1, slots + 1):
        got, end = batches._fold(np.array(units), slots, free)
        assert (opened[free + 1], left[free + 1]) == (got[-1], end)


@pytest.fixture
def many_partitions(spark):
    conf = {"spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "50"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _spread(df):
    return df.groupBy(F.spark_partition_id()).count().count()


@pytest.mark.parametrize("shard", [[], ["source"]])
def test_a_shard_is_packed_and_ranked_by_many_tasks(spark, many_partitions, shard):
    rows = [(i, f"p{i:04}", 100 + i * 7 % 50, i * 13 % 44, [None, "b", "a", "a", "a"][i % 5]) for i in range(900)]
    df = spark.createDataFrame(rows, "image_id long, path string, length long, units int, source string")
    out, ranked = batches.pack_batches(df, 40, shard), files.size_rank(df, shard)
    got, ranks = {r.image_id: r.batch_id for r in out.collect()}, {r.image_id: r.size_rank for r in ranked.collect()}
    assert len(got) == len(ranks) == 900
    state = {}
    for i, _, _, need, source in sorted(rows, key=lambda r: (r[2], r[1])):
        batch, free, rank = state.get(source if shard else 0, (0, 40, 0))
        batch, free = (batch + 1, 40 - need) if need > free else (batch, free - need)
        state[source if shard else 0] = batch, free, rank + 1
        assert (got[i], ranks[i]) == (batch, rank + 1)
    one = df.filter("source = 'a'")
    assert _spread(batches.pack_batches(one, 40, shard)) > 2 and _spread(files.size_rank(one, shard)) > 2


def test_run_report_gathers_no_stage_in_one_row(spark, many_partitions):
    values = {"a": [float(i * 37 % 101) for i in range(500)], "b": [3.0], "c": [2.0, 1.0], "d": [None], None: [5.0, None, float("nan"), 4.0]}
    df = spark.createDataFrame([(0, s, x) for s, v in values.items() for x in v], "batch_id long, stage string, seconds double")
    out = batches.run_report(df)
    got = {r.stage: r for r in out.collect()}
    assert len(got) == 5 and all(got[s].calls == len(v) for s, v in values.items())
    assert got["a"].median == sorted(values["a"])[250] and got["a"].total == sum(values["a"]) and (got["a"].least, got["a"].most) == (0.0, 100.0)
    assert (got["b"].median, got["c"].median, got["d"].median, got[None].median) == (3.0, 2.0, None, 5.0)
    assert "collect_list" not in out._jdf.queryExecution().toString()


def test_files_and_names(spark, tmp_path):
    for n in ("a.b/c", "a.b/d.jpg"):
        p = tmp_path / n
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"x")
    df = files.read_images(spark, str(tmp_path), glob="*")
    assert sorted(r.o.rsplit("/", 1)[1] for r in df.select(files.output_path(F.col("path")).alias("o")).collect()) == ["c.bmp", "d.bmp"]


@pytest.mark.parametrize("data", [b"", b"\xff", b"\xff\xd8", b"\xff\xd8\xff", b"\xff\xd8\xff\xdb\x00"])
def test_short_files_end_with_an_error(data):
    assert list(segments.split_segments(data))[-1][-1] in ("bad_soi", "truncated")


@pytest.mark.parametrize("components,h,v", [(1, 1, 1), (3, 2, 2)])
def test_units_that_are_missing_are_zero(spark, components, h, v):
    units = {(1, r, c): [20 * (r + c + 1)] + [0] * 63 for r in range(4) for c in range(4)}
    whole = X.encode(units, 32, 32, h=h, v=v, components=components)
    scan = whole.index(b"\xff\xda")
    cut = whole[: scan + 2 + int.from_bytes(whole[scan + 2 : scan + 4], "big") + (len(whole) - scan) // 8]
    files = spark.createDataFrame([(1, bytearray(whole)), (2, bytearray(cut))], "image_id bigint, content binary")
    kept = decode(files, keep_partial=True)
    bmp = {r.image_id: bytes(r.bmp) for r in kept.bmps.collect()}
    assert len(bmp[1]) == len(bmp[2]) == int.from_bytes(bmp[2][2:6], "little") == 26 + 32 * 96
    assert bmp[1] != bmp[2] and len(set(bmp[2][26 : 26 + 96])) == 1  # the lowest rows are gray
    assert bmp[1][-96:][:24] == bmp[2][-96:][:24]
    assert [r.image_id for r in decode(files).bmps.collect()] == [1]
