"""Files read in ranges, and the life of staged tables."""

import os

import numpy as np
import pytest

from rasterjobs.operators import segments
from rasterjobs.plans import fixtures as X
from rasterjobs.plans.decode import decode
from rasterjobs.sources import files, staging
from rasterjobs.streaming.decode import stream_decode


def _joined(data, start, size):
    """The intervals that the pieces of all ranges make, without Spark."""
    out, number, parts = [], 0, []
    n = max(1, -(-(len(data) - start) // size))
    for k in range(n):
        lo = start + k * size
        for piece, code in segments.split_range(data, start, lo, len(data) if k == n - 1 else lo + size):
            parts.append(piece)
            if code is not None:
                out.append((number, b"".join(parts), None if 0xD0 <= code <= 0xD7 or code == 0xD9 else "marker_in_scan"))
                if not 0xD0 <= code <= 0xD7:
                    return out
                number, parts = number + 1, []
    return [*out, (number, b"".join(parts), "truncated")]


@pytest.mark.parametrize("end", [b"\xff\xd9", b"\xff\xff\xff\xd9rest\xff\xd0x", b"", b"\xff", b"\xff\xff", b"\xff\xda\xff\xd9"])
def test_ranges_of_every_size_give_the_intervals_of_the_whole(end):
    rng = np.random.RandomState(len(end))
    body = b"".join(bytes(rng.randint(0, 255, rng.randint(0, 5)).tolist()) + [b"", b"\xff\x00", b"\xff\xd3", b"\xff\xff\xff\x00", b"\xff\xff\xd1"][rng.randint(5)] for _ in range(40))
    data = b"headFF" + body + end
    want = list(segments.split_intervals(data, 6))
    for size in range(1, len(data) + 2):
        assert _joined(data, 6, size) == want, size


def test_listed_files_decode_as_their_bytes_do(spark, tmp_path):
    rng = np.random.RandomState(3)
    for k, (down, gap) in enumerate([(9, 0), (9, 4), (1, 1), (30, 7)]):
        units = {(c, r, x): (rng.randint(-60, 60, 64) * (rng.rand(64) < 0.4)).astype(int).tolist() for c in (1, 2, 3) for r in range(down) for x in range(4)}
        data = X.encode(units, 32, 8 * down, restart=gap)
        (tmp_path / f"{k}.jpg").write_bytes(data)
        (tmp_path / f"cut{k}.jpg").write_bytes(data[:-40])
        (tmp_path / f"bad{k}.jpg").write_bytes(data[:-30] + b"\xff\xda" + data[-28:])
    listed, whole = files.list_images(spark, str(tmp_path)), files.read_images(spark, str(tmp_path))
    segs = segments.segments(whole)
    want = sorted((r.image_id, r.interval_no, bytes(r.data), r.error or "") for r in segments.entropy_intervals(whole).collect())
    for size in (7, 100, 1 << 20):
        assert sorted((r.image_id, r.interval_no, bytes(r.data), r.error or "") for r in segments.entropy_ranges(listed, segs, size).collect()) == want
    a, b = decode(listed), decode(whole)
    assert {r.image_id: bytes(r.bmp) for r in a.bmps.collect()} == {r.image_id: bytes(r.bmp) for r in b.bmps.collect()}
    assert sorted(map(repr, a.errors.collect())) == sorted(map(repr, b.errors.collect()))


def test_micro_batches_leave_only_their_results(spark, tmp_path, monkeypatch):
    shared = tmp_path / "shared"
    shared.mkdir()
    monkeypatch.setattr(staging, "shared_dir", lambda _: str(shared))
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / f"in/{k}.jpg").write_bytes(X.encode({}, 16, 16))
    stream_decode(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "own"), files_per_batch=1).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/bmps")).count() == 3
    assert sorted(f for f in os.listdir(tmp_path / "out/bmps") if f.startswith("batch=")) == [f"batch={k}" for k in range(3)]
    assert os.listdir(shared) == [] and sorted(os.listdir(tmp_path / "out")) == ["bmps", "errors"]
    with pytest.raises(ValueError), staging.run_tables(spark):
        staging.stage(spark.range(3), "given-up")
        assert len(os.listdir(shared)) == 1
        raise ValueError
    assert os.listdir(shared) == []


def test_a_file_listed_twice_is_decoded_once(spark, tmp_path):
    a, b = X.encode({(1, 0, 0): [9] + [0] * 63}, 16, 16, restart=1), X.encode({(1, 0, 0): [90] + [0] * 63}, 16, 24)
    rows = [(1, a), (1, a), (2, b), (3, a), (3, b), (4, b"no"), (4, b"no")]
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in rows], "image_id long, content binary")
    done = decode(df)
    alone = {r.image_id: bytes(r.bmp) for r in decode(spark.createDataFrame([(1, bytearray(a)), (2, bytearray(b))], "image_id long, content binary")).bmps.collect()}
    assert {r.image_id: bytes(r.bmp) for r in done.bmps.collect()} == alone and done.bmps.count() == 2
    assert sorted((r.image_id, r.code) for r in done.errors.collect()) == [(3, "repeated_id"), (4, "bad_soi")]
    (tmp_path / "a.jpg").write_bytes(a)
    listed = files.list_images(spark, str(tmp_path))
    assert [bytes(r.bmp) for r in decode(listed.unionByName(listed)).bmps.collect()] == [alone[1]]
