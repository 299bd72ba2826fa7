"""Headers read without the rest of a file, rows and BMP files put together as bytes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterjobs.operators import raster, segments
from rasterjobs.plans import fixtures as X
from rasterjobs.plans.decode import decode, triage
from rasterjobs.sources import files, headers
from tests.test_images import _mutations


def test_only_header_bytes_are_read(tmp_path):
    good = next(x for code, x in _mutations() if code is None)
    note = b"\xff\xe1\xff\xff" + bytes(65_533)
    data = good[:2] + note * 20 + good[2:-2] + bytes(5_000_000) + good[-2:]
    (tmp_path / "a.jpg").write_bytes(data)
    lazy = headers.Lazy(f"file:{tmp_path}/a.jpg")
    got = list(segments.split_segments(lazy, segments.IGNORED))
    assert got == [s for s in segments.split_segments(data) if s[1] not in segments.IGNORED]
    assert lazy.read <= (20 + 3) * headers.BLOCK and len(lazy) == len(data)
    assert list(segments.split_segments(headers.Lazy(str(tmp_path / "a.jpg"), 1), segments.IGNORED)) == got


def test_triage_of_listed_files_equals_triage_of_their_bytes(spark, tmp_path):
    for i, (_, x) in enumerate(_mutations()):
        (tmp_path / f"{i}.jpg").write_bytes(x[:2] + b"\xff\xfe\x00\x05abc" + x[2:] if i % 2 else x)
    (tmp_path / "empty.jpg").write_bytes(b"")
    listed, whole = files.list_images(spark, str(tmp_path)), files.read_images(spark, str(tmp_path))
    assert listed.columns == ["image_id", "path", "length"]
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]
    a, b = triage(listed), triage(whole)
    for name in ("segs", "errors", "images"):
        x, y = (sorted(map(repr, getattr(t, name).drop("file").collect())) for t in (a, b))  # a checksum of what is at hand
        assert x == y, name


@pytest.mark.parametrize("width,height", [(29, 21), (8, 8), (1, 1), (33, 16)])
def test_rows_and_files_from_blocks(spark, width, height):
    rng, images, blocks, want = np.random.RandomState(width), [], [], {}
    for image in ("b", "a", "c"):
        down, across = -(-height // 8), -(-width // 8)
        whole = rng.randint(0, 256, (down * 8, across * 8, 3))
        images.append((image, width, height))
        for r in range(down):
            for c in range(across):
                part = whole[8 * r : 8 * r + 8, 8 * c : 8 * c + 8]
                blocks.append((image, r, c, *(part[..., k].ravel().tolist() for k in range(3))))
        want[image] = [whole[y, :width, ::-1].astype(np.uint8).tobytes() + bytes(width % 4) for y in range(height)]
    df = spark.createDataFrame(blocks, "image_id string, du_row int, du_col int, r array<smallint>, g array<smallint>, b array<smallint>")
    img = spark.createDataFrame([*images, ("none", 4, 4)], "image_id string, width int, height int")
    rows = raster.raster_rows(df.repartition(3), img)
    got = {}
    for r in rows.collect():
        got.setdefault(r.image_id, {})[r.y] = bytes(r.bytes)
    assert {i: [x[y] for y in range(height)] for i, x in got.items()} == want
    bmps = {r.image_id: bytes(r.bmp) for r in raster.to_bmp(rows, img).collect()}
    assert set(bmps) == set(want)
    for i, x in bmps.items():
        assert x[26:] == b"".join(reversed(want[i])) and x[:2] == b"BM" and int.from_bytes(x[2:6], "little") == len(x)
        assert [int.from_bytes(x[k : k + 2], "little") for k in (18, 20)] == [width, height]


def test_file_bytes_are_not_shuffled(spark):
    df = spark.createDataFrame([(1, bytearray(X.encode({}, 16, 16)))], "image_id long, content binary")
    plan = segments.entropy_intervals(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert decode(df).bmps.select(F.length("bmp").alias("n")).first().n == 26 + 16 * 48
