"""Files written by repeated, lost and speculative tasks, and names that clash."""

import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from rasterjobs.sources import files, sink


def _tree(folder):
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f), "rb").read() for d, _, fs in os.walk(folder) for f in fs}


def _rows(*items):
    return [Row(out_path=p, data=bytearray(x)) for p, x in items]


@pytest.mark.parametrize("beside", [False, True])
def test_repeated_and_lost_attempts(spark, tmp_path, beside):
    folder = None if beside else str(tmp_path)
    work = sink.new_work(spark, folder)
    w = sink.FileWriter(work, beside)
    a, b = [(str(tmp_path / "a.bmp"), b"one")], [(str(tmp_path / "b.bmp"), b"two"), (str(tmp_path / "c.bmp"), b"")]

    def lost():
        yield from _rows(*b[:1])
        raise RuntimeError

    with pytest.raises(RuntimeError):
        w.write(lost())  # the task is repeated
    first, second, twin = w.write(_rows(*a)), w.write(_rows(*b)), w.write(_rows(*b))  # and a speculative twin, never committed
    assert first.name != twin.name
    w.commit([first, None, second])
    done = sink.publish(spark, work, folder, None, "number")
    assert _tree(tmp_path) == {"a.bmp": b"one", "b.bmp": b"two", "c.bmp": b""}
    assert sorted((os.path.basename(r.target), r.size) for r in done.collect()) == [("a.bmp", 3), ("b.bmp", 3), ("c.bmp", 0)]
    assert not os.path.exists(work)
    work = sink.new_work(spark, folder)
    w = sink.FileWriter(work, beside)
    w.write(_rows((str(tmp_path / "d.bmp"), b"x")))
    w.abort([None])
    assert "d.bmp" not in _tree(tmp_path) and len(_tree(tmp_path)) == 3


def test_moving_is_repeatable(tmp_path):
    (tmp_path / "x.tmp").write_bytes(b"1")
    for _ in range(2):
        sink.move(str(tmp_path / "x.tmp"), str(tmp_path / "sub/x.bmp"))
    assert _tree(tmp_path) == {"sub/x.bmp": b"1"}
    with pytest.raises(FileNotFoundError):
        sink.move(str(tmp_path / "y.tmp"), str(tmp_path / "y.bmp"))


def test_equal_names_are_two_files_or_errors(spark, tmp_path):
    rows = [("file:/in/a/x.bmp", b"a"), ("/in/b/x.bmp", b"b"), ("/in/b/x.bmp", b"c"), ("/in/.d/noend", b"d"), ("y.bmp", None)]
    df = spark.createDataFrame([(p, bytearray(x) if x is not None else None) for p, x in rows], "out_path string, bmp binary")
    done = files.export_files(df, str(tmp_path / "n")).collect()
    tree = _tree(tmp_path / "n")
    assert sorted(tree.values()) == [b"", b"a", b"b", b"c", b"d"] and tree["x.bmp"] == b"a" and tree["noend"] == b"d" and len(tree) == 5
    assert {os.path.basename(r.target) for r in done} == set(tree) and all(r.error is None for r in done)
    done = files.export_files(df, str(tmp_path / "r"), clash="report").collect()
    assert set(_tree(tmp_path / "r")) == {"noend", "y.bmp"}
    assert sorted((r.out_path, r.error) for r in done if r.error) == [("/in/a/x.bmp", "output_clash"), ("/in/b/x.bmp", "output_clash"), ("/in/b/x.bmp", "output_clash")]
    files.export_files(df.limit(2), f"file:{tmp_path}/k", base="/in").collect()
    assert _tree(tmp_path / "k") == {"a/x.bmp": b"a", "b/x.bmp": b"b"}
    assert files.export_files(df.limit(0), str(tmp_path / "e")).collect() == [] and _tree(tmp_path / "e") == {}


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    df = spark.range(20).select(F.concat(F.lit("/in/"), F.col("id"), F.lit(".bmp")).alias("out_path"), F.when(F.col("id") == 19, F.raise_error(F.lit("stop"))).otherwise("x").cast("binary").alias("bmp"))
    with pytest.raises(Exception, match="stop"):
        files.export_files(df.repartition(3), str(tmp_path))
    assert os.listdir(tmp_path) == []


def test_rows_of_large_files_keep_equal_names_apart(spark, tmp_path):
    parts = [(p, at, bytearray(c * 3), 6) for p, c in (("/a/x.bmp", b"1"), ("/b/x.bmp", b"2")) for at in (0, 3)]
    done = files.export_rows(spark.createDataFrame(parts, "out_path string, at long, bytes binary, size long"), str(tmp_path)).collect()
    tree = _tree(tmp_path)
    assert tree["x.bmp"] == b"111111" and sorted(tree.values()) == [b"111111", b"222222"] and {os.path.basename(r.target) for r in done} == set(tree)
