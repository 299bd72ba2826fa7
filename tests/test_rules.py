"""Header rules in one pass."""

from rasterjobs.operators import segments, validate
from rasterjobs.plans.decode import triage
from tests.test_images import _mutations


def _segs(data):
    out = []
    for order, marker, offset, length, p, error in segments.split_segments(data, segments.IGNORED):
        good = error is None
        out.append((order, marker, length, offset, p, error, list(segments.split_quant(p)) if good and marker == segments.DQT else None, list(segments.split_huffman(p)) if good and marker == segments.DHT else None))
    return out


def test_rules_of_one_header():
    for code, data in _mutations():
        found = sorted(((o, s, c) for c, _, o, s in validate.violations(_segs(data)) if c != "unknown_marker"))
        assert (found[0][2] if found else None) == (code if code not in ("marker_in_scan", "incomplete") else None), code


def test_any_cut_or_changed_byte_is_judged():
    good = next(x for code, x in _mutations() if code is None)
    head = good.index(b"\xff\xda") + 14
    for i in range(head):
        assert validate.violations(_segs(good[:i])) or i == 0
        for v in (0, 1, 4, 0x7F, 0xFF):
            validate.violations(_segs(good[:i] + bytes([v]) + good[i + 1 :]))


def test_one_scan_and_one_python_pass(spark):
    df = spark.createDataFrame([(i, bytearray(x)) for i, (_, x) in enumerate(_mutations())], "image_id long, content binary")
    plan = validate.validate(validate.checked_segments(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan and "Join" not in plan
    t = triage(df)
    assert "MapInArrow" not in t.errors._jdf.queryExecution().executedPlan().toString()
    assert {"quant", "huffman", "broken"} <= set(t.segs.columns)
