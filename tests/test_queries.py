import pytest

from rasterjobs.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(name, same):
    same(QUERIES[name], ORACLES[name])


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


def test_entry_points_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "decode_corpus" in e.queries()
