"""Every registered query against its oracle, on the smallest tables."""

import pytest
from compare import difference

from __spark_entry__ import entry, oracle_sql, queries

RUNS, ORACLES = queries(), oracle_sql()


@pytest.mark.parametrize("name", sorted(RUNS))
def test_query(spark, sf, name):
    df = RUNS[name](spark, sf)
    if name in ORACLES:
        assert difference(df, ORACLES[name], sf) is None
    else:
        assert df.count() > 0


def test_oracles_name_known_queries():
    assert set(ORACLES) <= set(RUNS)


def test_entry(spark):
    assert entry(spark).count() > 0
