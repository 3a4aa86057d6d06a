"""Every registered query with an oracle agrees with it on the smallest tables; the others give rows."""
import pytest

from compare import connect, differences
from conftest import SF

from epitide import catalog

QUERIES, ORACLES = catalog.load()
SLOW = {"forecast_strategies"}  # covered by its own tests


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() == 15
