import compare
import pytest

import __spark_entry__ as entry

ORACLES = entry.oracle_sql()
WITHOUT_SQL = sorted(set(entry.queries()) - set(ORACLES))


@pytest.fixture(scope="module")
def duck(sf):
    return compare.connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, sf, duck, name):
    assert compare.differences(entry.queries()[name](spark, sf), duck, ORACLES[name]) is None


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_query_without_oracle_gives_rows(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["label", "term", "weight", "rank"]
    assert df.count() == 40
