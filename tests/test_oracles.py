import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracles import compare
from quire.catalogue import QUERIES
from quire.oracles import ORACLES

SF_DIR = "/root/testdata/sf0.001"


def test_every_query_has_sql_and_the_other_way_round():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


def test_entry(spark):
    rows = entry(spark)
    assert rows.columns == ["path", "version", "datasource", "server", "dbname"] and rows.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_its_sql(spark, name):
    assert compare(spark, SF_DIR, name) is None
