"""Every query of the library against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import compare
from evenkeel.plans import catalog

FOLDER = "/root/testdata/sf0.001"
# With ten suppliers no rack has one rich enough, and no queue runs low.
MAY_BE_EMPTY = {"racks_alive", "stream_refill_alerts"}


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query_matches_sql(spark, name):
    query, sql = catalog.QUERIES[name], catalog.SQL[name]
    assert compare(spark, FOLDER, query, sql, may_be_empty=name in MAY_BE_EMPTY) is None


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(catalog.SQL) <= set(entry.oracle_sql())


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns == ["executor_id", "remaining", "victim"]
    assert result.where("victim IS NOT NULL AND victim <> executor_id").count() > 0
