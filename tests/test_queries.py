"""Every query with SQL gives the same rows as that SQL; the others give rows."""

import pytest

import bookflow.plans.details  # noqa: F401 - registers its queries
from bookflow.plans.queries import QUERIES, SQL
from compare import check


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, name):
    check(spark, data, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["novel_id", "chapter_id", "file_name", "place", "title", "html"]
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
