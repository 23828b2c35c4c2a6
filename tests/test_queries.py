import pytest

from fieldproof.plans import catalog

from .oracle import DATA, same


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(spark, catalog.queries()[name], catalog.oracle_sql()[name])


def test_queries_without_sql_run(spark):
    for name in catalog.queries().keys() - catalog.oracle_sql().keys():
        assert catalog.queries()[name](spark, f"{DATA}/sf0.001").count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 20
    assert set(e.oracle_sql()) <= set(e.queries())
