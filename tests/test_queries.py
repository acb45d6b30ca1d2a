import pytest

from layerlens.plans import queries as plans

SQL = plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_equals_sql(spark, sf, duck, same, name):
    same(plans.queries()[name](spark, sf), duck, SQL[name])


def test_entry(spark, sf):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())
