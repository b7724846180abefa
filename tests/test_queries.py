import pytest

from gradus.plans import queries as plans

from .compare import assert_same


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf, name):
    df = plans.QUERIES[name](spark, sf)
    if name in plans.SQL:
        assert_same(df, plans.SQL[name], sf)
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).schema.names
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
