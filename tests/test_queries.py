import pytest

from siltstone.plans import registry

from .conftest import DATA


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(name, spark, duck, same):
    frame = registry.queries()[name](spark, DATA)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert frame.count() == 200
    else:
        same(frame, duck, sql)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
