import pytest

from minuteloom import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(name, spark, sf_dir, duck, same):
    same(registry.QUERIES[name](spark, sf_dir), duck.sql(registry.ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(name, spark, sf_dir):
    assert registry.QUERIES[name](spark, sf_dir).collect() is not None


def test_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
