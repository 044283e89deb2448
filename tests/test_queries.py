"""Every query of the engine against its SQL in DuckDB, or at least run."""

import pytest

from foliant.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_equals_sql(spark, sf, same, name):
    same(catalog.QUERIES[name](spark, sf), catalog.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    assert df.columns
    assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_crc_constant():
    assert catalog.CRC_CHECK == 0xCBF43926
