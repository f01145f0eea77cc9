"""Every registered query against its SQL in DuckDB."""

import pytest

from compare import DATA, duck, rows_of, rows_of_sql
from ridgeline.plans import ORACLES, QUERIES

SF = str(DATA / "sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, con, name):
    assert rows_of(QUERIES[name](spark, SF)) == rows_of_sql(con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_registers_all():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
