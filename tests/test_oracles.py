"""Every registered query of the core library against its SQL."""

import pytest

from trajecta import queries as registry

from .compare import connect, differences

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    if name not in SQL:
        assert df.count() >= 0
        return
    missing, extra, cols, names = differences(df, SQL[name], con)
    assert cols == names
    assert not missing and not extra
