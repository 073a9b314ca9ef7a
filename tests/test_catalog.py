"""Every query of the catalogue against its SQL in DuckDB."""

import pytest
from conftest import duck, same

from sparkweave.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, folder, name):
    df = catalog.QUERIES[name](spark, folder)
    same(df, duck(folder).sql(catalog.ORACLE_SQL[name]))


def test_every_query_has_sql():
    assert set(catalog.ORACLE_SQL) == set(catalog.QUERIES)
