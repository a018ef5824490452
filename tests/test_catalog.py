"""Every registered query of the engine against its DuckDB twin on the smallest tables."""

import pytest
from compare import SF, connect, same

from propago.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLES:
        same(df, connect(), catalog.ORACLES[name])
    else:
        assert df.columns and df.count() > 0
