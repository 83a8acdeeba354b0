"""Every registered query against its SQL on the smallest tables."""

import pytest

from inkmark.plans import registry
from tests.conftest import plain


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_same_as_sql(spark, duck, sf, name):
    got = registry.QUERIES[name](spark, sf)
    assert name in registry.ORACLES
    want = duck.sql(registry.ORACLES[name])
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert plain(tuple(r) for r in got.select(*cols).collect()) == plain(want.select(*[f'"{c}"' for c in cols]).fetchall())
