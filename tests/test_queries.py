"""Every query against its SQL; those without SQL have to give rows of a stable schema."""

from __future__ import annotations

import pytest
from compare import differences

from plumbline import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, name):
    f = catalog.QUERIES[name]
    if name in catalog.ORACLE_SQL:
        assert differences(spark, name, f, catalog.ORACLE_SQL[name], sf_dir) is None
    else:
        assert f(spark, sf_dir).schema == f(spark, sf_dir).schema and f(spark, sf_dir).count() > 0
