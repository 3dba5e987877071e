"""Every query of the core library against its SQL counterpart, on the smallest tables."""

from __future__ import annotations

import pytest

from kvtrail import registry
from tests.conftest import SMALL, normal


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SMALL)
    rows = [r.asDict() for r in df.collect()]
    if name not in registry.ORACLE_SQL:
        assert df.columns
        return
    cursor = duck.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = [dict(zip(columns, r, strict=True)) for r in cursor.fetchall()]
    assert normal(rows, sorted(columns)) == normal(want, sorted(columns))
