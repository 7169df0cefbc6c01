"""Every registered query against its SQL on the smallest tables; queries without SQL must run and give rows."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from waveloom.plans import registry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, str(DATA))
    rows = [tuple(r) for r in df.collect()]
    if name in registry.SQL:
        expected = duck.sql(registry.SQL[name])
        assert sorted(df.columns) == sorted(expected.columns)
        assert _rows(rows, df.columns) == _rows(expected.fetchall(), expected.columns)
    else:
        assert rows or name in ("corr_adjust", "fp_frame_scan")
