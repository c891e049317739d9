"""Every query of the engine against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from tesserix.plans import catalog

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", catalog.queries())
def test_against_sql(spark, db, name):
    df = catalog.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    if name not in catalog.oracle_sql():
        assert df.count() > 0
        return
    want = db.sql(catalog.oracle_sql()[name])
    assert cols == sorted(want.columns)
    order = lambda rows: sorted(rows, key=lambda r: tuple((x is None, round(x, 4) if isinstance(x, float) else 0.0, "" if isinstance(x, float) else str(x)) for x in r))
    got, want = order([tuple(r) for r in df.select(*cols).collect()]), order(want.select(*cols).fetchall())
    assert len(got) == len(want) > 0
    for a, b in zip(got, want, strict=True):
        assert all(type(x) is type(y) for x, y in zip(a, b, strict=True)), (a, b)
        assert all(math.isclose(x, y, abs_tol=2e-6) if isinstance(x, float) else x == y for x, y in zip(a, b, strict=True)), (a, b)
