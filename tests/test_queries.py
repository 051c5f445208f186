"""Every registered query of the library against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from kinfold.plans import catalog

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def norm(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)

    if name in catalog.ORACLES:
        rel = db.sql(catalog.ORACLES[name])
        assert sorted(rel.columns) == cols
        names = {c: i for i, c in enumerate(rel.columns)}
        want = sorted((tuple(norm(r[names[c]]) for c in cols) for r in rel.fetchall()), key=repr)
        assert got == want
