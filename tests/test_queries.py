"""Every registered query outside the llm subpackage against its SQL, on the sf0.001 tables."""

import glob
import math
import os

import duckdb
import pytest

from larkspur.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def normal(rows):
    fix = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 5) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(map(fix, r)) for r in rows), key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = normal(df.select(*(f"`{c}`" for c in cols)).collect())
    if name not in ORACLE:
        assert len(got) > 0
        return
    rel = con.sql(ORACLE[name])
    assert sorted(rel.columns) == cols
    assert got == normal(con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({ORACLE[name]})").fetchall())
