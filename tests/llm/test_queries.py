"""Every query of the subpackage that has SQL against it, on the sf0.001 tables."""

import pytest

from larkspur.llm.queries import ORACLE, QUERIES

from ..test_queries import con, normal  # noqa: F401


def test_names():
    assert set(ORACLE) <= set(QUERIES)
    assert {n.split("_")[0] for n in QUERIES} == {*(f"op{i}" for i in range(1, 14)), "pipeline"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, con, sf, name):  # noqa: F811
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rel = con.sql(ORACLE[name])
    assert sorted(rel.columns) == cols
    got = df.select(*(f"`{c}`" for c in cols)).collect()
    want = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({ORACLE[name]})").fetchall()
    assert normal(got) == normal(want)
