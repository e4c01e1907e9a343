"""Every core query with SQL against DuckDB on the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

from textloom.plans import registry

DATA = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "tzinfo"):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return c


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_sql(spark, con, name):
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    r = con.execute(registry.ORACLE[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    expected = Counter(tuple(norm(x[names.index(c)]) for c in cols) for x in r.fetchall())
    assert Counter(tuple(norm(x[c]) for c in cols) for x in df.collect()) == expected
