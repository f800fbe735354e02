"""Each registered query against its DuckDB oracle, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from duespark import registry


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def norm(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, dict):
        return tuple((k, norm(v)) for k, v in x.items())
    if isinstance(x, (list, tuple)):
        return tuple(norm(v) for v in x)
    return x


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_oracle(spark, small, name):
    df = registry.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    want = connect(small).execute(registry.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = sorted((repr(tuple(norm(r[k]) for k in at)) for r in want.fetchall()))
    found = sorted(repr(tuple(norm(r.asDict(True)[c]) for c in columns)) for r in df.collect())
    assert found == expected
    assert found, "an empty result shows nothing"


def test_queries_have_names_and_oracles():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
