"""Every query of the catalogue against its SQL, run by DuckDB over the same tables."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from graingrid.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_gives_what_sql_gives(spark, sf, duck, name):
    out = catalogue.QUERIES[name](spark, sf)
    want = duck.execute(catalogue.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(out.columns) == sorted(names)
    got = Counter(tuple(plain(r[c]) for c in names) for r in out.collect())
    assert got == Counter(tuple(plain(v) for v in r) for r in want.fetchall())
    assert got, "an empty result tests nothing"
