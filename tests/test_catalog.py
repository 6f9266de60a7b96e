import math

import duckdb
import pytest

from strandline import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{DIR}/{t}.parquet'")
    return con


def key(row):
    """Rows are ordered by what isn't a float first."""
    return tuple((x is None, "" if x is None or isinstance(x, float) else str(x)) for x in row), tuple(x if isinstance(x, float) else 0.0 for x in row)


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, sql, name):
    got = catalog.QUERIES[name](spark, DIR)
    cols = sorted(got.columns)
    a = sorted(map(tuple, got.select(*cols).collect()), key=key)
    b = sorted(sql.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({catalog.ORACLE_SQL[name]}) q").fetchall(), key=key)
    assert len(a) == len(b) and all(same(x, y) for r, s in zip(a, b) for x, y in zip(r, s, strict=True))


def test_queries_are_documented():
    assert all(f.__doc__ for f in catalog.QUERIES.values())
